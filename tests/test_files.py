"""Round trips through Spark, pieces, series, streams, conversion and the command line."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.cli import expand, main
from meshweave.errors import InvalidState, MeshError, ValueProblem
from meshweave.operators.grids import image_grid, structured_cells, structured_points
from meshweave.operators.mesh import Frame, Mesh, SeriesWriter, load_table, read_mesh, stored_precision, write_mesh
from meshweave.operators.pieces import structured_merge
from meshweave.plans.convert import convert, info
from meshweave.sources.vtkxml import VtkFile, parallel_pieces, series_steps
from meshweave.streaming.series import SeriesStreamReader


def analytical(x, y, z=0.0, t=1.0):
    return 10 * math.sin(x) * math.cos(y) * (z + 1) * t


def with_fields(mesh):
    f = 10 * F.sin("x") * F.cos("y") * (F.col("z") + 1)
    mesh.point_data = mesh.points.select("point_id", f.alias("p"), F.array(f, f).alias("v"), f.cast("float").alias("f"))
    return mesh


def largest_error(spark, path):
    rows = load_table(spark, path, "points").join(load_table(spark, path, "point_data"), ["step", "piece", "point_id"]).collect()
    assert rows and all(r.v[2] == 0 and r.v[0] == r.v[1] == r.p for r in rows)
    return max(abs(r.p - analytical(r.x, r.y, r.z)) for r in rows), len(rows)


@pytest.mark.parametrize("options", [{"encoder": "ascii"}, {"encoder": "raw"}, {"compressor": "zlib", "data_format": "inlined"}, {"compressor": None}])
@pytest.mark.parametrize("format", ["vti", "vtu"])
def test_quick_start(spark, tmp_path, format, options):
    path = write_mesh(with_fields(image_grid(spark, [1.0, 1.0], [10, 12])), str(tmp_path / f"quick.{format}"), **options)
    error, n = largest_error(spark, path)
    assert error < 1e-6 and n == 143
    assert load_table(spark, path, "cells").count() == 120


def structured(spark, kind):
    cells = [4, 5, 2]
    points = structured_points(spark, cells)
    ordinates = None
    if kind == "rectilinear":
        ordinates = [[0.0, 1.0, 4.0, 9.0, 16.0], [float(j) for j in range(6)], [0.0, 0.5, 1.0]]
        points = points.withColumns({"x": (F.col("i") * F.col("i")).cast("double"), "y": F.col("j").cast("double"), "z": F.col("k") * 0.5})
    if kind == "structured":
        points = points.withColumns({"x": F.col("i") + 0.1 * F.col("j"), "y": F.col("j") * 1.0, "z": F.col("k") * 0.5})
    entities = structured_cells(spark, cells, kind != "structured")
    return with_fields(Mesh(kind, points, entities, frame=Frame([0, 4, 0, 5, 0, 2], ordinates=ordinates)))


@pytest.mark.parametrize("kind", ["image", "rectilinear", "structured"])
def test_structured_formats_in_3d(spark, tmp_path, kind):
    mesh = structured(spark, kind)
    path = write_mesh(mesh, str(tmp_path / f"a.{mesh.default_format()}"))
    error, n = largest_error(spark, path)
    assert error < 1e-12 and n == 90
    assert load_table(spark, path, "cells").select("cell_id", "corners").orderBy("cell_id").collect() == mesh.cells.select("cell_id", "corners").orderBy("cell_id").collect()
    back = read_mesh(spark, path)
    assert back.kind == kind and back.frame.whole_extent == [0, 4, 0, 5, 0, 2]


def test_wrong_formats_and_fields(spark, tmp_path):
    mesh = image_grid(spark, [1.0], [3])
    with pytest.raises(ValueProblem):
        write_mesh(mesh, str(tmp_path / "a.vtr"))
    path = write_mesh(with_fields(mesh), str(tmp_path / "a.vti"))
    with pytest.raises(Exception, match="no field named nope"):
        load_table(spark, path, "point_data", "nope").collect()
    with pytest.raises(Exception, match="no table"):
        load_table(spark, path, "nope").collect()
    assert load_table(spark, path, "point_data", "p").columns == ["step", "piece", "point_id", "p"]


def pieced(spark, kind="unstructured"):
    """Two unit squares side by side, in a piece each."""
    points = spark.createDataFrame([(r, i, float(x + r), float(y), 0.0) for r in (0, 1) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])], "piece int, point_id bigint, x double, y double, z double")
    cells = spark.createDataFrame([(r, 0, "quadrilateral", [0, 1, 2, 3]) for r in (0, 1)], "piece int, cell_id bigint, cell_type string, corners array<bigint>")
    return Mesh(kind, points, cells, points.select("piece", "point_id", F.col("x").alias("p")), cells.select("piece", "cell_id", F.col("piece").cast("double").alias("c")))


@pytest.mark.parametrize("format", ["vtu", "vtp"])
def test_pieces_of_unstructured_grids(spark, tmp_path, format):
    path = write_mesh(pieced(spark), str(tmp_path / f"a.p{format}"))
    assert path.endswith(f"a.p{format}") and sorted(os.listdir(tmp_path)) == [f"a-0.{format}", f"a-1.{format}", f"a.p{format}"]
    data = load_table(spark, path, "cell_data").orderBy("piece").collect()
    assert [(r.piece, r.cell_id, r.c) for r in data] == [(0, 0, 0.0), (1, 0, 1.0)]
    assert load_table(spark, path, "points").where("piece = 1").count() == 4
    index, files = parallel_pieces(path)
    assert index.grid.get("GhostLevel") == "0" and len(files) == 2
    os.remove(tmp_path / f"a-1.{format}")
    assert load_table(spark, path, "points").where("piece = 0").count() == 4  # pruned: the other file isn't touched


def test_pieces_that_differ_are_refused(spark, tmp_path):
    path = write_mesh(pieced(spark), str(tmp_path / "a.pvtu"))
    other = pieced(spark)
    other.point_data = other.point_data.withColumnRenamed("p", "q")
    write_mesh(other, str(tmp_path / "b.pvtu"))
    os.replace(tmp_path / "b-1.vtu", tmp_path / "a-1.vtu")
    with pytest.raises(Exception, match="differ"):
        load_table(spark, path, "point_data").collect()


def test_border_points_are_of_the_later_piece(spark, tmp_path):
    frame = Frame([0, 2, 0, 1, 0, 0], {(0, 0): [0, 1, 0, 1, 0, 0], (0, 1): [1, 2, 0, 1, 0, 0]})
    data = spark.createDataFrame([(r, i + 3 * j, float(10 * r + i)) for r in (0, 1) for i in (r, r + 1) for j in (0, 1)], "piece int, point_id bigint, p double")
    path = write_mesh(Mesh("image", None, None, data, frame=frame), str(tmp_path / "a.pvti"))
    merged = structured_merge(load_table(spark, path, "point_data"), "point_id", ["p"])
    assert [r.p for r in merged.orderBy("point_id").collect()] == [0, 11, 12, 0, 11, 12]
    assert [r.cell_id for r in load_table(spark, path, "cells").orderBy("cell_id").collect()] == [0, 1]


def test_a_retried_task_leaves_one_file(spark, tmp_path):
    mesh = pieced(spark)
    write_mesh(mesh, str(tmp_path / "a.pvtu"))
    write_mesh(mesh, str(tmp_path / "a.pvtu"))
    assert not [f for f in os.listdir(tmp_path) if "_tmp" in f]


def test_missing_values_and_corners_are_errors(spark, tmp_path):
    mesh = pieced(spark)
    mesh.point_data = mesh.point_data.where("point_id > 0")
    with pytest.raises(Exception, match="missing values"):
        write_mesh(mesh, str(tmp_path / "a.pvtu"))
    mesh = pieced(spark)
    mesh.points = mesh.points.where("point_id > 0")
    mesh.point_data = None
    with pytest.raises(Exception, match="aren't among its points"):
        write_mesh(mesh, str(tmp_path / "b.pvtu"))
    assert issubclass(ValueProblem, MeshError)


def steps(spark, n=5):
    data = spark.createDataFrame([(s, i, float(s * i)) for s in range(n) for i in range(4)], "step int, point_id bigint, p double")
    return Mesh("image", None, None, data, frame=Frame([0, 3, 0, 0, 0, 0], {(s, 0): [0, 3, 0, 0, 0, 0] for s in range(n)}), times={s: s * 0.25 for s in range(n)})


def test_series(spark, tmp_path):
    path = write_mesh(steps(spark), str(tmp_path / "s.pvd"))
    assert series_steps(path) == [(s * 0.25, str(tmp_path / f"s-{s:05d}.vti")) for s in range(5)]
    assert [r.p for r in load_table(spark, path, "point_data").where("step = 3").orderBy("point_id").collect()] == [0, 3, 6, 9]
    assert [r.time for r in load_table(spark, path, "steps").orderBy("step").collect()] == [0, 0.25, 0.5, 0.75, 1]
    converted = convert(spark, path, str(tmp_path / "t.vtu"), encoder="ascii")
    assert converted.endswith("t.pvd") and VtkFile(str(tmp_path / "t-00004.vtu")).type == "UnstructuredGrid"
    assert load_table(spark, converted, "point_data").count() == 20
    with pytest.raises(InvalidState):
        convert(spark, path, path)


def test_series_of_pieces_and_equal_times(spark, tmp_path):
    writer = SeriesWriter(str(tmp_path / "w.pvd"))
    for number, time in ((0, 0.0), (1, 1.0), (1, 1.0), (2, 1.0)):
        writer.write_step(number, time, pieced(spark))
    path = str(tmp_path / "w.pvd")
    assert [t for t, _ in series_steps(path)] == [0.0, 1.0, 1.0]
    grouped = load_table(spark, path, "points", group_times="true")
    assert sorted((r.step, r.piece) for r in grouped.select("step", "piece").distinct().collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (1, 3)]
    assert load_table(spark, path, "points").select("step", "piece").distinct().count() == 6


def test_stream_reader_follows_a_collection(spark, tmp_path):
    path = write_mesh(steps(spark, 2), str(tmp_path / "s.pvd"))
    schema = load_table(spark, path, "point_data").schema
    reader = SeriesStreamReader(path, "point_data", schema)
    first = reader.latestOffset()
    assert first == {"step": 2} and [p.step for p in reader.partitions(reader.initialOffset(), first)] == [0, 1]
    write_mesh(steps(spark, 3), str(tmp_path / "s.pvd"))
    new = reader.partitions(first, reader.latestOffset())
    assert [b.num_rows for b in reader.read(new[0])] == [4] and [p.step for p in new] == [2]


def test_stream(spark, tmp_path):
    from meshweave.operators.mesh import register

    path = write_mesh(steps(spark, 3), str(tmp_path / "s.pvd"))
    register(spark)
    stream = spark.readStream.format("meshfile").options(table="point_data").load(path)
    query = stream.writeStream.format("memory").queryName("mesh_rows").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.table("mesh_rows").count() == 12


def test_precision_is_kept(spark, tmp_path):
    mesh = pieced(spark)
    mesh.point_data = mesh.point_data.select("piece", "point_id", F.col("point_id").cast("short").alias("u"))
    path = write_mesh(mesh, str(tmp_path / "a.pvtu"), precision={"u": "UInt8"})
    assert stored_precision(load_table(spark, path, "point_data")) == {"u": "UInt8"}
    again = convert(spark, path, str(tmp_path / "b.vtu"))
    assert load_table(spark, again, "field_info").where("name = 'u'").first().precision == "UInt8"


def test_info_and_command_line(spark, tmp_path, capsys):
    path = write_mesh(with_fields(image_grid(spark, [1.0, 1.0], [2, 2])), str(tmp_path / "a.vti"))
    grid, fields = info(spark, path)
    row = grid.first()
    assert (row.kind, row.n_points, row.n_cells, row.extent, row.spacing) == ("image", 9, 4, [0, 2, 0, 2, 0, 0], [0.5, 0.5, 1.0])
    assert {(r.name, r.precision, tuple(r.layout)) for r in fields.collect()} == {("p", "Float64", (9,)), ("v", "Float64", (9, 3)), ("f", "Float32", (9,))}
    assert main(["convert", path, "vtu", "-o", str(tmp_path / "b"), "encoder=ascii"], spark) == 0
    assert main(["info", str(tmp_path / "b.vtu")], spark) == 0
    assert "unstructured" in capsys.readouterr().out
    for k in (0, 2, 10):
        (tmp_path / f"r-{k}.vtu").touch()
    assert expand(str(tmp_path / "r-{RANK}.vtu")) == [str(tmp_path / f"r-{k}.vtu") for k in (0, 2, 10)]
    assert expand(str(tmp_path / "r-{RANK:2}.vtu")) == [str(tmp_path / "r-10.vtu")]


def test_benchmark_grid_has_all_points(tmp_path):
    from meshweave.sources.vtkxml import Grid, WriteOptions, structured_cells as cells_of, structured_indices, write_grid

    names, corners, ends = cells_of([0, 50, 0, 50, 0, 0], True)
    points = structured_indices([0, 50, 0, 50, 0, 0]).astype(float)
    grid = Grid("unstructured", {"p": points[:, 0]}, {"c": np.arange(2500.0)}, {}, points, names, corners, ends)
    write_grid(str(tmp_path / "b.vtu"), "vtu", grid, WriteOptions.of())
    file = VtkFile(str(tmp_path / "b.vtu"))
    assert file.number_of_points(file.pieces[0]) == 2601 and file.number_of_cells(file.pieces[0]) == 2500


def test_micro_batches_become_steps(spark, tmp_path):
    from meshweave.streaming.series import append_steps

    for k in range(2):
        spark.range(4).selectExpr("id AS point_id", f"double(id * {k + 1}) AS p").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("point_id bigint, p double").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))

    def make_mesh(batch):
        data = batch.groupBy("point_id").agg(F.sum("p").alias("p"))
        return 0.5, Mesh("image", None, None, data, frame=Frame([0, 3, 0, 0, 0, 0]))

    path = str(tmp_path / "out.pvd")
    query = append_steps(stream, make_mesh, path, str(tmp_path / "checkpoint"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert series_steps(path) == [(0.5, str(tmp_path / "out-00000.vti"))]
    assert [r.p for r in load_table(spark, path, "point_data").orderBy("point_id").collect()] == [0, 3, 6, 9]


def test_benchmark_script_knows_its_queries():
    import bench

    from meshweave.plans.catalog import QUERIES

    assert set(bench.HEADLINE) <= set(QUERIES)


def test_paths_with_a_scheme(spark, tmp_path):
    path = f"file://{tmp_path}/g.vtu"
    for cells in ([3, 2], [5, 4]):  # written again: headers of the first version are no longer used
        assert write_mesh(with_fields(image_grid(spark, [1.0, 1.0], cells)), path) == path
        assert load_table(spark, path, "cells").count() == cells[0] * cells[1]
        assert os.listdir(tmp_path) == ["g.vtu"]
    series = f"file://{tmp_path}/s.pvd"
    for k in range(2):  # a new writer knows earlier steps
        SeriesWriter(series).write_step(k, 0.5 * k, with_fields(image_grid(spark, [1.0, 1.0], [3, 2])))
    assert [t for t, _ in series_steps(series)] == [0.0, 0.5]
    reader = SeriesStreamReader(series, "steps", load_table(spark, series, "steps").schema)
    assert reader.latestOffset() == {"step": 2}
