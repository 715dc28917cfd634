"""Field algebra, layouts, grids, transforms and pieces against values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshweave.errors import NotImplementedHere, SizeProblem, ValueProblem
from meshweave.functions import arrays
from meshweave.functions.cells import CELL_TYPES, cell_name, cell_type_table
from meshweave.functions.layout import Layout, flat_index_first_fastest, flat_index_last_fastest, grid_dimension, inverse_index, number_of_entities
from meshweave.operators import grids, pieces, topology, transforms
from meshweave.operators.mesh import Mesh

VECTOR, TENSOR = T.ArrayType(T.DoubleType()), T.ArrayType(T.ArrayType(T.DoubleType()))


@pytest.fixture
def field(spark):
    return spark.createDataFrame([(0, [2.0, 3.0]), (1, [4.0, 5.0])], "id bigint, v array<double>")


def values(df, column="v"):
    return [r[column] for r in df.orderBy(df.columns[0]).collect()]


def test_extend(field):
    assert values(field.select("id", arrays.extend(F.col("v"), VECTOR, [3]).alias("v"))) == [[2, 3, 0], [4, 5, 0]]
    assert values(field.select("id", arrays.extend_all(F.col("v"), VECTOR, 3).alias("v"))) == [[2, 3, 0], [4, 5, 0]]
    with pytest.raises(SizeProblem):
        arrays.extend(F.col("id"), T.LongType(), [3])
    with pytest.raises(SizeProblem):
        arrays.extend(F.col("v"), VECTOR, [3, 3])
    with pytest.raises(Exception, match="shrink"):
        field.select(arrays.extend(F.col("v"), VECTOR, [1])).collect()


def test_extend_and_flatten(field):
    longer = field.select("id", arrays.extend(F.col("v"), VECTOR, [3]).alias("v"))
    assert [r.value for r in arrays.flatten_field(longer, "id", "v", 3).orderBy("entry").collect()] == [2, 3, 0, 4, 5, 0]


def test_tensors(spark):
    t = spark.createDataFrame([(0, [[1.0, 2.0], [3.0, 4.0]])], "id bigint, v array<array<double>>")
    assert values(t.select("id", arrays.extend_all(F.col("v"), TENSOR, 3).alias("v"))) == [[[1, 2, 0], [3, 4, 0], [0, 0, 0]]]
    assert values(t.select("id", arrays.pad_to_3d(F.col("v"), TENSOR).alias("v"))) == [[[1, 2, 0], [3, 4, 0], [0, 0, 0]]]
    assert values(t.select("id", arrays.transpose(F.col("v")).alias("v"))) == [[[1, 3], [2, 4]]]


def test_slice_and_merge(spark, field):
    second = spark.createDataFrame([(0, [2.0, 42.0]), (1, [2.0, 43.0])], "id bigint, v array<double>")
    assert values(arrays.slice_field(second, "id", "v", (0, 1), (2, 2))) == [[42], [43]]
    assert values(arrays.merge_fields([field, second], [2, 2], "id")) == [[2, 3], [4, 5], [2, 42], [2, 43]]
    with pytest.raises(SizeProblem):
        arrays.slice_field(second, "id", "v", (0,), (1,))
    with pytest.raises(SizeProblem):
        arrays.slice_field(second, "id", "v", (0, 1), (2, 0))
    with pytest.raises(ValueProblem):
        arrays.merge_fields([], [], "id")
    with pytest.raises(ValueProblem):
        arrays.merge_fields([field, field.select("id", F.element_at("v", 1).alias("v"))], [2, 2], "id")


def test_reshape_cast_dot(field):
    assert values(field.select("id", arrays.reshape(F.col("v"), (2, 1), 2).alias("v"))) == [[[2], [3]], [[4], [5]]]
    with pytest.raises(SizeProblem):
        arrays.reshape(F.col("v"), (3, 1), 2)
    assert values(field.select("id", arrays.dot_product(F.col("v"), F.col("v")).alias("v"))) == [13, 41]
    assert values(field.select("id", arrays.cast_field(F.transform("v", lambda x: x + 0.9), VECTOR, T.IntegerType()).alias("v"))) == [[2, 3], [4, 5]]


def test_layouts():
    layout = Layout((3, 2, 2))
    assert layout.entries() == 12 and layout.entries(1) == 4 and layout.sub_layout() == (2, 2) and layout.with_sub_layout((3,)) == (3, 2, 3)
    with pytest.raises(SizeProblem):
        layout.entries(3)
    assert list(Layout((2, 2)).indices()) == [(0, 0), (1, 0), (0, 1), (1, 1)]
    assert Layout(()).entries() == 1 and number_of_entities([4, 0, 0]) == 4 and grid_dimension([4, 0, 2]) == 2


def test_flat_indices(spark):
    df = spark.createDataFrame([(1, 2, 3)], "i bigint, j bigint, k bigint")
    index = [F.col(c) for c in "ijk"]
    row = df.select(flat_index_first_fastest(index, [4, 5, 6]).alias("a"), flat_index_last_fastest(index, [4, 5, 6]).alias("b")).first()
    assert (row.a, row.b) == (1 + 4 * 2 + 20 * 3, (1 * 5 + 2) * 6 + 3)
    back = spark.createDataFrame([(69,)], "n bigint").select(*inverse_index(F.col("n"), [4, 5, 6])).first()
    assert tuple(back) == (1, 2, 3)


def test_cell_types(spark):
    assert len(CELL_TYPES) == 15 and cell_type_table(spark).count() == 15 and cell_name(72) == "lagrange_hexahedron"
    for unknown in (13, 14, 6):
        with pytest.raises(NotImplementedHere):
            cell_name(unknown)


def test_image_grid(spark):
    mesh = grids.image_grid(spark, [1.0, 1.0], [10, 12])
    assert (mesh.points.count(), mesh.cells.count(), mesh.default_format()) == (143, 120, "vti")
    last = mesh.points.orderBy(F.desc("point_id")).first()
    assert (last.x, last.y, last.z) == (1.0, 1.0, 0.0)
    first = mesh.cells.orderBy("cell_id").first()
    assert (first.cell_type, first.corners) == ("pixel", [0, 1, 11, 12])
    with pytest.raises(ValueProblem):
        grids.image_grid(spark, [1.0, 1.0], [10, 0])
    with pytest.raises(NotImplementedHere):
        grids.structured_cells(spark, [0, 0, 0])
    assert spark.range(1).select(grids.axis_orientation(F.array(F.lit(-1.0), F.lit(0.0), F.lit(2.0))).alias("a")).first().a == [True, True, False]
    assert [round(x, 9) for x in spark.range(1).select(grids.ordinates(1, 0.5, 2).alias("o")).first().o] == [1.0, 1.5, 2.0]


def test_rectilinear_grid(spark):
    mesh = grids.rectilinear_grid(spark, [[0, 1, 4], [0, 2]])
    rows = mesh.points.orderBy("point_id").collect()
    assert [(r.x, r.y) for r in rows] == [(0, 0), (1, 0), (4, 0), (0, 2), (1, 2), (4, 2)]
    assert mesh.cells.orderBy("cell_id").first().corners == [0, 1, 3, 4]


@pytest.fixture
def two_d(spark):
    xy = [(0, 0), (1, 0), (1, 1), (0, 1), (2, 1), (2, 0), (2.5, 0.25), (2.75, 0.5), (2.5, 0.75)]
    points = spark.createDataFrame([(100 - i, float(x), float(y), 0.0) for i, (x, y) in enumerate(xy)], "point_id bigint, x double, y double, z double")
    cells = spark.createDataFrame([(i, t, [100 - c for c in corners]) for i, (t, corners) in enumerate([("quadrilateral", [0, 1, 2, 3]), ("triangle", [1, 2, 4]), ("polygon", [4, 5, 6, 7, 8])])], "cell_id bigint, cell_type string, corners array<bigint>")
    return Mesh("unstructured", points, cells, points.select("point_id", (F.col("x") * 2).alias("p")), cells.select("cell_id", (F.col("cell_id") * 10).alias("c")))


def test_topology(two_d):
    ids = topology.point_id_map(two_d.points)
    assert [tuple(r) for r in ids.orderBy("point_id").collect()] == [(92 + i, i) for i in range(9)]
    assert [r.offset for r in topology.offsets(two_d.cells).orderBy("cell_id").collect()] == [4, 7, 12]
    assert [r["index"] for r in topology.connectivity(two_d.cells, ids).where("cell_id = 1").orderBy("pos").collect()] == [7, 6, 4]
    assert tuple(topology.counts(two_d.points, two_d.cells).first()) == (9, 3, 12)
    assert [r.vtk_type for r in topology.cell_types_column(two_d.cells).orderBy("cell_id").collect()] == [9, 5, 7]
    center = topology.cell_centers(two_d.cells, two_d.points).where("cell_id = 0").first()
    assert (center.x, center.y) == (0.5, 0.5)


def test_filter_and_discontinuous(two_d):
    kept = transforms.filter_cells(two_d, transforms.of_types("triangle", "polygon"))
    assert kept.cells.count() == 2 and kept.points.count() == 9 and [r.c for r in kept.cell_data.orderBy("c").collect()] == [10, 20]
    apart = transforms.make_discontinuous(two_d)
    assert apart.points.count() == 12 and [r.corners for r in apart.cells.orderBy("cell_id").collect()] == [[0, 1, 2, 3], [4, 5, 6], [7, 8, 9, 10, 11]]
    assert [r.p for r in apart.point_data.orderBy("point_id").limit(5).collect()] == [0, 2, 2, 0, 2]


def test_polylines(spark):
    cells = spark.createDataFrame([(0, "polyline", [0, 1, 2]), (1, "vertex", [5]), (2, "polyline", [3, 4])], "cell_id bigint, cell_type string, corners array<bigint>")
    out = transforms.subdivide_polylines(Mesh("unstructured", None, cells, None, cells.select("cell_id", (F.col("cell_id") * 10).alias("c"))))
    assert [(r.cell_type, r.corners) for r in out.cells.orderBy("cell_id").collect()] == [("segment", [0, 1]), ("segment", [1, 2]), ("vertex", [5]), ("segment", [3, 4])]
    assert [r.c for r in out.cell_data.orderBy("cell_id").collect()] == [0, 0, 10, 20]


def test_pieces(spark):
    points = spark.createDataFrame([(p, i) for p in (0, 1) for i in range(3)], "piece int, point_id bigint")
    cells = spark.createDataFrame([(0, 0, [0, 1]), (1, 0, [1, 2])], "piece int, cell_id bigint, corners array<bigint>")
    merged_points, merged_cells = pieces.unstructured_merge(points, cells)
    assert sorted(r.point_id for r in merged_points.collect()) == list(range(6))
    assert [(r.cell_id, r.corners) for r in merged_cells.orderBy("cell_id").collect()] == [(0, [0, 1]), (1, [4, 5])]
    data = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)], "point_id bigint, piece int, v double")
    assert [tuple(r) for r in pieces.structured_merge(data, "point_id", ["v"]).orderBy("point_id").collect()] == [(0, 2.0), (1, 3.0)]
    layout = spark.createDataFrame([(0, 0.0, 0.0, 4, 5), (1, 1.0 + 1e-12, 0.0, 4, 5), (2, 0.0, 1.0, 4, 6), (3, 1.0, 1.0, 4, 6)], "piece int, o0 double, o1 double, e0 bigint, e1 bigint")
    placed = pieces.piece_layout(layout, 2)
    assert [(r.r0, r.r1, r.f0, r.f1) for r in placed.orderBy("piece").collect()] == [(0, 0, 0, 0), (1, 0, 4, 0), (0, 1, 0, 5), (1, 1, 4, 5)]
    assert tuple(pieces.whole_extent(placed, 2).first()) == (8, 11)
    one = spark.createDataFrame([(p, p * p) for p in range(4)], "piece int, v bigint")
    assert tuple(pieces.reduce_all(one, "v").first()) == (9, 0, 14) and pieces.gather_in_order(one, "v").first().gathered == [0, 1, 4, 9]
    assert [r.share for r in pieces.scatter(pieces.gather_in_order(one, "v"), "gathered", 2).orderBy("piece").collect()] == [[0, 1], [4, 9]]
