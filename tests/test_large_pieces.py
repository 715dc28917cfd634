"""Large pieces are written in parts and read by ranges of rows: the same files and rows as at once."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from meshweave.operators import mesh as meshes
from meshweave.operators.mesh import Mesh, load_table, write_mesh
from meshweave.plans import tables
from meshweave.sources import meshfile, vtkxml
from meshweave.sources.vtkxml import Grid, WriteOptions, write_grid

SF = "/root/testdata/sf0.001"
WAYS = [{"encoder": "ascii"}] + [{"encoder": e, "data_format": f, "compressor": c} for e, f in (("raw", "appended"), ("base64", "appended"), ("base64", "inlined")) for c in (None, "zlib", "lzma", "lz4")]
TABLES = ("points", "point_data", "cells", "cell_data")


def a_grid(format, n=37):
    rng = np.random.default_rng(5)
    whole = [0, n - 1, 0, 2, 0, 0]
    points = n if vtkxml.FORMATS[format][1] == "unstructured" else 3 * n
    cells = n if vtkxml.FORMATS[format][1] == "unstructured" else 2 * (n - 1)
    sizes = rng.integers(1, 6, n)
    types = [{1: "vertex", 2: "segment", 3: "triangle", 4: "quadrilateral"}.get(s, "polygon") for s in sizes]
    return Grid(
        vtkxml.FORMATS[format][1], {"a": rng.random(points), "v": rng.random((points, 2))}, {"b": rng.integers(-9, 9, cells), "c": rng.integers(0, 9, cells).astype(np.int16)}, {"title": "x"},
        rng.random((points, 3)), types, rng.integers(0, n, sizes.sum()), np.r_[0, np.cumsum(sizes)], whole, whole, ordinates=[np.arange(n) * 0.5, np.arange(3) * 2.0, np.zeros(1)],
    )


def rows(path, split):
    out = {}
    for name in TABLES:
        schema = meshfile.table_schema(path, name, None)
        parts = meshfile.mesh_parts(path)
        parts = meshfile.split_parts(parts, name, schema.names) if split else parts
        out[name] = pa.Table.from_batches([b for part in parts for b in meshfile.read_part(part, name, schema)]).to_pylist()
        assert not split or len(parts) > 2
    return out


@pytest.mark.parametrize("format", list(vtkxml.FORMATS))
@pytest.mark.parametrize("way", WAYS, ids=lambda w: "-".join(map(str, w.values())))
def test_ranges_of_rows(tmp_path, monkeypatch, format, way):
    path = str(tmp_path / f"grid.{format}")
    write_grid(path, format, a_grid(format), WriteOptions.of(**way, block_bytes=64))
    expected = rows(path, False)
    for kept in (10, 1 << 16):
        monkeypatch.setattr(vtkxml, "_KEPT_TEXT", kept)
        monkeypatch.setattr(vtkxml, "MARK_EVERY", 8)
        monkeypatch.setattr(vtkxml, "_CHUNK", 50)
        monkeypatch.setattr(meshfile, "PART_ROWS", 7)
        meshfile._parsed.cache_clear()
        assert rows(path, True) == expected
    meshfile._parsed.cache_clear()


def test_long_texts_stay_in_the_file(tmp_path):
    """Headers of files with inlined arrays don't grow with these."""
    for way in ({"encoder": "ascii"}, {"encoder": "base64", "data_format": "inlined", "compressor": None}):
        path = str(tmp_path / f"{way['encoder']}.vtu")
        write_grid(path, "vtu", a_grid("vtu", 80_000), WriteOptions.of(**way))
        head, _, _ = vtkxml._read_head(path)
        assert len(head) < 20_000
        file = vtkxml.VtkFile(path)
        a = file.pieces[0].sections["PointData"]["a"]
        assert a.span and (file.some(a, 30_000, 30_010) == file.values(a)[30_000:30_010]).all()


@pytest.mark.parametrize("compressor", [None, "zlib"])
def test_long_base64_as_others_write_it(tmp_path, monkeypatch, compressor):
    """Indented, in lines, and with a header that goes on into the data."""
    path = str(tmp_path / "grid.vtu")
    write_grid(path, "vtu", a_grid("vtu"), WriteOptions.of(encoder="base64", data_format="inlined", compressor=compressor, block_bytes=64))
    expected = rows(path, False)
    text = open(path).read()
    together = lambda s: vtkxml.codecs.base64.b64encode(b"".join(vtkxml.codecs.base64.b64decode(x) for x in re.findall(r"[^=]+=*", s))).decode()
    in_lines = lambda s: "\n".join(s[k : k + 60] for k in range(0, len(s), 60))
    monkeypatch.setattr(vtkxml, "_KEPT_TEXT", 10)
    monkeypatch.setattr(meshfile, "PART_ROWS", 7)
    for k, change in enumerate((lambda s: f"\n      {s}\n    ", lambda s: f"\n{in_lines(s)}\n", lambda s: f"\n  {together(s)}\n" if s.count("=") else s)):
        other = str(tmp_path / f"other-{k}.vtu")
        with open(other, "w") as f:
            f.write(re.sub(r'(format="binary">)([^<]+)', lambda m: m[1] + change(m[2]), text))
        assert rows(other, True) == expected


@pytest.mark.parametrize("ext", ["vtu", "vtp", "pvtu", "vti", "vtr", "vts"])
def test_parts_make_the_same_files(spark, tmp_path, monkeypatch, ext):
    kind = {"vti": "image", "vtr": "rectilinear", "vts": "structured"}.get(ext)
    mesh = tables.part_grid(spark, SF, kind) if kind else tables.pieced_order_mesh(spark, SF) if ext == "pvtu" else tables.order_mesh(spark, SF)
    ways = [WAYS[k] for k in ((0, 1, 6, 8, 9, 11) if ext == "vtu" else (0, 5) if ext in ("vtp", "pvtu") else (8,))]
    for k, way in enumerate(ways):
        way = way | {"block_bytes": 8} | ({"header_type": "UInt32"} if k % 2 else {})
        files = []
        for name, large in (("whole", 500_000), ("parts", 60)):
            monkeypatch.setattr(meshes, "LARGE_PIECE", large)
            monkeypatch.setattr(vtkxml, "CHUNK_ROWS", 100)
            folder = tmp_path / f"{k}-{name}"
            write_mesh(mesh, str(folder / f"m.{ext}"), **way)
            files.append({p.name: p.read_bytes() for p in folder.iterdir()})
        assert files[0] == files[1] and len(files[0]) == (5 if ext == "pvtu" else 1)


def test_large_and_small_pieces_and_a_piece_without_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vtkxml, "CHUNK_ROWS", 15)
    points = spark.createDataFrame([(p, k, k * 0.5, 0.0, 1.0) for p, n in ((0, 100), (1, 5), (2, 90)) for k in range(n)], "piece int, point_id long, x double, y double, z double")
    cells = spark.createDataFrame([(p, k, "segment", [k, k + 1]) for p, n in ((0, 99), (1, 4)) for k in range(n)], "piece int, cell_id long, cell_type string, corners array<long>")
    mesh = Mesh("unstructured", points, cells, points.select("piece", "point_id", (points.x * 2).alias("twice")), cells.select("piece", "cell_id", (cells.cell_id % 3).alias("third")))
    files = []
    for name, large in (("whole", 500_000), ("parts", 50)):
        monkeypatch.setattr(meshes, "LARGE_PIECE", large)
        path = write_mesh(mesh, str(tmp_path / name / "m.pvtu"), encoder="raw", compressor=None)
        files.append({p.name: p.read_bytes() for p in (tmp_path / name).iterdir()})
        assert load_table(spark, path, "cells").count() == 103
    assert files[0] == files[1]


def test_corners_without_points_are_errors_in_parts_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(meshes, "LARGE_PIECE", 3)
    points = spark.range(9).selectExpr("id AS point_id", "0.0D AS x", "0.0D AS y", "0.0D AS z")
    cells = spark.createDataFrame([(0, "segment", [0, 1]), (1, "segment", [3, 77])], "cell_id long, cell_type string, corners array<long>")
    with pytest.raises(Exception, match="cells have corners that aren't among its points"):
        write_mesh(Mesh("unstructured", points, cells), str(tmp_path / "m.vtu"))
    with pytest.raises(Exception, match="missing values"):
        write_mesh(Mesh("unstructured", points, None, points.selectExpr("point_id", "nullif(point_id, 5) AS f")), str(tmp_path / "m.vtu"))


def test_unlike_all_values_of_a_long_text(tmp_path):
    """A reader of ranges refuses what isn't numbers."""
    path = str(tmp_path / "grid.vtu")
    write_grid(path, "vtu", a_grid("vtu", 40_000), WriteOptions.of(encoder="ascii"))
    text = open(path).read()
    with open(path, "w") as f:
        at = text.index('Name="a"')
        f.write(text[:at] + text[at:].replace(" 0.", " &#48;.", 3))
    with pytest.raises(vtkxml.FileProblem, match="only numbers"):
        vtkxml.VtkFile(path)


