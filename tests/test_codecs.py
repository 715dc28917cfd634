"""Encodings and compressors, files of every legal combination, and foreign variants made by hand."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pytest

from meshweave.errors import FileProblem, MeshError, NotImplementedHere, SizeProblem, ValueProblem
from meshweave.sources import codecs
from meshweave.sources.meshfile import extension
from meshweave.sources.vtkxml import Grid, VtkFile, WriteOptions, structured_cells, write_grid

COMBINATIONS = [("ascii", "inlined", None)]
COMBINATIONS += [(e, d, c) for e, d in (("base64", "inlined"), ("base64", "appended"), ("raw", "appended")) for c in (None, "zlib", "lzma", "lz4")]


def mesh():
    rng = np.random.default_rng(1)
    return Grid(
        "unstructured",
        {"p": np.arange(9.0), "v": rng.random((9, 2)), "t": rng.random((9, 2, 2)), "f": np.arange(9, dtype=np.float32)},
        {"c": np.array([5, 7, 9], np.int32), "u": np.array([1, 2, 250], np.uint8), "b": np.array([True, False, True])},
        {"title": "some_literal_text", "numbers": [1.0, 2.0]},
        rng.random((9, 3)), ["polygon", "segment", "quadrilateral"], np.array([4, 5, 6, 7, 8, 0, 1, 0, 1, 2, 3]), np.array([0, 5, 7, 11]),
    )


@pytest.mark.parametrize("header", ["UInt32", "UInt64"])
@pytest.mark.parametrize("block", [100, codecs.BLOCK_BYTES])
@pytest.mark.parametrize(("encoder", "data_format", "compressor"), COMBINATIONS)
def test_vtu_combinations(tmp_path, encoder, data_format, compressor, block, header):
    path, g = str(tmp_path / "a.vtu"), mesh()
    write_grid(path, "vtu", g, WriteOptions(encoder, data_format, compressor, header, block_bytes=block))
    file = VtkFile(path)
    piece = file.pieces[0]
    near = {"rtol": 1e-14} if encoder == "ascii" else {"rtol": 0, "atol": 0}
    np.testing.assert_allclose(file.points(piece), g.points, **near)
    types, corners, ends = file.cells(piece)
    assert (types, corners.tolist(), ends.tolist()) == (g.types, g.corners.tolist(), g.offsets.tolist())
    fields = {n: file.values(a) for s in ("PointData", "CellData") for n, a in piece.sections[s].items()}
    np.testing.assert_allclose(fields["p"], g.point_fields["p"], **near)
    np.testing.assert_allclose(fields["v"][:, :2], g.point_fields["v"], **near)
    assert (fields["v"][:, 2] == 0).all()
    assert fields["t"].shape == (9, 9) and (fields["t"][:, [2, 5, 6, 7, 8]] == 0).all()
    assert fields["u"].tolist() == [1, 2, 250] and fields["b"].tolist() == [1, 0, 1] and fields["c"].dtype == np.int32
    assert file.values(file.meta["title"], 1).astype(np.uint8).tobytes() == b"some_literal_text\0"


@pytest.mark.parametrize(("encoder", "data_format", "compressor"), COMBINATIONS)
def test_vtp_groups_cells_and_their_data(tmp_path, encoder, data_format, compressor):
    path, g = str(tmp_path / "a.vtp"), mesh()
    write_grid(path, "vtp", g, WriteOptions(encoder, data_format, compressor))
    file = VtkFile(path)
    types, corners, ends = file.cells(file.pieces[0])
    assert types == ["segment", "polygon", "quadrilateral"]
    assert corners.tolist() == [0, 1, 4, 5, 6, 7, 8, 0, 1, 2, 3] and ends.tolist() == [0, 2, 7, 11]
    assert file.values(file.pieces[0].sections["CellData"]["c"]).tolist() == [7, 5, 9]


def test_illegal_combinations():
    for encoder, data_format in (("raw", "inlined"), ("ascii", "appended"), ("hex", "inlined")):
        with pytest.raises(ValueProblem):
            WriteOptions(encoder, data_format, None)
    with pytest.raises(ValueProblem):
        WriteOptions("raw", "appended", "zip")
    assert WriteOptions.of("ascii", compressor="zlib").compressor is None


def hand_made(byte_order, payload, header="", compressor="", extra=""):
    return f"""<VTKFile type="UnstructuredGrid" version="1.0" byte_order="{byte_order}" {header} {compressor}><UnstructuredGrid>
<Piece NumberOfPoints="2" NumberOfCells="1"><PointData>{payload}</PointData><CellData></CellData><Points>
<DataArray type="Float32" NumberOfComponents="3" format="ascii">0 0 0 1 0 0</DataArray></Points><Cells>
<DataArray type="Int64" Name="connectivity" format="ascii">0 1</DataArray><DataArray type="Int64" Name="offsets" format="ascii">2</DataArray>
<DataArray type="UInt8" Name="types" format="ascii">3</DataArray></Cells></Piece></UnstructuredGrid>{extra}</VTKFile>"""


def read_field(tmp_path, text, name="p"):
    path = tmp_path / "hand.vtu"
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    file = VtkFile(str(path))
    return file.values(file.pieces[0].sections["PointData"][name], 2).tolist()


def test_big_endian_raw_appended(tmp_path):
    text = hand_made("BigEndian", '<DataArray type="Float64" Name="p" format="appended" offset="0"/>', 'header_type="UInt32"', extra='<AppendedData encoding="raw">_@@</AppendedData>')
    raw = struct.pack(">I2d", 16, 1.5, -2.0)
    assert read_field(tmp_path, text.encode().replace(b"@@", raw)) == [1.5, -2.0]


def test_base64_encoded_together_with_its_header(tmp_path):
    joint = base64.b64encode(struct.pack("<I2d", 16, 1.5, -2.0)).decode()
    assert read_field(tmp_path, hand_made("LittleEndian", f'<DataArray type="Float64" Name="p" format="binary">{joint}</DataArray>', 'header_type="UInt32"')) == [1.5, -2.0]
    body = zlib.compress(struct.pack("<2d", 1.5, -2.0))
    for parts in ([struct.pack("<4I", 1, 16, 0, len(body)) + body], [struct.pack("<4I", 1, 16, 0, len(body)), body]):
        text = "".join(base64.b64encode(p).decode() for p in parts)
        field = f'<DataArray type="Float64" Name="p" format="binary">{text}</DataArray>'
        assert read_field(tmp_path, hand_made("LittleEndian", field, 'header_type="UInt32"', 'compressor="vtkZLibDataCompressor"')) == [1.5, -2.0]


def test_version_without_header_type(tmp_path):
    text = hand_made("LittleEndian", '<DataArray type="Float64" Name="p" format="ascii">1 2</DataArray>')
    with pytest.raises(FileProblem):
        read_field(tmp_path, text)
    assert read_field(tmp_path, text.replace('version="1.0"', 'version="0.1"')) == [1, 2]


def test_broken_files(tmp_path):
    with pytest.raises(FileProblem):
        VtkFile(str(tmp_path / "missing.vtu"))
    (tmp_path / "b.vtu").write_text("<VTKFile")
    with pytest.raises(FileProblem):
        VtkFile(str(tmp_path / "b.vtu"))
    with pytest.raises(SizeProblem):
        read_field(tmp_path, hand_made("LittleEndian", '<DataArray type="Float64" Name="p" format="ascii">1</DataArray>', 'header_type="UInt32"'))
    with pytest.raises(FileProblem):
        extension("a.txt")
    with pytest.raises(NotImplementedHere, match="h5py"):
        extension("a.hdf")
    assert issubclass(SizeProblem, MeshError) and issubclass(SizeProblem, ValueError)


def test_empty_arrays(tmp_path):
    for compressor in (None, "zlib", "lzma", "lz4"):
        g = Grid("unstructured", {"p": np.zeros(0)}, {}, {}, np.zeros((0, 3)), [], np.zeros(0, np.int64), np.zeros(1, np.int64))
        for encoder in ("raw", "base64"):
            write_grid(str(tmp_path / "e.vtu"), "vtu", g, WriteOptions(encoder, "appended", compressor))
            file = VtkFile(str(tmp_path / "e.vtu"))
            assert len(file.points(file.pieces[0])) == 0 and file.cells(file.pieces[0])[0] == []


@pytest.mark.parametrize(("extent", "expected"), [
    ([0, 2, 0, 0, 0, 0], ["segment", [0, 1], [1, 2]]),
    ([0, 1, 0, 2, 0, 0], ["quadrilateral", [0, 1, 3, 2], [2, 3, 5, 4]]),
    ([0, 0, 0, 1, 0, 2], ["quadrilateral", [0, 1, 3, 2], [2, 3, 5, 4]]),
    ([0, 1, 0, 0, 0, 1], ["quadrilateral", [0, 1, 3, 2]]),
    ([0, 1, 0, 1, 0, 1], ["hexahedron", [0, 1, 3, 2, 4, 5, 7, 6]]),
])
def test_structured_cells_in_all_planes(extent, expected):
    names, corners, ends = structured_cells(extent, False)
    assert names[0] == expected[0]
    assert [corners[ends[i] : ends[i + 1]].tolist() for i in range(len(names))] == expected[1:]
