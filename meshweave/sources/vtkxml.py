"""VTK-XML files in plain Python and numpy: headers, lazily decoded arrays, and writing."""

from __future__ import annotations

import math
import os
import posixpath
import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from dataclasses import dataclass, field
from xml.sax.saxutils import quoteattr

import numpy as np

from ..errors import FileProblem, NotImplementedHere, SizeProblem, ValueProblem
from ..functions.cells import CELL_TYPES, cell_name
from . import codecs

#: File extension, root type and kind of grid of each serial format.
FORMATS = {
    "vtu": ("UnstructuredGrid", "unstructured"),
    "vtp": ("PolyData", "unstructured"),
    "vti": ("ImageData", "image"),
    "vtr": ("RectilinearGrid", "rectilinear"),
    "vts": ("StructuredGrid", "structured"),
}
DEFAULT_FORMAT = {"image": "vti", "rectilinear": "vtr", "structured": "vts", "unstructured": "vtu"}
_TYPE_TO_FORMAT = {t: f for f, (t, _) in FORMATS.items()}
#: Groups of poly data in the order of their cells, with the types that go there.
POLY_GROUPS = {"Verts": ("vertex",), "Lines": ("segment", "polyline"), "Polys": ("triangle", "quadrilateral", "pixel", "polygon")}
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
_CHUNK = 1 << 20
#: Texts of arrays that are longer stay in the file; of ascii ones the place of every so-manieth value is noted.
_KEPT_TEXT, MARK_EVERY = 1 << 16, 1 << 18
#: About as many rows of an array are encoded at once where pieces are large.
CHUNK_ROWS = 500_000
_TAG = re.compile(rb"<(DataArray|AppendedData)[\s/>]")
_TAG_END = re.compile(rb"""<\w+(?:[^"'>]|"[^"]*"|'[^']*')*>""")


def open_file(path: str, mode: str = "rb"):
    """A file of the local or of any file system that pyarrow knows by its scheme."""
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner) if "r" in mode else system.open_output_stream(inner)
    return open(path.removeprefix("file:"), mode)


def file_stamp(path: str) -> tuple[int, int] | None:
    """Time of change and size of a file of any file system, which tell versions of it apart; None if there is none."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = system.get_file_info(inner)
    return (info.mtime_ns or 0, info.size or 0) if info.type != fs.FileType.NotFound else None


@dataclass
class Array:
    """A DataArray's header: where its values are and how they are stored.

    A long text isn't held: span is its place in the file, blanks the white space in it, and marks are the places of
    every MARK_EVERY-th value of an ascii one.
    """

    name: str
    type: str
    components: int
    tuples: int | None
    encoding: str  # ascii, binary or appended
    text: str | None = None
    offset: int = 0
    span: tuple[int, int] | None = None
    blanks: int = 0
    marks: np.ndarray | None = None


@dataclass
class Piece:
    """One piece's attributes, and by section its arrays and the section's attributes (the active arrays)."""

    attributes: dict[str, str]
    sections: dict[str, dict[str, Array]] = field(default_factory=dict)
    active: dict[str, dict[str, str]] = field(default_factory=dict)

    def extent(self) -> list[int]:
        return [int(x) for x in self.attributes["Extent"].split()]


class VtkFile:
    """A serial file: header parsed at once, payloads decoded when asked for."""

    def __init__(self, path: str):
        self.path = path
        head, self.appended_at, self.appended_encoding = _read_head(path)
        try:
            root = ET.fromstring(head)
        except ET.ParseError as e:
            raise FileProblem(f"{path} is no mesh file: {e}") from e
        if root.tag != "VTKFile":
            raise FileProblem(f"{path} is no mesh file: root is {root.tag}")
        self.type = root.get("type", "")
        self.byte_order = root.get("byte_order", codecs.NATIVE)
        self.header = codecs.dtype_of(root.get("header_type", "UInt32"), self.byte_order)
        name = root.get("compressor")
        self.compressor = next((k for k, v in codecs.COMPRESSORS.items() if v == name), None)
        if name and not self.compressor:
            raise NotImplementedHere(f"compressor {name}")
        self.root = root
        self.grid = root.find(self.type)
        if self.type == "Collection" or self.type.startswith("P") and self.type != "PolyData":
            return
        if "header_type" not in root.attrib and root.get("version", "0.1") != "0.1":
            raise FileProblem(f"{path} has no header_type")
        if self.type not in _TYPE_TO_FORMAT or self.grid is None:
            raise FileProblem(f"{path} is of the unknown type {self.type!r}")
        self.format = _TYPE_TO_FORMAT[self.type]
        self.kind = FORMATS[self.format][1]
        self.attributes = dict(self.grid.attrib)
        self.meta = {a.name: a for a in map(_array, self.grid.findall("FieldData/*"))}
        self.pieces = []
        for p in self.grid.findall("Piece"):
            sections = {s.tag: {a.name: a for a in map(_array, s.iter("DataArray"))} for s in p}
            self.pieces.append(Piece(dict(p.attrib), sections, {s.tag: dict(s.attrib) for s in p}))

    def values(self, a: Array, tuples: int | None = None) -> np.ndarray:
        """Decoded values, (n,) or (n, components), in native byte order."""
        dtype = codecs.dtype_of(a.type, self.byte_order)
        tuples = a.tuples if tuples is None else tuples
        count = None if tuples is None or a.type == "String" else tuples * a.components
        if a.encoding == "ascii":
            flat = codecs.decode_ascii(self._text(a), dtype.newbyteorder("="), count)
        else:
            if a.encoding == "binary":
                raw = codecs.decode_base64("".join(self._text(a).split()).encode(), self.compressor, self.header)
            else:
                raw = self._appended(a)
            flat = np.frombuffer(raw, dtype).astype(dtype.newbyteorder("="))
        if count is not None and len(flat) < count:
            raise SizeProblem(f"{self.path}: {a.name} has {len(flat)} values, not {count}")
        flat = flat if count is None else flat[:count]
        if len(flat) % a.components:
            raise SizeProblem(f"{self.path}: {a.name} has no whole number of tuples")
        return flat.reshape(-1, a.components) if a.components > 1 else flat

    def some(self, a: Array, lo: int, hi: int) -> np.ndarray:
        """Decoded values of the tuples from lo to hi, of which alone long arrays are read (and blocks that hold them)."""
        dtype = codecs.dtype_of(a.type, self.byte_order)
        first, last = lo * a.components, hi * a.components
        if a.encoding == "ascii":
            flat = self._ascii_part(a, first, last, dtype.newbyteorder("="))
        else:
            raw = self._bytes_part(a, first * dtype.itemsize, last * dtype.itemsize)
            flat = np.frombuffer(raw, dtype, len(raw) // dtype.itemsize).astype(dtype.newbyteorder("="))
        if len(flat) < last - first:
            raise SizeProblem(f"{self.path}: {a.name} has {first + len(flat)} values, not {last}")
        return flat.reshape(-1, a.components) if a.components > 1 else flat

    def _text(self, a: Array) -> str:
        if a.span is None:
            return a.text or ""
        with open_file(self.path) as f:
            f.seek(a.span[0])
            return f.read(a.span[1] - a.span[0]).decode()

    def mark(self, a: Array) -> None:
        """Note where values of a long ascii text lie."""
        if a.encoding != "ascii" or a.span is None or a.marks is not None:
            return
        marks, seen, blank = [], 0, True
        with open_file(self.path) as f:
            f.seek(a.span[0])
            at = a.span[0]
            while at < a.span[1] and (chunk := f.read(min(_CHUNK, a.span[1] - at))):
                filled = np.frombuffer(chunk, np.uint8) > 32
                starts = np.flatnonzero(filled & np.r_[blank, ~filled[:-1]])
                marks.append(at + starts[-seen % MARK_EVERY :: MARK_EVERY])
                seen, blank, at = seen + len(starts), not filled[-1], at + len(chunk)
        a.marks = np.concatenate(marks) if marks else np.zeros(0, np.int64)

    def _ascii_part(self, a: Array, first: int, last: int, dtype: np.dtype) -> np.ndarray:
        if a.span is None:
            return codecs.decode_ascii(a.text or "", dtype, last)[first:]
        if first == last:
            return np.zeros(0, dtype)
        self.mark(a)
        k, end = first // MARK_EVERY, -(-last // MARK_EVERY)
        if k >= len(a.marks):
            return np.zeros(0, dtype)
        stop = int(a.marks[end]) if end < len(a.marks) else a.span[1]
        with open_file(self.path) as f:
            f.seek(int(a.marks[k]))
            text = f.read(stop - int(a.marks[k])).decode()
        return codecs.decode_ascii(text, dtype)[first - k * MARK_EVERY : last - k * MARK_EVERY]

    def _bytes_part(self, a: Array, lo: int, hi: int) -> bytes:
        with open_file(self.path) as f:
            at, raw = self.appended_at + a.offset, self.appended_encoding == "raw"
            if a.encoding == "binary":
                at, raw = _unbroken(f, a), False
                if at is None:
                    return codecs.decode_base64("".join(self._text(a).split()).encode(), self.compressor, self.header)[lo:hi]

            def stored(at: int, begin: int, end: int) -> bytes:
                if raw:
                    f.seek(at + begin)
                    return f.read(end - begin)
                f.seek(at + begin // 3 * 4)
                text = f.read(-(-end // 3) * 4 - begin // 3 * 4)
                return codecs.base64.b64decode(text)[begin % 3 : begin % 3 + end - begin]

            size, chars = self.header.itemsize, lambda n: -(-n // 3) * 4
            n = int(np.frombuffer(stored(at, 0, size), self.header)[0])
            head = size * (3 + n) if self.compressor else size
            # in base64 the header is padded by itself or goes on into the data
            body, shift = (at + head, 0) if raw else (at + chars(head), 0)
            if not raw and head % 3:
                f.seek(body - 1)
                if f.read(1) != b"=":
                    body, shift = at, head
            if not self.compressor:
                return stored(body, shift + min(lo, n), shift + min(hi, n))
            sizes = np.frombuffer(stored(at, 0, head), self.header).astype(np.int64)
            block, residual = int(sizes[1]), int(sizes[2])
            if not n or hi <= lo:
                return b""
            k, end = lo // block, min(n, -(-hi // block))
            if k >= n:
                return b""
            ends = shift + np.r_[0, np.cumsum(sizes[3:])]
            some = np.r_[end - k, block, residual if end == n else 0, sizes[3 + k : 3 + end]]
            return codecs.decompress_blocks(some, stored(body, int(ends[k]), int(ends[end])), self.compressor)[lo - k * block : hi - k * block]

    def _appended(self, a: Array) -> bytes:
        with open_file(self.path) as f:
            f.seek(self.appended_at + a.offset)
            size = self.header.itemsize
            if self.appended_encoding == "raw":
                first = f.read(size)
                n = int(np.frombuffer(first, self.header)[0])
                if not self.compressor:
                    return f.read(n)
                head = first + f.read(size * (2 + n))
                sizes = np.frombuffer(head, self.header)
                return codecs.decompress_blocks(sizes, f.read(int(sizes[3:].sum())), self.compressor)
            # base64: the header first, then as much as it says, with room for one more padding
            chars = lambda n: -(-n // 3) * 4
            text = f.read(chars(size))
            n = int(np.frombuffer(codecs.base64.b64decode(text)[:size], self.header)[0])
            if self.compressor:
                text += f.read(chars(size * (3 + n)) + 4 - len(text))
                sizes = np.frombuffer(codecs.base64.b64decode(text[: chars(size * (3 + n))])[: size * (3 + n)], self.header)
                n = int(sizes[3:].sum()) + size * (3 + len(sizes[3:]))
            text += f.read(chars(n + size) + 8)
            return codecs.decode_base64(text, self.compressor, self.header)

    def number_of_points(self, piece: Piece) -> int:
        if self.kind != "unstructured":
            e = piece.extent()
            return int(np.prod([e[2 * i + 1] - e[2 * i] + 1 for i in range(3)]))
        return int(piece.attributes["NumberOfPoints"])

    def number_of_cells(self, piece: Piece) -> int:
        if self.kind != "unstructured":
            e = piece.extent()
            return int(np.prod([max(1, e[2 * i + 1] - e[2 * i]) for i in range(3)]))
        if self.type == "PolyData":
            return sum(int(piece.attributes.get(f"NumberOf{g}", 0)) for g in POLY_GROUPS)
        return int(piece.attributes["NumberOfCells"])

    def points(self, piece: Piece, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """(n, 3) coordinates of points lo to hi."""
        hi = self.number_of_points(piece) if hi is None else hi
        if self.kind == "image":
            origin, spacing, direction = self.image_frame()
            index = structured_indices(piece.extent(), lo, hi)
            return origin + (index * spacing) @ np.array(direction).reshape(3, 3).T
        if self.kind == "rectilinear":
            axes = self.ordinates(piece)
            index = structured_indices(piece.extent(), lo, hi) - np.array(piece.extent()[::2])
            return np.stack([axes[k][index[:, k]] for k in range(3)], 1)
        arrays = list(piece.sections.get("Points", {}).values())
        if not arrays:
            return np.zeros((0, 3))
        return self.some(arrays[0], lo, hi).reshape(hi - lo, arrays[0].components)

    def image_frame(self) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Origin, spacing and direction (row by row; identity if not given)."""
        get = lambda k, d: [float(x) for x in self.attributes[k].split()] if k in self.attributes else d
        return np.array(get("Origin", [0.0] * 3)), np.array(get("Spacing", [1.0] * 3)), get("Direction", IDENTITY)

    def ordinates(self, piece: Piece) -> list[np.ndarray]:
        """The three axes; an empty one has the single ordinate 0."""
        arrays = list(piece.sections.get("Coordinates", {}).values())
        if len(arrays) != 3:
            raise FileProblem(f"{self.path} has {len(arrays)} coordinate arrays")
        if len({a.type for a in arrays}) > 1:
            raise FileProblem(f"{self.path}: coordinates differ in type")
        axes = [self.values(a) for a in arrays]
        return [a if len(a) else np.zeros(1, a.dtype) for a in axes]

    def cells(self, piece: Piece, lo: int = 0, hi: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Types, flat corners, and offsets (one more than cells, from 0) of cells lo to hi."""
        n = self.number_of_cells(piece)
        hi = n if hi is None else hi
        if self.kind != "unstructured":
            return structured_cells(piece.extent(), self.kind != "structured", lo, hi)
        if self.type == "PolyData":
            if int(piece.attributes.get("NumberOfStrips", 0)):
                raise NotImplementedHere("triangle strips")
            names: list[str] = []
            corners, offsets, before = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
            for group in POLY_GROUPS:
                n = int(piece.attributes.get(f"NumberOf{group}", 0))
                first, last = max(lo - before, 0), min(hi - before, n)
                before += n
                if first < last:
                    flat, ends = self._connectivity(piece.sections[group], first, last)
                    sizes = np.diff(ends)
                    names += [_poly_type(group, int(s)) for s in sizes]
                    offsets.append(ends[1:] + sum(map(len, corners)))
                    corners.append(flat)
            return names, np.concatenate(corners), np.concatenate(offsets)
        section = piece.sections["Cells"]
        flat, ends = self._connectivity(section, lo, hi)
        return [cell_name(int(t)) for t in self.some(section["types"], lo, hi)], flat, ends

    def _connectivity(self, section: dict[str, Array], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        ends = self.some(section["offsets"], max(lo - 1, 0), hi).astype(np.int64)
        ends = ends if lo else np.r_[0, ends]
        if (np.diff(ends) < 0).any():
            raise SizeProblem(f"{self.path}: offsets decrease")
        try:
            flat = self.some(section["connectivity"], int(ends[0]), int(ends[-1])).astype(np.int64)
        except SizeProblem as e:
            raise SizeProblem(f"{self.path}: connectivity is too short") from e
        return flat, ends - ends[0]


def _unbroken(f, a: Array) -> int | None:
    """Where a long text of base64 begins, if no white space is in it."""
    if a.span is None:
        return None
    f.seek(a.span[0])
    some = f.read(min(4096, a.span[1] - a.span[0]))
    lead = len(some) - len(some.lstrip())
    f.seek(max(a.span[0], a.span[1] - 4096))
    some = f.read(min(4096, a.span[1] - a.span[0]))
    return a.span[0] + lead if lead + len(some) - len(some.rstrip()) == a.blanks else None


def _poly_type(group: str, corners: int) -> str:
    if group == "Verts":
        return "vertex"
    if group == "Lines":
        return "segment" if corners == 2 else "polyline"
    return {3: "triangle", 4: "quadrilateral"}.get(corners, "polygon")


def structured_indices(extent: list[int], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """(n, 3) indices of an extent's points (lo to hi of them), first axis fastest."""
    if hi is None:
        hi = int(np.prod([extent[2 * k + 1] - extent[2 * k] + 1 for k in range(3)]))
    return structured_index_of(extent, np.arange(lo, hi))


def structured_index_of(extent: list[int], flat: np.ndarray) -> np.ndarray:
    """(n, 3) indices of an extent's points by their numbers."""
    n, m = (extent[2 * k + 1] - extent[2 * k] + 1 for k in range(2))
    return np.stack([flat % n + extent[0], flat // n % m + extent[2], flat // (n * m) + extent[4]], 1)


def structured_cells(extent: list[int], axis_aligned: bool, lo: int = 0, hi: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Cells (lo to hi) of an extent in any plane; corners of quadrilaterals and hexahedra go round, those of pixels and voxels don't."""
    n = np.array([extent[2 * k + 1] - extent[2 * k] for k in range(3)])
    strides = np.cumprod(np.r_[1, n + 1])[:3]
    axes = [k for k in range(3) if n[k] > 0]
    if not axes:
        return ["vertex"], np.zeros(1, np.int64), np.array([0, 1])
    index = structured_indices([x for k in range(3) for x in (0, max(0, n[k] - 1))], lo, hi)
    base = index @ strides
    corner = np.zeros(1, np.int64)
    for k in axes:
        corner = np.r_[corner, corner + strides[k]]
    if not axis_aligned and len(axes) > 1:
        corner = corner[[0, 1, 3, 2]] if len(axes) == 2 else corner[[0, 1, 3, 2, 4, 5, 7, 6]]
    name = ("segment", "pixel" if axis_aligned else "quadrilateral", "voxel" if axis_aligned else "hexahedron")[len(axes) - 1]
    return [name] * len(base), (base[:, None] + corner).ravel(), np.arange(len(base) + 1) * len(corner)


class _Window:
    """What has been read of a file and not been taken yet."""

    def __init__(self, f):
        self.f, self.data, self.at = f, bytearray(), 0

    def more(self) -> bool:
        chunk = self.f.read(_CHUNK)
        self.data += chunk
        return bool(chunk)

    def take(self, n: int) -> bytes:
        out = bytes(self.data[:n])
        del self.data[:n]
        self.at += n
        return out


def _read_head(path: str) -> tuple[bytes, int, str]:
    """The XML before appended data (closed again), where appended data begins, and its encoding.

    Long texts of arrays aren't in it; their elements say instead where they lie in the file.
    """
    head = bytearray()
    try:
        with open_file(path) as f:
            w = _Window(f)
            while True:
                while not (m := _TAG.search(w.data)):
                    head += w.take(max(0, len(w.data) - 16))
                    if not w.more():
                        return bytes(head + w.data), 0, "base64"
                kind = m[1]
                head += w.take(m.start())
                while not (m := _TAG_END.match(w.data)):
                    if not w.more():
                        if kind == b"AppendedData":
                            raise FileProblem(f"{path}: appended data is cut off")
                        return bytes(head + w.data), 0, "base64"
                tag = w.take(m.end())
                if kind == b"AppendedData":
                    while (start := w.data.find(b"_")) < 0:
                        if not w.more():
                            raise FileProblem(f"{path}: appended data is cut off")
                    encoding = re.search(r'encoding="(\w+)"', tag.decode())
                    return bytes(head) + b"</VTKFile>", w.at + start + 1, encoding[1] if encoding else "base64"
                head += tag if tag.endswith(b"/>") else _without_long_text(path, tag, w)
    except OSError as e:
        if isinstance(e, FileProblem):
            raise
        raise FileProblem(f"{path} can't be read: {e}") from e


def _without_long_text(path: str, tag: bytes, w: _Window) -> bytes:
    """An array's tag and text up to the next tag, or only where the text lies, if it is long."""
    begin, text, blanks, more = w.at, b"", 0, True
    while more:
        stop = w.data.find(b"<")
        some = w.take(len(w.data) if stop < 0 else stop)
        text = text + some if w.at - begin <= _KEPT_TEXT else b""
        blanks += sum(map(some.count, b" \t\r\n")) if b"binary" in tag else 0
        if w.at - begin > _KEPT_TEXT and b"&" in some:
            raise FileProblem(f"{path}: an array's text isn't only numbers")
        more = stop < 0 and w.more()
    if w.at - begin <= _KEPT_TEXT:
        return tag + text
    return tag[:-1] + f' _from="{begin}" _to="{w.at}" _blanks="{blanks}">'.encode()


def _array(e: ET.Element) -> Array:
    encoding = e.get("format", "ascii")
    tuples = e.get("NumberOfTuples")
    span = (int(e.get("_from")), int(e.get("_to"))) if "_from" in e.attrib else None
    return Array(e.get("Name", ""), e.get("type", "Float32"), int(e.get("NumberOfComponents", 1)), int(tuples) if tuples else None, encoding, e.text if encoding != "appended" else None, int(e.get("offset", 0)), span, int(e.get("_blanks", 0)))


def parallel_pieces(path: str) -> tuple[VtkFile, list[str]]:
    """A parallel index and the paths of its pieces."""
    index = VtkFile(path)
    base = posixpath.dirname(path)
    grid = index.grid
    if grid is None:
        raise FileProblem(f"{path} has no {index.type}")
    if int(grid.get("GhostLevel", 0)) > 0:
        raise NotImplementedHere("ghost levels")
    sources = [p.get("Source", "") for p in grid.findall("Piece")]
    return index, [s if s.startswith("/") or "://" in s else posixpath.join(base, s) for s in sources]


def series_steps(path: str) -> list[tuple[float, str]]:
    """(time, file) of each entry of a collection, in its order."""
    index = VtkFile(path)
    base = posixpath.dirname(path)
    out = []
    for d in index.root.iter("DataSet"):
        name = d.get("file", "")
        out.append((float(d.get("timestep", 0)), name if name.startswith("/") or "://" in name else posixpath.join(base, name)))
    return out


# --- writing ---


@dataclass(frozen=True)
class WriteOptions:
    """How payloads are stored."""

    encoder: str = "base64"
    data_format: str = "appended"
    compressor: str | None = "lz4"
    header_type: str = "UInt64"
    coordinates: str | None = None
    block_bytes: int = codecs.BLOCK_BYTES

    def __post_init__(self) -> None:
        codecs.check_combination(self.encoder, self.data_format, self.compressor)

    @classmethod
    def of(cls, encoder: str = "base64", data_format: str | None = None, compressor: str | None = "auto", **more) -> WriteOptions:
        """Options with what isn't said chosen: ascii is inlined and not compressed, others appended and lz4."""
        data_format = data_format or ("inlined" if encoder == "ascii" else "appended")
        if compressor == "auto":
            compressor = None if encoder == "ascii" else "lz4"
        return cls(encoder, data_format, None if encoder == "ascii" else compressor, **more)


@dataclass
class Stored:
    """An array whose values lie encoded (but for base64) in files in order, `path` and, if compressed, `path`.sizes."""

    type: str
    shape: tuple[int, ...]
    paths: list[str]
    stored_bytes: int = 0

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def dtype(self) -> np.dtype:
        return codecs.dtype_of(self.type)

    def __len__(self) -> int:
        return self.shape[0]

    def write_to(self, f, options: WriteOptions) -> None:
        """The payload as encode_binary and encode_ascii make it, with little of it in memory."""
        if options.encoder == "ascii":
            for k, path in enumerate(self.paths):
                f.write(b"\n" if k else b"")
                for some in _read_in_pieces(path):
                    f.write(some)
            return
        plain = options.encoder == "raw"
        head = self._head(options)
        f.write(head if plain else codecs.base64.b64encode(head))
        rest = b""
        for path in self.paths:
            for some in _read_in_pieces(path):
                if plain:
                    f.write(some)
                else:  # padding comes at the end alone
                    some = rest + some
                    whole = len(some) // 3 * 3
                    f.write(codecs.base64.b64encode(some[:whole]))
                    rest = some[whole:]
        f.write(codecs.base64.b64encode(rest))

    def _head(self, options: WriteOptions) -> bytes:
        total, header = self._total(), codecs.dtype_of(options.header_type)
        if not options.compressor:
            return np.array([total], header).tobytes()
        sizes = [np.frombuffer(b"".join(_read_in_pieces(f"{p}.sizes")), np.int64) for p in self.paths]
        blocks = sum(map(len, sizes))
        return np.concatenate([[blocks, options.block_bytes if blocks else 0, total % options.block_bytes], *sizes]).astype(header).tobytes()

    def _total(self) -> int:
        return int(np.prod(self.shape)) * self.dtype.itemsize

    def payload_bytes(self, options: WriteOptions) -> int:
        size = codecs.dtype_of(options.header_type).itemsize
        head = size * (3 + -(-self._total() // options.block_bytes)) if options.compressor else size
        return head + self.stored_bytes if options.encoder == "raw" else -(-head // 3) * 4 + -(-self.stored_bytes // 3) * 4


def _read_in_pieces(path: str) -> Iterable[bytes]:
    with open_file(path) as f:
        while some := f.read(_CHUNK):
            yield some


def chunk_rows(options: WriteOptions) -> int:
    """Rows of a part of an array, such that parts of any array begin with a block, a line of ascii, or a group of base64."""
    unit = math.lcm(options.block_bytes if options.compressor else 1, codecs.PER_LINE)
    return unit * max(1, CHUNK_ROWS // unit)


def store_chunk(path: str, values: np.ndarray, type_name: str | None, options: WriteOptions) -> int:
    """Write a part of an array as a file of Stored; returns its bytes."""
    values = values.astype(codecs.dtype_of(type_name)) if type_name else values
    values = np.ascontiguousarray(values.astype("u1") if values.dtype == bool else values)
    if options.encoder == "ascii":
        body = codecs.encode_ascii(values).encode()
    elif options.compressor:
        head, body = codecs.compress_blocks(values.tobytes(), options.compressor, np.dtype(np.int64), options.block_bytes)
        with _replacing(f"{path}.sizes") as f:
            f.write(head[24:])
    else:
        body = values.tobytes()
    with _replacing(path) as f:
        f.write(body)
    return len(body)


class _Writer:
    """Collects a file's XML and its appended payloads."""

    def __init__(self, options: WriteOptions):
        self.options, self.lines, self.payloads, self.at = options, [], [], 0
        self.header = codecs.dtype_of(options.header_type)

    def array(self, name: str, values: np.ndarray, type_name: str | None = None, tuples: int | None = None) -> None:
        o = self.options
        type_name = type_name or codecs.type_name(values.dtype)
        if isinstance(values, Stored):
            return self._stored(name, values, type_name)
        values = values.astype(codecs.dtype_of(type_name)) if type_name != "String" else values
        components = int(np.prod(values.shape[1:])) if values.ndim > 1 else 1
        tag = f'<DataArray type="{type_name}" Name={quoteattr(name)} NumberOfComponents="{components}" NumberOfTuples="{values.shape[0] if tuples is None else tuples}"'
        if o.data_format == "appended":
            payload = codecs.encode_binary(values, o.encoder, o.compressor, self.header, o.block_bytes)
            self.lines.append(f'{tag} format="appended" offset="{self.at}"/>')
            self.payloads.append(payload)
            self.at += len(payload)
        elif o.encoder == "ascii":
            self.lines.append(f'{tag} format="ascii">\n{codecs.encode_ascii(values)}\n</DataArray>')
        else:
            payload = codecs.encode_binary(values, "base64", o.compressor, self.header, o.block_bytes)
            self.lines.append(f'{tag} format="binary">{payload.decode()}</DataArray>')

    def _stored(self, name: str, values: Stored, type_name: str) -> None:
        components = int(np.prod(values.shape[1:]))
        tag = f'<DataArray type="{type_name}" Name={quoteattr(name)} NumberOfComponents="{components}" NumberOfTuples="{len(values)}"'
        if self.options.data_format == "appended":
            self.lines.append(f'{tag} format="appended" offset="{self.at}"/>')
            self.payloads.append(values)
            self.at += values.payload_bytes(self.options)
        elif self.options.encoder == "ascii":
            self.lines.append((f'{tag} format="ascii">\n', values, "\n</DataArray>"))
        else:
            self.lines.append((f'{tag} format="binary">', values, "</DataArray>"))

    def fields(self, section: str, fields: dict[str, np.ndarray]) -> None:
        """A section of fields by name in order, the first of each rank being the active one."""
        active: dict[str, str] = {}
        for name in sorted(fields):
            v = fields[name]
            rank = "Scalars" if v.ndim == 1 else "Vectors" if v.ndim == 2 and v.shape[1] <= 3 else "Tensors" if v.ndim == 2 and v.shape[1] == 9 else None
            if rank:
                active.setdefault(rank, name)
        self.lines.append(f"<{section}{''.join(f' {k}={quoteattr(v)}' for k, v in active.items())}>")
        for name in sorted(fields):
            self.array(name, fields[name])
        self.lines.append(f"</{section}>")

    def meta(self, meta: dict[str, object]) -> None:
        if not meta:
            return
        self.lines.append("<FieldData>")
        for name in sorted(meta):
            value = meta[name]
            if isinstance(value, str):
                self.array(name, np.frombuffer(value.encode() + b"\0", np.int8), "String", 1)
            else:
                self.array(name, np.atleast_1d(np.asarray(value)))
        self.lines.append("</FieldData>")

    def write(self, path: str, type_name: str, attributes: dict[str, object]) -> None:
        """Write to a file of its own first, so that a task that is run again leaves no half of one."""
        o = self.options
        compressor = f' compressor="{codecs.COMPRESSORS[o.compressor]}"' if o.compressor else ""
        said = "".join(f" {k}={quoteattr(str(v))}" for k, v in attributes.items())
        head = f'<VTKFile type="{type_name}" version="2.2" byte_order="{codecs.NATIVE}" header_type="{o.header_type}"{compressor}>\n<{type_name}{said}>\n'

        def put(part: str | bytes | Stored) -> None:
            if isinstance(part, Stored):
                part.write_to(f, o)
            else:
                f.write(part.encode() if isinstance(part, str) else part)

        with _replacing(path) as f:
            put(head)
            for k, line in enumerate(self.lines):
                for part in ("\n" if k else "", *(line if isinstance(line, tuple) else (line,))):
                    put(part)
            put(f"\n</{type_name}>\n")
            if o.data_format == "appended":
                f.write(f'<AppendedData encoding="{o.encoder}">\n_'.encode())
                for p in self.payloads:
                    put(p)
                f.write(b"\n</AppendedData>\n")
            f.write(b"</VTKFile>\n")


class _replacing:
    """A file that takes its name when it is complete (in stores without renaming, by a copy)."""

    def __init__(self, path: str):
        self.path, self.local = path, "://" not in path
        self.part = f"{path}._tmp-{uuid.uuid4().hex}"

    def __enter__(self):
        if self.local:
            os.makedirs(os.path.dirname(self.part) or ".", exist_ok=True)
        self.file = open_file(self.part, "wb")
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if not self.local:
            from pyarrow import fs

            system, part = fs.FileSystem.from_uri(self.part)
            if kind is None:
                system.move(part, fs.FileSystem.from_uri(self.path)[1])
            else:
                system.delete_file(part)
        elif kind is None:
            os.replace(self.part, self.path)
        else:
            os.remove(self.part)


def three(values: np.ndarray | Stored) -> np.ndarray | Stored:
    """Vectors of fewer than three components, and square tensors as nine, padded with zeros (as stored ones are)."""
    if isinstance(values, Stored):
        return values
    if values.ndim == 2 and values.shape[1] < 3:
        return np.pad(values, ((0, 0), (0, 3 - values.shape[1])))
    if values.ndim == 3:
        if max(values.shape[1:]) < 3:
            values = np.pad(values, ((0, 0), (0, 3 - values.shape[1]), (0, 3 - values.shape[2])))
        return values.reshape(len(values), -1)
    return values


@dataclass
class Grid:
    """What a file holds. Unstructured: points, cells. Structured: extents and frame; fields in flat order."""

    kind: str
    point_fields: dict[str, np.ndarray] = field(default_factory=dict)
    cell_fields: dict[str, np.ndarray] = field(default_factory=dict)
    meta: dict[str, object] = field(default_factory=dict)
    points: np.ndarray | None = None
    types: list[str] = field(default_factory=list)
    corners: np.ndarray | None = None
    offsets: np.ndarray | None = None
    whole_extent: list[int] | None = None
    extent: list[int] | None = None
    origin: Iterable[float] = (0.0, 0.0, 0.0)
    spacing: Iterable[float] = (1.0, 1.0, 1.0)
    direction: Iterable[float] = tuple(IDENTITY)
    ordinates: list[np.ndarray] | None = None
    #: In place of types, corners and offsets: by group (Cells of vtu) the number of cells, connectivity and ends; types' ids.
    groups: dict[str, tuple[int, Stored, Stored]] | None = None
    type_ids: Stored | None = None


def write_grid(path: str, format: str, grid: Grid, options: WriteOptions) -> None:
    """Write one serial file."""
    if format not in FORMATS:
        raise ValueProblem(f"unknown format {format!r}")
    type_name, kind = FORMATS[format]
    if kind != "unstructured" and kind != grid.kind:
        raise ValueProblem(f"a {grid.kind} grid can't be written as {format}")
    w = _Writer(options)
    w.meta(grid.meta)
    point_fields = {k: three(v) for k, v in grid.point_fields.items()}
    cell_fields = {k: three(v) for k, v in grid.cell_fields.items()}
    join = lambda xs: " ".join(str(x) for x in xs)
    numbers = lambda xs: " ".join(repr(float(x)) for x in xs)
    attributes: dict[str, object] = {}
    if kind == "unstructured":
        _write_unstructured(w, format, grid, point_fields, cell_fields)
    else:
        attributes["WholeExtent"] = join(grid.whole_extent or grid.extent)
        if kind == "image":
            attributes |= {"Origin": numbers(grid.origin), "Spacing": numbers(grid.spacing), "Direction": numbers(grid.direction)}
        w.lines.append(f'<Piece Extent="{join(grid.extent)}">')
        w.fields("PointData", point_fields)
        w.fields("CellData", cell_fields)
        if kind == "rectilinear":
            w.lines.append("<Coordinates>")
            for k, axis in enumerate(grid.ordinates):
                w.array(f"X_{k}", np.asarray(axis), options.coordinates)
            w.lines.append("</Coordinates>")
        if kind == "structured":
            w.lines.append("<Points>")
            w.array("Coordinates", _in_space(grid.points), options.coordinates)
            w.lines.append("</Points>")
        w.lines.append("</Piece>")
    w.write(path, type_name, attributes)


def _in_space(points: np.ndarray | Stored) -> np.ndarray | Stored:
    return points if isinstance(points, Stored) else np.asarray(points).reshape(-1, 3)


def poly_group(cell_type: str) -> int:
    """The number of the group that a cell goes to in poly data; -1 for none."""
    return next((k for k, g in enumerate(POLY_GROUPS) if cell_type in POLY_GROUPS[g]), -1)


def _grouped(format: str, grid: Grid, cell_fields: dict) -> tuple[dict, np.ndarray | Stored, dict]:
    """Groups, ids of types, and fields of cells in the order of the file."""
    if grid.groups is not None:
        return grid.groups, grid.type_ids, cell_fields
    ids = np.array([CELL_TYPES[t] for t in grid.types], np.uint8)
    sizes = np.diff(grid.offsets)
    if format == "vtu":
        return {"Cells": (len(sizes), grid.corners, grid.offsets[1:])}, ids, cell_fields
    group = np.array([poly_group(t) for t in grid.types], np.int64)
    # cells lie by group in the file, and their data with them
    order = np.argsort(group, kind="stable")[(group < 0).sum() :]
    groups = {}
    for k, g in enumerate(POLY_GROUPS):
        mine = order[group[order] == k]
        parts = [grid.corners[grid.offsets[i] : grid.offsets[i + 1]] for i in mine]
        groups[g] = (len(mine), np.concatenate([np.zeros(0, np.int64), *parts]), np.cumsum(sizes[mine]))
    return groups, ids, {k: v[order] for k, v in cell_fields.items()}


def _write_unstructured(w: _Writer, format: str, grid: Grid, point_fields: dict, cell_fields: dict) -> None:
    header = w.options.header_type.replace("U", "")
    groups, ids, cell_fields = _grouped(format, grid, cell_fields)
    if format == "vtu":
        w.lines.append(f'<Piece NumberOfPoints="{len(grid.points)}" NumberOfCells="{groups["Cells"][0]}">')
    else:
        n = {g: x[0] for g, x in groups.items()}
        w.lines.append(f'<Piece NumberOfPoints="{len(grid.points)}" NumberOfVerts="{n["Verts"]}" NumberOfLines="{n["Lines"]}" NumberOfStrips="0" NumberOfPolys="{n["Polys"]}">')
    w.fields("PointData", point_fields)
    w.fields("CellData", cell_fields)
    w.lines.append("<Points>")
    w.array("Coordinates", _in_space(grid.points), w.options.coordinates)
    w.lines.append("</Points>")
    for g, (_, corners, ends) in groups.items():
        w.lines.append(f"<{g}>")
        w.array("connectivity", corners, header)
        w.array("offsets", ends, header)
        if format == "vtu":
            w.array("types", ids)
        w.lines.append(f"</{g}>")
    w.lines.append("</Piece>")


def write_parallel_index(path: str, format: str, pieces: list[str], fields: dict[str, dict[str, tuple[str, int]]], coordinates: str, grid: Grid | None = None, extents: list[list[int]] | None = None) -> None:
    """The index of pieces: names, types and components of fields (by section) and the pieces' files."""
    type_name = "P" + FORMATS[format][0]
    attributes = {"GhostLevel": "0"}
    if grid is not None:
        attributes["WholeExtent"] = " ".join(map(str, grid.whole_extent))
        if grid.kind == "image":
            for name, values in (("Origin", grid.origin), ("Spacing", grid.spacing), ("Direction", grid.direction)):
                attributes[name] = " ".join(repr(float(x)) for x in values)
    lines = [f'<VTKFile type="{type_name}" version="2.2" byte_order="{codecs.NATIVE}" header_type="UInt64">', f"<{type_name}{''.join(f' {k}={quoteattr(v)}' for k, v in attributes.items())}>"]
    for section in ("PPointData", "PCellData"):
        lines.append(f"<{section}>")
        lines += [f'<PDataArray type="{t}" Name={quoteattr(n)} NumberOfComponents="{c}"/>' for n, (t, c) in sorted(fields.get(section, {}).items())]
        lines.append(f"</{section}>")
    if format in ("vtu", "vtp", "vts"):
        lines.append(f'<PPoints><PDataArray type="{coordinates}" Name="Coordinates" NumberOfComponents="3"/></PPoints>')
    if format == "vtr":
        lines.append("<PCoordinates>" + "".join(f'<PDataArray type="{coordinates}" Name="X_{k}"/>' for k in range(3)) + "</PCoordinates>")
    for i, name in enumerate(pieces):
        extent = f' Extent="{" ".join(map(str, extents[i]))}"' if extents else ""
        lines.append(f"<Piece{extent} Source={quoteattr(name)}/>")
    lines += [f"</{type_name}>", "</VTKFile>", ""]
    with _replacing(path) as f:
        f.write("\n".join(lines).encode())


def write_series_index(path: str, steps: list[tuple[float, str]]) -> None:
    """A collection of (time, file)."""
    lines = ['<VTKFile type="Collection" version="1.0">', "<Collection>"]
    lines += [f'<DataSet timestep="{time!r}" group="" part="0" name="" file={quoteattr(name)}/>' for time, name in steps]
    lines += ["</Collection>", "</VTKFile>", ""]
    with _replacing(path) as f:
        f.write("\n".join(lines).encode())
