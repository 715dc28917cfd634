"""Spark data source `meshfile`: the tables of a mesh file, of its parallel index, or of a time series.

    spark.dataSource.register(MeshFileSource)
    spark.read.format("meshfile").option("table", "point_data").option("fields", "p,v").load("mesh.pvtu")

Tables: points, cells, point_data, cell_data, meta_data, field_info, grid_info, steps. Headers alone give the schema;
every (step, piece) is a task of its own, or several of PART_ROWS rows each that read only these; with the option `pushdown` (and spark.sql.python.filterPushdown.enabled)
filters on step and piece leave files out; the option `fields` leaves payloads unread.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..errors import FileProblem, NotImplementedHere, ValueProblem
from ..functions.cells import CELL_TYPES
from .vtkxml import FORMATS, Array, Piece, VtkFile, file_stamp, parallel_pieces, series_steps, structured_index_of

TABLES = ("points", "cells", "point_data", "cell_data", "meta_data", "field_info", "grid_info", "steps")
_ROWS = 1 << 16
#: Most rows that a task reads, and the sections of arrays that a table has its rows from.
PART_ROWS = 1 << 18
_SECTIONS = {"points": ("Points",), "point_data": ("PointData",), "cells": ("Cells", "Verts", "Lines", "Polys"), "cell_data": ("CellData",)}
#: Spark's type of a stored number type: unsigned ones take the next wider signed one.
SPARK_TYPES = {
    "Float32": T.FloatType(), "Float64": T.DoubleType(), "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(),
    "UInt8": T.ShortType(), "UInt16": T.IntegerType(), "UInt32": T.LongType(), "UInt64": T.DecimalType(20, 0), "String": T.StringType(),
}
_ARROW = {T.FloatType(): pa.float32(), T.DoubleType(): pa.float64(), T.ByteType(): pa.int8(), T.ShortType(): pa.int16(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DecimalType(20, 0): pa.decimal128(20, 0)}


@dataclass
class MeshPart(InputPartition):
    """One piece of one step, or its rows from start to stop; then with the file's header, which needn't be read again."""

    step: int
    time: float | None
    piece: int
    file: str
    whole: tuple[int, ...] | None = None
    start: int = 0
    stop: int | None = None
    head: VtkFile | None = None

    def __post_init__(self) -> None:
        super().__init__(None)


def extension(path: str) -> str:
    """The format that a file's name tells."""
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    if ext in ("hdf", "h5", "vtkhdf"):
        raise NotImplementedHere(f"{path}: h5py is required for VTK-HDF files and isn't installed")
    if ext not in (*FORMATS, *(f"p{f}" for f in FORMATS), "pvd"):
        raise FileProblem(f"{path}: unknown extension {ext!r}")
    return ext


def mesh_parts(path: str, step: int = 0, time: float | None = None, group_times: bool = False) -> list[MeshPart]:
    """All pieces of all steps behind a path; with group_times, entries of a collection of equal times are one step."""
    ext = extension(path)
    if ext == "pvd":
        out: list[MeshPart] = []
        steps = series_steps(path)
        times = list(dict.fromkeys(t for t, _ in steps))
        for k, (t, file) in enumerate(steps):
            number = times.index(t) if group_times else k
            inner = mesh_parts(file, number, t)
            first = sum(p.step == number for p in out)
            for p in inner:
                p.piece += first
            out += inner
        return out
    if ext.startswith("p"):
        index, files = parallel_pieces(path)
        whole = tuple(int(x) for x in index.grid.get("WholeExtent").split()) if index.grid.get("WholeExtent") else None
        return [MeshPart(step, time, k, f, whole) for k, f in enumerate(files)]
    head = VtkFile(path)
    whole = tuple(int(x) for x in head.attributes["WholeExtent"].split()) if "WholeExtent" in head.attributes else None
    return [MeshPart(step, time, k, f"{path}#{k}" if len(head.pieces) > 1 else path, whole) for k in range(len(head.pieces))]


@functools.lru_cache(maxsize=64)
def _parsed(path: str, stamp: tuple[int, int] | None) -> VtkFile:
    return VtkFile(path)


def open_piece(part: MeshPart) -> tuple[VtkFile, Piece]:
    """The file and the piece of a part."""
    path, _, number = part.file.partition("#")
    if part.head is not None:
        return part.head, part.head.pieces[int(number or 0)]
    file = _parsed(path, file_stamp(path))
    return file, file.pieces[int(number or 0)]


def split_parts(parts: list[MeshPart], table: str, wanted: Sequence[str] | None = None) -> list[MeshPart]:
    """Parts of at most PART_ROWS rows each, in order."""
    if table not in _SECTIONS:
        return parts
    out = []
    for part in parts:
        file, piece = open_piece(part)
        n = file.number_of_points(piece) if table.startswith("point") else file.number_of_cells(piece)
        if n <= PART_ROWS:
            out.append(part)
            continue
        for section in _SECTIONS[table]:
            for a in piece.sections.get(section, {}).values():
                if wanted is None or a.name in wanted or table in ("points", "cells"):
                    file.mark(a)
        out += [replace(part, start=at, stop=min(n, at + PART_ROWS), head=file) for at in range(0, n, PART_ROWS)]
    return out


def field_type(a: Array) -> T.DataType:
    """Column type of a field."""
    one = SPARK_TYPES[a.type]
    return T.ArrayType(one) if a.components > 1 else one


def _field_columns(arrays: dict[str, Array], wanted: Sequence[str] | None) -> list[T.StructField]:
    if wanted is not None and (unknown := [w for w in wanted if w not in arrays]):
        raise ValueProblem(f"no field named {', '.join(unknown)}")
    return [T.StructField(n, field_type(a), True, {"precision": a.type, "components": a.components}) for n, a in arrays.items() if wanted is None or n in wanted]


_LONG, _INT, _DOUBLE, _STRING = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
_LONGS, _DOUBLES = T.ArrayType(_LONG), T.ArrayType(_DOUBLE)
_FIXED = {
    "points": [("step", _INT), ("piece", _INT), ("point_id", _LONG), ("i", _LONG), ("j", _LONG), ("k", _LONG), ("x", _DOUBLE), ("y", _DOUBLE), ("z", _DOUBLE)],
    "cells": [("step", _INT), ("piece", _INT), ("cell_id", _LONG), ("cell_type", _STRING), ("vtk_type", _INT), ("corners", _LONGS)],
    "point_data": [("step", _INT), ("piece", _INT), ("point_id", _LONG)],
    "cell_data": [("step", _INT), ("piece", _INT), ("cell_id", _LONG)],
    "meta_data": [("step", _INT), ("name", _STRING), ("precision", _STRING), ("string_value", _STRING), ("numbers", _DOUBLES)],
    "field_info": [("step", _INT), ("piece", _INT), ("assoc", _STRING), ("name", _STRING), ("precision", _STRING), ("n_tuples", _LONG), ("layout", _LONGS), ("encoding", _STRING), ("compressor", _STRING)],
    "grid_info": [("file", _STRING), ("step", _INT), ("piece", _INT), ("kind", _STRING), ("whole_extent", _LONGS), ("extent", _LONGS), ("origin", _DOUBLES), ("spacing", _DOUBLES), ("direction", _DOUBLES), ("x_ord", _DOUBLES), ("y_ord", _DOUBLES), ("z_ord", _DOUBLES), ("n_points", _LONG), ("n_cells", _LONG)],
    "steps": [("step", _INT), ("time", _DOUBLE), ("file", _STRING)],
}


def table_schema(path: str, table: str, wanted: Sequence[str] | None, parts: list[MeshPart] | None = None) -> T.StructType:
    """Schema of a table, from headers only."""
    if table not in TABLES:
        raise ValueProblem(f"no table {table!r}; there are {', '.join(TABLES)}")
    columns = [T.StructField(n, k) for n, k in _FIXED[table]]
    if table in ("point_data", "cell_data"):
        parts = mesh_parts(path) if parts is None else parts
        section = "PointData" if table == "point_data" else "CellData"
        names = None
        for part in parts:
            if part.step != parts[0].step:
                break
            _, piece = open_piece(part)
            arrays = piece.sections.get(section, {})
            if names is None:
                names, first = list(arrays), arrays
            elif list(arrays) != names:
                raise ValueProblem(f"{part.file}: its fields differ from those of the first piece")
            elif any((a.type, a.components) != (first[n].type, first[n].components) for n, a in arrays.items()):
                raise ValueProblem(f"{part.file}: its fields differ in layout or precision from those of the first piece")
        columns += _field_columns(first if names is not None else {}, wanted)
    return T.StructType(columns)


def to_arrow(values: np.ndarray, kind: T.DataType) -> pa.Array:
    """Values, (n,) or (n, components), as a column."""
    one = _ARROW[kind.elementType if isinstance(kind, T.ArrayType) else kind]
    flat = values.ravel()
    inner = pa.array([int(x) for x in flat], one) if pa.types.is_decimal(one) else pa.array(flat).cast(one)
    if not isinstance(kind, T.ArrayType):
        return inner
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), inner)


def _structured_ids(part: MeshPart, extent: list[int], cells: bool, flat: np.ndarray) -> np.ndarray:
    """Ids in the whole extent of a piece's points or cells, by their numbers in the piece."""
    whole = list(part.whole or extent)
    if cells:
        extent = [x for a in range(3) for x in (extent[2 * a], max(extent[2 * a], extent[2 * a + 1] - 1))]
        n = [max(1, whole[2 * a + 1] - whole[2 * a]) for a in range(3)]
    else:
        n = [whole[2 * a + 1] - whole[2 * a] + 1 for a in range(3)]
    index = structured_index_of(extent, flat) - np.array(whole[::2])
    return index[:, 0] + n[0] * (index[:, 1] + n[1] * index[:, 2])


def read_table(part: MeshPart, table: str, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """The rows of one piece."""
    file, piece = open_piece(part)
    names = [f.name for f in schema]
    structured = file.kind != "unstructured"
    columns: dict[str, pa.Array] = {}
    if table in ("points", "point_data"):
        lo, hi = part.start, file.number_of_points(piece) if part.stop is None else part.stop
        n = hi - lo
        columns["point_id"] = pa.array(_structured_ids(part, piece.extent(), False, np.arange(lo, hi)) if structured else np.arange(lo, hi))
        if table == "points":
            xyz = file.points(piece, lo, hi).astype(np.float64)
            xyz = np.pad(xyz, ((0, 0), (0, 3 - xyz.shape[1])))
            columns |= {c: pa.array(np.ascontiguousarray(xyz[:, i])) for i, c in enumerate("xyz")}
            index = structured_index_of(piece.extent(), np.arange(lo, hi)) if structured else None
            columns |= {c: pa.array(np.ascontiguousarray(index[:, a])) if structured else pa.nulls(n, pa.int64()) for a, c in enumerate("ijk")}
        else:
            columns |= {f.name: to_arrow(file.some(piece.sections["PointData"][f.name], lo, hi), f.dataType) for f in schema.fields[3:]}
    elif table in ("cells", "cell_data"):
        lo, hi = part.start, file.number_of_cells(piece) if part.stop is None else part.stop
        n = hi - lo
        columns["cell_id"] = pa.array(_structured_ids(part, piece.extent(), True, np.arange(lo, hi)) if structured else np.arange(lo, hi))
        if table == "cells":
            types, corners, offsets = file.cells(piece, lo, hi)
            if structured:
                corners = _structured_ids(part, piece.extent(), False, corners)
            columns["cell_type"] = pa.array(types, pa.string())
            columns["vtk_type"] = pa.array([CELL_TYPES[t] for t in types], pa.int32())
            columns["corners"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(corners, pa.int64()))
        else:
            columns |= {f.name: to_arrow(file.some(piece.sections["CellData"][f.name], lo, hi), f.dataType) for f in schema.fields[3:]}
    elif table == "meta_data":
        rows = []
        for a in file.meta.values() if part.piece == 0 else ():
            values = file.values(a, a.tuples)
            if a.type == "String":
                if a.tuples not in (None, 1):
                    raise ValueProblem(f"{part.file}: {a.name} has several strings")
                rows.append((part.step, a.name, a.type, values.astype(np.uint8).tobytes().rstrip(b"\0").decode(), None))
            else:
                rows.append((part.step, a.name, a.type, None, values.astype(np.float64).ravel().tolist()))
        yield _batch(rows, schema)
        return
    elif table == "field_info":
        rows = []
        for assoc, section, n in (("point", "PointData", file.number_of_points(piece)), ("cell", "CellData", file.number_of_cells(piece))):
            for a in piece.sections.get(section, {}).values():
                rows.append((part.step, part.piece, assoc, a.name, a.type, n, [n] if a.components == 1 else [n, a.components], a.encoding, file.compressor))
        for a in file.meta.values() if part.piece == 0 else ():
            rows.append((part.step, part.piece, "meta", a.name, a.type, a.tuples, [a.tuples or 0], a.encoding, file.compressor))
        yield _batch(rows, schema)
        return
    else:
        extent = piece.extent() if structured else None
        image, axes = file.kind == "image", [None] * 3
        frame = [list(map(float, x)) for x in file.image_frame()] if image else [None] * 3
        if file.kind == "rectilinear":
            axes = [a.astype(float).tolist() for a in file.ordinates(piece)]
        yield _batch([(part.file, part.step, part.piece, file.kind, list(part.whole) if part.whole else None, extent, *frame, *axes, file.number_of_points(piece), file.number_of_cells(piece))], schema)
        return
    columns |= {"step": pa.array(np.full(n, part.step, np.int32)), "piece": pa.array(np.full(n, part.piece, np.int32))}
    batch = pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)
    for at in range(0, max(n, 1), _ROWS):
        yield batch.slice(at, _ROWS)


def read_part(part: MeshPart, table: str, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """The rows of one piece, steps included; none for the part that stands for no part."""
    if part.step < 0:
        yield _batch([], schema)
    elif table == "steps":
        yield _batch([(part.step, part.time, part.file)] if part.piece == 0 else [], schema)
    else:
        yield from read_table(part, table, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], names=arrow.names)


class MeshFileSource(DataSource):
    """`meshfile`, for reading in batch and for following a collection as a stream."""

    @classmethod
    def name(cls) -> str:
        return "meshfile"

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueProblem("a path is needed")
        return self.options["path"]

    def _table(self) -> str:
        return self.options.get("table", "points")

    def _wanted(self) -> list[str] | None:
        said = self.options.get("fields", "*")
        return None if said == "*" else [x.strip() for x in said.split(",") if x.strip()]

    def schema(self) -> T.StructType:
        return table_schema(self._path(), self._table(), self._wanted())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        on = lambda option: self.options.get(option, "false").lower() == "true"
        kind = PushingMeshFileReader if on("pushdown") else MeshFileReader
        return kind(self._path(), self._table(), schema, on("group_times"))

    def streamReader(self, schema: T.StructType):
        from ..streaming.series import SeriesStreamReader

        return SeriesStreamReader(self._path(), self._table(), schema)


class MeshFileReader(DataSourceReader):
    """One task for each piece of each step that the filters leave, or for each PART_ROWS rows of it."""

    def __init__(self, path: str, table: str, schema: T.StructType, group_times: bool = False):
        self.path, self.table, self.mesh_schema, self.group_times = path, table, schema, group_times
        self.only: dict[str, set] = {}

    def partitions(self) -> Sequence[MeshPart]:
        parts = mesh_parts(self.path, group_times=self.group_times)
        parts = [p for p in parts if p.step in self.only.get("step", {p.step}) and p.piece in self.only.get("piece", {p.piece})]
        return split_parts(parts, self.table, self.mesh_schema.names) or [MeshPart(-1, None, -1, "")]

    def read(self, part: MeshPart) -> Iterator[pa.RecordBatch]:
        yield from read_part(part, self.table, self.mesh_schema)


class PushingMeshFileReader(MeshFileReader):
    """The same, taking filters on step and piece from Spark (which refuses such readers where pushdown is off)."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("step", "piece") and self.table != "meta_data":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only.get(name, values) & values
            else:
                yield f
