"""Meshes as DataFrames, and how they get into files and out of them.

One task writes one piece; a large piece is encoded in parts by many tasks, and one strings these together. The driver
then writes the index. Tables may carry `step` and `piece`; without them all rows
are of step 0 and piece 0. Points, cells and their data meet by (step, piece) alone: connectivity is renumbered within
the piece, so no global numbering is needed.
"""

from __future__ import annotations

import functools
import json
import os
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import InvalidState, ValueProblem
from ..functions.cells import CELL_TYPES
from ..sources import codecs
from ..sources.meshfile import MeshFileSource, extension, mesh_parts, open_piece
from ..sources.scratch import discard, materialise, scratch_dir
from ..sources.vtkxml import DEFAULT_FORMAT, FORMATS, POLY_GROUPS, Grid, Stored, WriteOptions, chunk_rows, file_stamp, series_steps, store_chunk, three, write_grid, write_parallel_index, write_series_index

#: Pieces of more points or cells, or of more corners than CORNERS_EACH times that, are encoded in parts.
LARGE_PIECE, CORNERS_EACH = 500_000, 4
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


@dataclass
class Frame:
    """What structured grids have besides their tables; extents by (step, piece), if there are several."""

    whole_extent: list[int]
    extents: dict[tuple[int, int], list[int]] = field(default_factory=dict)
    origin: tuple[float, ...] = (0.0, 0.0, 0.0)
    spacing: tuple[float, ...] = (1.0, 1.0, 1.0)
    direction: tuple[float, ...] = IDENTITY
    ordinates: list[list[float]] | None = None

    def extent(self, step: int, piece: int) -> list[int]:
        return self.extents.get((step, piece), self.whole_extent)


@dataclass
class Mesh:
    """points(point_id, x, y, z), cells(cell_id, cell_type, corners), and fields by id."""

    kind: str
    points: DataFrame | None
    cells: DataFrame | None
    point_data: DataFrame | None = None
    cell_data: DataFrame | None = None
    meta: dict[str, object] = field(default_factory=dict)
    frame: Frame | None = None
    times: dict[int, float] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return next(t for t in (self.points, self.cells, self.point_data, self.cell_data) if t is not None).sparkSession

    def default_format(self) -> str:
        """The format of the grid's kind."""
        return DEFAULT_FORMAT[self.kind]


def _keyed(df: DataFrame | None) -> DataFrame | None:
    if df is None:
        return None
    for c in ("piece", "step"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0))
    return df.select(F.col("step").cast("int").alias("step"), F.col("piece").cast("int").alias("piece"), *[c for c in df.columns if c not in ("step", "piece")])


def _joined(entities: DataFrame | None, data: DataFrame | None, id_column: str) -> DataFrame | None:
    entities, data = _keyed(entities), _keyed(data)
    if entities is None or data is None:
        return data if entities is None else entities
    return entities.join(data, ["step", "piece", id_column], "left")


def to_numpy(column: pa.ChunkedArray) -> np.ndarray:
    """A scalar, vector or tensor field's values; their sizes must be equal."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    shape = [len(a)]
    while pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        if a.null_count:
            raise ValueProblem("fields can't have missing vectors")
        sizes = np.diff(a.offsets.to_numpy())
        if len(sizes) and (sizes != sizes[0]).any():
            raise ValueProblem("a field's vectors differ in size")
        shape.append(int(sizes[0]) if len(sizes) else 0)
        a = a.flatten()
    if a.null_count:
        raise ValueProblem("fields can't have missing values: mesh files have none")
    if pa.types.is_decimal(a.type):
        return np.array([int(x) for x in a.to_pylist()], np.uint64).reshape(shape)
    return a.to_numpy(zero_copy_only=False).reshape(shape)


_FIXED_COLUMNS = {"step", "piece", "point_id", "cell_id", "x", "y", "z", "i", "j", "k", "cell_type", "vtk_type", "corners"}


def _fields(table: pa.Table, precision: dict[str, str]) -> dict[str, np.ndarray]:
    out = {}
    for name in table.column_names:
        if name not in _FIXED_COLUMNS and not name.startswith("_"):
            values = to_numpy(table.column(name))
            out[name] = values.astype(codecs.dtype_of(precision[name])) if name in precision else values
    return out


def write_mesh(mesh: Mesh, path: str, format: str | None = None, precision: dict[str, str] | None = None, pieces: bool | None = None, **options) -> str:
    """Write a mesh and return the path of the file to open.

    One piece gives one file, several give `<base>-<piece>` and an index of extension p<format>; several steps give
    `<base>-<step>` of five digits and a .pvd collection. Options are those of WriteOptions.of (encoder, data_format,
    compressor, header_type, coordinates, block_bytes); precision says how fields are stored, if not as their columns.
    """
    base, ext = os.path.splitext(path)
    series = bool(mesh.times) or ext == ".pvd"
    format = format or (ext.lstrip(".").removeprefix("p") if ext.lstrip(".").removeprefix("p") in FORMATS else mesh.default_format())
    written = _write_pieces(mesh, base, format, WriteOptions.of(**options), precision or {}, series, pieces if pieces is not None else ext.startswith(".p") and not series)
    by_step: dict[int, list[dict]] = {}
    for w in written:
        by_step.setdefault(w["step"], []).append(w)
    entries = []
    for step, parts in sorted(by_step.items()):
        entries.append((mesh.times.get(step, float(step)), os.path.basename(_write_index(mesh, base, format, step, parts, series))))
    if not series:
        if len(entries) != 1:
            raise InvalidState("a mesh of several steps needs a collection (.pvd)")
        return os.path.join(os.path.dirname(base), entries[0][1])
    write_series_index(f"{base}.pvd", entries)
    return f"{base}.pvd"


def _step_base(base: str, step: int, series: bool) -> str:
    return f"{base}-{step:05d}" if series else base


def _write_index(mesh: Mesh, base: str, format: str, step: int, parts: list[dict], series: bool) -> str:
    parts = sorted(parts, key=lambda w: w["piece"])
    if len(parts) == 1 and not parts[0]["numbered"]:
        return parts[0]["file"]
    said = [json.loads(w["fields"]) for w in parts]
    if any(s != said[0] for s in said):
        raise ValueProblem("pieces differ in their fields")
    path = f"{_step_base(base, step, series)}.p{format}"
    grid = None
    extents = None
    if mesh.frame:
        f = mesh.frame
        grid = Grid(mesh.kind, whole_extent=f.whole_extent, origin=f.origin, spacing=f.spacing, direction=f.direction)
        extents = [f.extent(step, w["piece"]) for w in parts]
    fields = {s: {n: tuple(x) for n, x in v.items()} for s, v in said[0].items() if s != "coordinates"}
    write_parallel_index(path, format, [os.path.basename(w["file"]) for w in parts], fields, said[0].get("coordinates", "Float64"), grid, extents)
    return path


def _write_pieces(mesh: Mesh, base: str, format: str, options: WriteOptions, precision: dict[str, str], series: bool, numbered: bool) -> list[dict]:
    points = _joined(mesh.points, mesh.point_data, "point_id")
    cells = _joined(mesh.cells, mesh.cell_data, "cell_id")
    structured = FORMATS[format][1] != "unstructured"
    if structured and FORMATS[format][1] != mesh.kind:
        raise ValueProblem(f"a {mesh.kind} grid can't be written as {format}")
    spark = mesh.spark
    if mesh.frame:
        known = list(mesh.frame.extents) or [(0, 0)]
        keys = spark.createDataFrame(known, "step int, piece int")
        empty = spark.createDataFrame([], "step int, piece int, point_id bigint")
        points = keys.join(points if points is not None else empty, ["step", "piece"], "left")
    if cells is None:
        cells = spark.createDataFrame([], "step int, piece int, cell_id bigint")
    points, cells = Ranged(points, "point_id"), Ranged(cells, "cell_id", format == "vtp")
    several = len({p for _, p in (mesh.frame.extents if mesh.frame else points.sizes)}) > 1
    numbered = numbered or several
    frame, kind, meta, times = mesh.frame, mesh.kind, mesh.meta, mesh.times
    large = [key for key in {**points.sizes, **cells.sizes} if points.rows(key) > LARGE_PIECE or cells.rows(key) > LARGE_PIECE or cells.corners(key) > CORNERS_EACH * LARGE_PIECE]

    def frame_of(grid: Grid, step: int, piece: int) -> None:
        if frame:
            grid.whole_extent, grid.extent = frame.whole_extent, frame.extent(step, piece)
            grid.origin, grid.spacing, grid.direction = frame.origin, frame.spacing, frame.direction
            if frame.ordinates:
                w, e = frame.whole_extent, grid.extent
                grid.ordinates = [np.array(frame.ordinates[a][e[2 * a] - w[2 * a] : e[2 * a + 1] - w[2 * a] + 1], np.float64) for a in range(3)]

    def written(grid: Grid, step: int, piece: int) -> pa.Table:
        more = {"TimeValue": np.array([times[step]])} if step in times else {}
        grid.meta = meta | more
        file = f"{_step_base(base, step, series)}{f'-{piece}' if numbered else ''}.{format}"
        write_grid(file, format, grid, options)
        described = lambda fields: {n: (codecs.type_name(v.dtype), max(3 ** (v.ndim - 1), int(np.prod(v.shape[1:]))) if v.ndim > 1 else 1) for n, v in fields.items()}
        fields = {"PPointData": described(grid.point_fields), "PCellData": described(grid.cell_fields), "coordinates": options.coordinates or "Float64"}
        return pa.table({"step": [step], "piece": [piece], "file": [file], "numbered": [numbered], "fields": [json.dumps(fields)]}, _WRITTEN)

    def write(left: pa.Table, right: pa.Table) -> pa.Table:
        some = left if left.num_rows else right
        step, piece = some.column("step")[0].as_py(), some.column("piece")[0].as_py()
        left = left.filter(left.column("point_id").is_valid())
        left, right = left.sort_by("point_id"), right.sort_by("cell_id")
        grid = Grid(kind, _fields(left, precision), _fields(right, precision))
        if "x" in left.column_names:
            grid.points = np.stack([left.column(c).to_numpy() for c in "xyz"], 1)
        frame_of(grid, step, piece)
        if not structured:
            ids = left.column("point_id").to_numpy()
            corners = right.column("corners").combine_chunks() if "corners" in right.column_names else pa.array([], pa.list_(pa.int64()))
            flat = corners.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(ids, flat), max(0, len(ids) - 1))
            if len(flat) and (not len(ids) or (ids[at] != flat).any()):
                raise ValueProblem(f"piece {piece}: cells have corners that aren't among its points")
            grid.corners = at
            grid.offsets = np.r_[0, np.cumsum(np.diff(corners.offsets.to_numpy()))] if len(corners) else np.zeros(1, np.int64)
            grid.types = right.column("cell_type").to_pylist() if "cell_type" in right.column_names else []
        return written(grid, step, piece)

    out = []
    if len(large) < len({**points.sizes, **cells.sizes}):
        left, right = points.without(large).groupBy("step", "piece"), cells.without(large).groupBy("step", "piece")
        out = left.cogroup(right).applyInArrow(write, _WRITTEN_SQL).collect()  # a row a file
    if large:
        stored, folder = _stored_grids(mesh, large, points, cells, format, options, precision)
        for grid, step, piece in stored:
            frame_of(grid, step, piece)

        def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for packed in batch.column(0).to_pylist():
                    yield from written(*pickle.loads(packed)).to_batches()

        plans = spark.createDataFrame([(bytearray(pickle.dumps(x)),) for x in stored], "grid binary")
        out += plans.repartition(len(stored)).mapInArrow(string, _WRITTEN_SQL).collect()
        discard(spark, folder)
    points.discard()
    cells.discard()
    return [r.asDict() for r in out]


_WRITTEN = pa.schema([("step", pa.int32()), ("piece", pa.int32()), ("file", pa.string()), ("numbered", pa.bool_()), ("fields", pa.string())])
_WRITTEN_SQL = "step int, piece int, file string, numbered boolean, fields string"


class Ranged:
    """Points or cells in the order of their ids within pieces, dealt out by range and written down, with their counts.

    `counts` has (step, piece, group, range) -> (rows, corners) in order; groups are those of poly data, else 0. Rows of
    null id (pieces without points) and cells of no group have no number.
    """

    def __init__(self, df: DataFrame, id_column: str, grouped: bool = False):
        self.id_column = id_column
        group = F.lit(0)
        if grouped and "cell_type" in df.columns:
            group = F.coalesce(*[F.when(F.col("cell_type").isin(*names), k) for k, names in enumerate(POLY_GROUPS.values())], F.lit(-1))
        size = F.coalesce(F.greatest(F.size("corners"), F.lit(0)), F.lit(0)).cast("bigint") if "corners" in df.columns else F.lit(0).cast("bigint")
        df = df.withColumns({"_group": group, "_size": size})
        df = df.repartitionByRange("step", "piece", "_group", id_column).withColumn("_range", F.spark_partition_id())
        self.table = materialise(df)
        n = F.count_if(F.col(id_column).isNotNull() & (F.col("_group") >= 0))
        rows = self.table.groupBy("step", "piece", "_group", "_range").agg(n.alias("n"), F.sum("_size").alias("corners")).collect()  # a row a piece, and one a range
        self.counts = {(r["step"], r["piece"], r["_group"], r["_range"]): (r["n"], r["corners"]) for r in sorted(rows)}
        self.sizes: dict[tuple[int, int], list[int]] = {}
        for (step, piece, group, _), (n, corners) in self.counts.items():
            of = self.sizes.setdefault((step, piece), [0, 0])
            if group >= 0:
                of[:] = of[0] + n, of[1] + corners

    def rows(self, key: tuple[int, int]) -> int:
        return self.sizes.get(key, (0, 0))[0]

    def corners(self, key: tuple[int, int]) -> int:
        return self.sizes.get(key, (0, 0))[1]

    def in_group(self, key: tuple[int, int], group: int) -> tuple[int, int]:
        """Rows and corners of a group."""
        of = [x for (step, piece, g, _), x in self.counts.items() if (step, piece, g) == (*key, group)]
        return sum(n for n, _ in of), sum(c for _, c in of)

    def without(self, keys: list[tuple[int, int]]) -> DataFrame:
        """The table without some pieces, as it was."""
        df = self.table.drop("_group", "_size", "_range")
        return df.join(F.broadcast(df.sparkSession.createDataFrame(keys, "step int, piece int")), ["step", "piece"], "left_anti") if keys else df

    def numbered(self, keys: list[tuple[int, int]]) -> DataFrame:
        """The rows of some pieces with their number in the piece (_n) and in the group (_m), and the corners up to theirs (_end)."""
        firsts, of_piece, of_group, wanted = [], {}, {}, set(keys)
        for (step, piece, group, number), (n, corners) in self.counts.items():
            if group >= 0 and (step, piece) in wanted:
                before, (at, ends) = of_piece.get((step, piece), 0), of_group.get((step, piece, group), (0, 0))
                firsts.append((step, piece, group, number, before, at, ends))
                of_piece[step, piece], of_group[step, piece, group] = before + n, (at + n, ends + corners)
        on = ["step", "piece", "_group", "_range"]
        firsts = self.table.sparkSession.createDataFrame(firsts, "step int, piece int, _group int, _range int, _first bigint, _first_of_group bigint, _first_end bigint")
        inside = Window.partitionBy(*on).orderBy(self.id_column)
        df = self.table.where(F.col(self.id_column).isNotNull()).join(F.broadcast(firsts), on)
        df = df.withColumns({"_place": F.row_number().over(inside) - 1, "_upto": F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
        named = {"_n": F.col("_first") + F.col("_place"), "_m": F.col("_first_of_group") + F.col("_place"), "_end": F.col("_first_end") + F.col("_upto")}
        return df.withColumns(named).drop("_range", "_first", "_first_of_group", "_first_end", "_place", "_upto")

    def discard(self) -> None:
        discard(self.table.sparkSession, self.table.scratch_path)


_CHUNK_SQL = "step int, piece int, array string, chunk bigint, path string, type string, n bigint, shape array<bigint>, bytes bigint"


def _stored_grids(mesh: Mesh, keys: list[tuple[int, int]], points: Ranged, cells: Ranged, format: str, options: WriteOptions, precision: dict[str, str]) -> tuple[list[tuple[Grid, int, int]], str]:
    """Grids of large pieces whose arrays tasks have encoded in parts, and the folder of these.

    No task holds more than chunk_rows of a table (CORNERS_EACH times as many corners).
    """
    spark, rows_each = mesh.spark, chunk_rows(options)
    folder = scratch_dir(spark)
    header = options.header_type.replace("U", "")
    structured = FORMATS[format][1] != "unstructured"
    store = functools.partial(_store_chunk, folder, options)

    def of_points(t: pa.Table) -> pa.Table:
        t = t.sort_by("_n")
        arrays = {f"point {n}": (v, None) for n, v in _fields(t, precision).items()}
        if "x" in t.column_names and format in ("vtu", "vtp", "vts"):
            arrays["points"] = np.stack([t.column(c).to_numpy() for c in "xyz"], 1), options.coordinates
        return store(t, arrays)

    def of_cells(t: pa.Table) -> pa.Table:
        t = t.sort_by("_n")
        arrays = {f"cell {n}": (v, None) for n, v in _fields(t, precision).items()}
        if format == "vtu":
            arrays["types"] = np.array([CELL_TYPES[x] for x in t.column("cell_type").to_pylist()], np.uint8), None
        return store(t, arrays)

    def of_ends(t: pa.Table) -> pa.Table:
        return store(t, {f"offsets {t.column('_group')[0]}": (t.sort_by("_m").column("_end").to_numpy(), header)})

    def of_corners(t: pa.Table) -> pa.Table:
        t = t.sort_by("_at")
        if t.column("_index").null_count:
            raise ValueProblem(f"piece {t.column('piece')[0]}: cells have corners that aren't among its points")
        return store(t, {f"connectivity {t.column('_group')[0]}": (t.column("_index").to_numpy(), header)})

    def in_chunks(rows: DataFrame, by: str, each: int, *keys: str):
        return rows.withColumn("_chunk", F.expr(f"{by} div {each}L")).groupBy("step", "piece", *keys, "_chunk")

    left = materialise(points.numbered(keys))
    jobs = [in_chunks(left, "_n", rows_each).applyInArrow(of_points, _CHUNK_SQL)]
    tables = [left]
    if cells.sizes:
        right = materialise(cells.numbered(keys))
        tables.append(right)
        jobs.append(in_chunks(right.drop("corners"), "_n", rows_each).applyInArrow(of_cells, _CHUNK_SQL))
        if not structured and "corners" in right.columns:
            ends = right.select("step", "piece", "_group", "_m", "_end")
            jobs.append(in_chunks(ends, "_m", rows_each, "_group").applyInArrow(of_ends, _CHUNK_SQL))
            corners = right.select("step", "piece", "_group", (F.col("_end") - F.col("_size")).alias("_first"), F.posexplode("corners").alias("_pos", "point_id"))
            corners = corners.select("step", "piece", "_group", (F.col("_first") + F.col("_pos")).alias("_at"), "point_id")
            index = left.groupBy("step", "piece", "point_id").agg(F.min("_n").alias("_index"))
            met = corners.join(index, ["step", "piece", "point_id"], "left").select("step", "piece", "_group", "_at", "_index")
            jobs.append(in_chunks(met, "_at", rows_each * CORNERS_EACH, "_group").applyInArrow(of_corners, _CHUNK_SQL))
    said: dict[tuple, list] = {}
    for job in jobs:
        for r in job.collect():  # a row a part of an array
            said.setdefault((r["step"], r["piece"], r["array"]), []).append(r)
    for table in tables:
        discard(spark, table.scratch_path)
    grids = [_stored_grid(mesh.kind, key, said, cells, format) for key in keys]
    for key, grid in zip(keys, grids, strict=True):  # without rows there are no parts that would tell the fields
        grid.point_fields = grid.point_fields if points.rows(key) else _fields(to_arrow_schema(points.table.schema).empty_table(), precision)
        grid.cell_fields = grid.cell_fields if cells.rows(key) else _fields(to_arrow_schema(cells.table.schema).empty_table(), precision)
    return [(grid, *key) for key, grid in zip(keys, grids, strict=True)], folder


def _store_chunk(folder: str, options: WriteOptions, t: pa.Table, arrays: dict[str, tuple[np.ndarray, str | None]]) -> pa.Table:
    """Encode parts of arrays that a task has; says what they are."""
    step, piece, number = (t.column(c)[0].as_py() for c in ("step", "piece", "_chunk"))
    out = []
    for k, (name, (values, type_name)) in enumerate(arrays.items()):
        values = three(values)
        path = f"{folder}/{step}-{piece}-{name.split(' ')[0]}-{name.split(' ')[-1] if name.startswith(('offsets', 'conn')) else k}-{number}"
        size = store_chunk(path, values, type_name, options)
        out.append((step, piece, name, number, path, type_name or codecs.type_name(values.dtype), len(values), values.shape[1:], size))
    return pa.Table.from_pylist([dict(zip(_CHUNK.names, row, strict=True)) for row in out], _CHUNK)


_CHUNK = pa.schema([("step", pa.int32()), ("piece", pa.int32()), ("array", pa.string()), ("chunk", pa.int64()), ("path", pa.string()), ("type", pa.string()), ("n", pa.int64()), ("shape", pa.list_(pa.int64())), ("bytes", pa.int64())])


def _stored_grid(kind: str, key: tuple[int, int], said: dict[tuple, list], cells: Ranged, format: str) -> Grid:
    def array(name: str, type_name: str = "Int64") -> Stored | np.ndarray:
        parts = sorted(said.get((*key, name), []), key=lambda r: r["chunk"])
        if not parts:
            return np.zeros(0, codecs.dtype_of(type_name))
        if any((r["type"], r["shape"]) != (parts[0]["type"], parts[0]["shape"]) for r in parts):
            raise ValueProblem("a field's vectors differ in size")
        return Stored(parts[0]["type"], (sum(r["n"] for r in parts), *parts[0]["shape"]), [r["path"] for r in parts], sum(r["bytes"] for r in parts))

    named = lambda prefix: {n.removeprefix(prefix): array(n) for step, piece, n in said if (step, piece) == key and n.startswith(prefix)}
    grid = Grid(kind, named("point "), named("cell "))
    grid.points = array("points", "Float64") if (*key, "points") in said else np.zeros((0, 3))
    if FORMATS[format][1] == "unstructured":
        groups = {"Cells": 0} if format == "vtu" else {g: k for k, g in enumerate(POLY_GROUPS)}
        grid.groups = {g: (cells.in_group(key, k)[0], array(f"connectivity {k}"), array(f"offsets {k}")) for g, k in groups.items()}
        grid.type_ids = array("types", "UInt8")
    return grid


class SeriesWriter:
    """A collection that grows step by step; its index is written anew after each."""

    def __init__(self, path: str, **options):
        self.base, ext = os.path.splitext(path)
        if ext != ".pvd":
            raise ValueProblem("a series' path ends in .pvd")
        self.options = options
        self.entries: dict[int, tuple[float, str]] = {}
        if file_stamp(path):
            self.entries = {k: (t, os.path.basename(f)) for k, (t, f) in enumerate(series_steps(path))}

    def write_step(self, number: int, time: float, mesh: Mesh) -> str:
        """Write (or write again) one step."""
        meta = mesh.meta | {"TimeValue": np.array([float(time)])}
        file = write_mesh(replace(mesh, meta=meta, times={}), f"{self.base}-{number:05d}.{self.options.get('format') or mesh.default_format()}", **self.options)
        self.entries[number] = (float(time), os.path.basename(file))
        write_series_index(f"{self.base}.pvd", [self.entries[k] for k in sorted(self.entries)])
        return f"{self.base}.pvd"


def register(spark: SparkSession) -> None:
    """Make the data source known to a session, and let Spark push filters into it."""
    spark.dataSource.register(MeshFileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load_table(spark: SparkSession, path: str, table: str, fields: str = "*", **options) -> DataFrame:
    """A table of a mesh file."""
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("meshfile").options(**{"table": table, "fields": fields, "pushdown": pushdown} | options).load(path)


def read_mesh(spark: SparkSession, path: str) -> Mesh:
    """All tables of a file, with its pieces and steps as they are there."""
    parts = mesh_parts(path)
    first, piece = open_piece(parts[0])
    point_data, cell_data = load_table(spark, path, "point_data"), load_table(spark, path, "cell_data")
    frame = None
    if first.kind != "unstructured":
        extents = {(p.step, p.piece): open_piece(p)[1].extent() for p in parts}  # headers only
        whole = list(parts[0].whole) if parts[0].whole else piece.extent()
        frame = Frame(whole, extents)
        if first.kind == "image":
            origin, spacing, direction = first.image_frame()
            frame.origin, frame.spacing, frame.direction = tuple(map(float, origin)), tuple(map(float, spacing)), tuple(direction)
        if first.kind == "rectilinear":
            frame.ordinates = merged_ordinates([(open_piece(p)[1].extent(), open_piece(p)[0].ordinates(open_piece(p)[1])) for p in parts if p.step == parts[0].step], whole)
    meta = {}
    for a in first.meta.values():
        values = first.values(a, a.tuples)
        meta[a.name] = values.astype(np.uint8).tobytes().rstrip(b"\0").decode() if a.type == "String" else values
    times = {p.step: p.time for p in parts if p.time is not None}
    return Mesh(first.kind, load_table(spark, path, "points"), load_table(spark, path, "cells"), point_data, cell_data, meta, frame, times)


def merged_ordinates(pieces: list[tuple[list[int], list[np.ndarray]]], whole: list[int]) -> list[list[float]]:
    """Axes of the whole extent out of the pieces' own; each interval's shared point counts once."""
    out = []
    for a in range(3):
        axis = np.zeros(whole[2 * a + 1] - whole[2 * a] + 1)
        for extent, axes in pieces:
            axis[extent[2 * a] - whole[2 * a] : extent[2 * a + 1] - whole[2 * a] + 1] = axes[a]
        out.append(axis.tolist())
    return out


def stored_precision(df: DataFrame) -> dict[str, str]:
    """Stored number types of fields that were read, by column, so that writing again keeps them."""
    return {f.name: f.metadata["precision"] for f in df.schema if f.metadata and "precision" in f.metadata and not isinstance(f.dataType, T.StringType)}


__all__ = ["Frame", "Mesh", "SeriesWriter", "extension", "load_table", "merged_ordinates", "read_mesh", "register", "stored_precision", "write_mesh"]
