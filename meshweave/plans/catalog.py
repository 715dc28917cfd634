"""The queries over the shared test tables, and the SQL that says what each returns."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValueProblem
from ..functions import arrays
from ..functions.cells import cell_type_table
from ..functions.layout import Layout, flat_index_first_fastest, flat_index_last_fastest, inverse_index
from ..operators import grids, pieces, topology, transforms
from ..operators.mesh import Mesh, load_table, to_numpy, write_mesh
from ..sources import codecs
from ..sources.meshfile import mesh_parts, open_piece
from ..sources.scratch import scratch_dir
from . import tables
from .convert import convert, info

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_VECTOR = T.ArrayType(T.DoubleType())


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


_V = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
_CELLS = "SELECT l_orderkey AS cell_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS corners FROM lineitem GROUP BY l_orderkey"
_TYPE = "CASE len(corners) WHEN 1 THEN 'vertex' WHEN 2 THEN 'segment' WHEN 3 THEN 'triangle' WHEN 4 THEN 'quadrilateral' ELSE 'polygon' END"
_NY = "(SELECT count(*) // 20 FROM part)"
_GRID_POINTS = f"SELECT point_id, point_id % 20 AS i, point_id // 20 AS j, price FROM (SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS point_id, p_retailprice AS price FROM part) WHERE point_id < 20 * {_NY}"


# --- field algebra ---


@_query(f"SELECT vec_id * 64 + generate_subscripts(v, 1) - 1 AS entry, unnest(v) AS value FROM ({_V})")
def field_flatten(spark, sf_dir):
    return arrays.flatten_field(_vectors(spark, sf_dir), "vec_id", "v", 64)


@_query(f"SELECT vec_id, list_transform(range(0, 8), lambda r: v[r * 8 + 1 : r * 8 + 8]) AS m FROM ({_V})")
def field_reshape(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", arrays.reshape(F.col("v"), (8, 8), 64).alias("m"))


@_query(f"SELECT vec_id, list_concat(v[1:2], [0.0::DOUBLE]) AS padded, list_concat(v, [0.0::DOUBLE, 0.0::DOUBLE]) AS longer FROM ({_V})")
def field_extend(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", arrays.pad_to_3d(F.slice("v", 1, 2), _VECTOR).alias("padded"), arrays.extend(F.col("v"), _VECTOR, [66]).alias("longer"))


@_query(f"SELECT vec_id, [list_concat(v[1:2], [0.0::DOUBLE]), list_concat(v[3:4], [0.0::DOUBLE]), [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]] AS t FROM ({_V})")
def field_extend_all(spark, sf_dir):
    tensor = arrays.reshape(F.slice("v", 1, 4), (2, 2), 4)
    return _vectors(spark, sf_dir).select("vec_id", arrays.extend_all(tensor, T.ArrayType(_VECTOR), 3).alias("t"))


@_query(f"SELECT vec_id - 10 AS vec_id, v[3:5] AS v FROM ({_V}) WHERE vec_id >= 10 AND vec_id < 200")
def field_slice(spark, sf_dir):
    return arrays.slice_field(_vectors(spark, sf_dir), "vec_id", "v", (10, 2), (200, 5))


@_query(
    "SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS id, p_retailprice AS value FROM part UNION ALL "
    "SELECT s_suppkey - (SELECT min(s_suppkey) FROM supplier) + (SELECT count(*) FROM part) AS id, s_acctbal AS value FROM supplier"
)
def field_merge(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part")
    p = p.select((F.col("p_partkey") - p.agg(F.min("p_partkey")).first()[0]).alias("id"), F.col("p_retailprice").alias("value"))
    s = tables.table(spark, sf_dir, "supplier")
    low = s.agg(F.min("s_suppkey")).first()[0]
    s = s.select((F.col("s_suppkey") - low).alias("id"), F.col("s_acctbal").alias("value"))
    return arrays.merge_fields([p, s], [p.count(), s.count()], "id")


@_query(f"SELECT vec_id, [v[1:3]] AS sub FROM ({_V})")
def field_subfield(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", arrays.as_sub_field(F.slice("v", 1, 3)).alias("sub"))


@_query(f"SELECT vec_id, round(list_dot_product(v, v), 6) AS dot FROM ({_V})")
def field_dot(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(arrays.dot_product(F.col("v"), F.col("v")), 6).alias("dot"))


@_query("SELECT p_partkey, trunc(p_retailprice)::INTEGER AS whole, p_size::SMALLINT AS small FROM part")
def field_cast(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part")
    return p.select("p_partkey", arrays.cast_field(F.col("p_retailprice"), T.DoubleType(), T.IntegerType()).alias("whole"), arrays.cast_field(F.col("p_size"), T.IntegerType(), T.ShortType()).alias("small"))


@_query(f"SELECT vec_id, [[v[1], v[3]], [v[2], v[4]]] AS t FROM ({_V})")
def field_transpose(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", arrays.transpose(arrays.reshape(F.slice("v", 1, 4), (2, 2), 4)).alias("t"))


@_query("SELECT p_partkey, sqrt(p_size::DOUBLE) * 2 AS f, (p_size * 2)::FLOAT AS g FROM part")
def field_computed(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    p = transforms.computed_field(p, "f", F.sqrt(F.col("p_size").cast("double")) * 2)
    return transforms.computed_field(p, "g", F.col("p_size") * 2, "float").drop("p_size")


@_query("SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS ordinates FROM orders GROUP BY o_custkey")
def ordinates_unique(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return o.select("o_custkey", arrays.sort_and_unique(F.col("p")).alias("ordinates"))


@_query(
    "SELECT p_brand, p_retailprice FROM (SELECT *, p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS gap "
    "FROM (SELECT DISTINCT p_brand, p_retailprice FROM part)) WHERE gap IS NULL OR gap > 5.0"
)
def ordinates_tolerant(spark, sf_dir):
    return arrays.unique_within(tables.table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 5.0)


# --- grids ---


@_query(f"SELECT n AS point_id, n % 21 AS i, n // 21 AS j, 0::BIGINT AS k, 0.1 + (n % 21)::DOUBLE * 0.5 AS x, 0.2 + (n // 21)::DOUBLE * 0.25 AS y, 0.0::DOUBLE AS z FROM range(0, 21 * ({_NY} + 1)) t(n)".replace("0.1 +", "0.1::DOUBLE +").replace("0.2 +", "0.2::DOUBLE +"))
def image_points(spark, sf_dir):
    ny = tables.table(spark, sf_dir, "part").count() // 20
    return grids.image_grid(spark, [10.0, ny * 0.25], [20, ny], [0.1, 0.2]).points


def _part_cells(spark, sf_dir):
    return [20, tables.table(spark, sf_dir, "part").count() // 20]


_P = "(n % 20) + (n // 20) * 21"


@_query(f"SELECT n AS cell_id, 'pixel' AS cell_type, [{_P}, {_P} + 1, {_P} + 21, {_P} + 22] AS corners FROM range(0, 20 * {_NY}) t(n)")
def image_cells(spark, sf_dir):
    return grids.image_grid(spark, [10.0, 1.0], _part_cells(spark, sf_dir)).cells.select("cell_id", "cell_type", "corners")


@_query(f"SELECT n AS cell_id, ((n % 20) + 0.5) * 0.5::DOUBLE AS x, ((n // 20) + 0.5) * 0.25::DOUBLE AS y, 0.0::DOUBLE AS z FROM range(0, 20 * {_NY}) t(n)")
def image_centers(spark, sf_dir):
    cells = _part_cells(spark, sf_dir)
    mesh = grids.image_grid(spark, [10.0, cells[1] * 0.25], cells)
    return topology.cell_centers(mesh.cells, mesh.points)


@_query(
    "WITH a AS (SELECT row_number() OVER (ORDER BY v) - 1 AS index, v FROM (SELECT DISTINCT p_size::DOUBLE AS v FROM part)), "
    "b AS (SELECT row_number() OVER (ORDER BY v) - 1 AS index, v FROM (SELECT DISTINCT r_regionkey::DOUBLE AS v FROM region)) "
    "SELECT a.index + (SELECT count(*) FROM a) * b.index AS point_id, a.v AS x, b.v AS y, 0.0::DOUBLE AS z FROM a, b"
)
def rectilinear_points(spark, sf_dir):
    axis = lambda t, c: topology.running_index(tables.table(spark, sf_dir, t).select(F.col(c).cast("double").alias("ordinate")).distinct(), "ordinate")
    return grids.rectilinear_points([axis("part", "p_size"), axis("region", "r_regionkey")]).select("point_id", "x", "y", "z")


@_query(f"SELECT n AS cell_id, 'quadrilateral' AS cell_type, [{_P}, {_P} + 1, {_P} + 22, {_P} + 21] AS corners FROM range(0, 20 * {_NY}) t(n)")
def structured_cells_2d(spark, sf_dir):
    return grids.structured_cells(spark, [*_part_cells(spark, sf_dir), 0], False).select("cell_id", "cell_type", "corners")


_Q = "(n % 4) + ((n // 4) % 5) * 5 + (n // 20) * 30"


@_query(f"SELECT n AS cell_id, 'hexahedron' AS cell_type, [{', '.join(f'{_Q} + {c}' for c in (0, 1, 6, 5, 30, 31, 36, 35))}] AS corners FROM range(0, 20 * {_NY}) t(n)")
def structured_cells_3d(spark, sf_dir):
    return grids.structured_cells(spark, [4, 5, _part_cells(spark, sf_dir)[1]], False).select("cell_id", "cell_type", "corners")


@_query(f"SELECT n AS cell_id, 'quadrilateral' AS cell_type, [n % 20 + n // 20 * 21, n % 20 + n // 20 * 21 + 1, n % 20 + n // 20 * 21 + 22, n % 20 + n // 20 * 21 + 21] AS corners FROM range(0, 20 * {_NY}) t(n)")
def structured_cells_yz(spark, sf_dir):
    return grids.structured_cells(spark, [0, *_part_cells(spark, sf_dir)], False).select("cell_id", "cell_type", "corners")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber + 10 * (l_suppkey % 7) + 70 * (l_partkey % 5) AS first_fastest, (l_linenumber * 7 + l_suppkey % 7) * 5 + l_partkey % 5 AS last_fastest FROM lineitem")
def flat_index(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    index = [F.col("l_linenumber").cast("bigint"), F.col("l_suppkey") % 7, F.col("l_partkey") % 5]
    return li.select("l_orderkey", "l_linenumber", "l_partkey", flat_index_first_fastest(index, [10, 7, 5]).alias("first_fastest"), flat_index_last_fastest(index, [10, 7, 5]).alias("last_fastest"))


@_query("SELECT o_orderkey, o_orderkey % 11 AS i, (o_orderkey // 11) % 1 AS j, (o_orderkey // 11) % 13 AS k FROM orders")
def inverse_flat_index(spark, sf_dir):
    i, j, k = inverse_index(F.col("o_orderkey"), [11, 0, 13])
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", i.alias("i"), j.alias("j"), k.alias("k"))


@_query("SELECT p_partkey, 1.0 + (-1.0) * ((p_partkey // 20)::DOUBLE * 0.25) AS x, 2.0 + (p_partkey % 20)::DOUBLE * 0.5 AS y, 3.0 + p_size::DOUBLE * 2.0 AS z FROM part".replace("1.0 + (-1.0)", "1.0::DOUBLE + (-1.0::DOUBLE)"))
def direction_transform(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part")
    index = [F.col("p_partkey") % 20, F.floor(F.col("p_partkey") / 20), F.col("p_size")]
    return p.select("p_partkey", *grids.direction_transform(index, (1, 2, 3), (0.5, 0.25, 2.0), (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)))


@_query(f"SELECT len(corners) AS n, {_TYPE} AS cell_type, count(*) AS cells, any_value(CASE len(corners) WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 9 ELSE 7 END) AS vtk_type FROM ({_CELLS}) GROUP BY ALL")
def cell_types(spark, sf_dir):
    c = tables.order_cells(spark, sf_dir).groupBy(F.size("corners").cast("bigint").alias("n"), "cell_type").agg(F.count("*").alias("cells"))
    return c.join(F.broadcast(cell_type_table(spark)), "cell_type").select("n", "cell_type", "cells", "vtk_type")


# --- topology and transforms ---


@_query("SELECT p_partkey AS point_id, row_number() OVER (ORDER BY p_partkey) - 1 AS index FROM part")
def point_id_map(spark, sf_dir):
    return topology.point_id_map(tables.part_points(spark, sf_dir))


@_query(f"SELECT cell_id, pos, c - (SELECT min(p_partkey) FROM part) AS index FROM (SELECT cell_id, generate_subscripts(corners, 1)::INTEGER - 1 AS pos, unnest(corners) AS c FROM ({_CELLS}))")
def connectivity(spark, sf_dir):
    return topology.connectivity(tables.order_cells(spark, sf_dir), topology.point_id_map(tables.part_points(spark, sf_dir)))


@_query(f'SELECT cell_id, (sum(len(corners)) OVER (ORDER BY cell_id))::BIGINT AS "offset" FROM ({_CELLS})')
def offsets(spark, sf_dir):
    return topology.offsets(tables.order_cells(spark, sf_dir))


@_query(f"SELECT (SELECT count(*) FROM part) AS n_points, count(*) AS n_cells, sum(len(corners))::BIGINT AS n_corners FROM ({_CELLS})")
def entity_counts(spark, sf_dir):
    return topology.counts(tables.part_points(spark, sf_dir), tables.order_cells(spark, sf_dir))


@_query("SELECT p_partkey AS point_id, [p_size::DOUBLE, p_retailprice, 0.0::DOUBLE] AS coordinates FROM part")
def coordinates(spark, sf_dir):
    return topology.coordinates_column(tables.part_points(spark, sf_dir), ["x", "y"])


@_query(f"SELECT cell_id, {_TYPE} AS cell_type, corners FROM ({_CELLS}) WHERE len(corners) IN (3, 4)")
def filter_cells(spark, sf_dir):
    mesh = Mesh("unstructured", None, tables.order_cells(spark, sf_dir))
    return transforms.filter_cells(mesh, transforms.of_types("triangle", "quadrilateral")).cells.select("cell_id", "cell_type", "corners")


@_query(f"SELECT cell_id, pos, host_point, p_size::DOUBLE AS x, p_retailprice AS y, 0.0::DOUBLE AS z FROM (SELECT cell_id, generate_subscripts(corners, 1)::INTEGER - 1 AS pos, unnest(corners) AS host_point FROM ({_CELLS})) JOIN part ON p_partkey = host_point")
def discontinuous(spark, sf_dir):
    return transforms.discontinuous(tables.order_cells(spark, sf_dir), tables.part_points(spark, sf_dir))


@_query(f"SELECT cell_id, row_number() OVER (ORDER BY cell_id, pos) - 1 AS point_id, partkey FROM (SELECT cell_id, generate_subscripts(corners, 1) AS pos, unnest(corners) AS partkey FROM ({_CELLS}))")
def discontinuous_mesh(spark, sf_dir):
    mesh = transforms.make_discontinuous(tables.order_mesh(spark, sf_dir))
    return mesh.cells.select("cell_id", F.explode("corners").alias("point_id")).join(mesh.point_data.select("point_id", "partkey"), "point_id").select("cell_id", "point_id", "partkey")


_LINES = f"SELECT cell_id, corners, CASE WHEN len(corners) = 1 THEN 'vertex' ELSE 'polyline' END AS t FROM ({_CELLS})"


def _polylines(spark, sf_dir):
    return tables.order_cells(spark, sf_dir).withColumn("cell_type", F.when(F.size("corners") == 1, "vertex").otherwise("polyline"))


_SEGMENTS = (
    f"SELECT cell_id AS host_cell, (p - 1)::INTEGER AS pos, 'segment' AS cell_type, [corners[p], corners[p + 1]] AS corners FROM (SELECT *, unnest(range(1, len(corners))) AS p FROM ({_LINES}) WHERE t = 'polyline') "
    f"UNION ALL SELECT cell_id, 0, 'vertex', corners FROM ({_LINES}) WHERE t = 'vertex'"
)


@_query(_SEGMENTS)
def polyline_segments(spark, sf_dir):
    return transforms.polyline_segments(_polylines(spark, sf_dir))


@_query(f"SELECT row_number() OVER (ORDER BY host_cell, pos) - 1 AS cell_id, host_cell AS orderkey, o_custkey AS custkey FROM ({_SEGMENTS}) JOIN orders ON o_orderkey = host_cell")
def polyline_cell_data(spark, sf_dir):
    mesh = Mesh("unstructured", None, _polylines(spark, sf_dir), None, tables.order_data(spark, sf_dir))
    return transforms.subdivide_polylines(mesh).cell_data.select("cell_id", "orderkey", "custkey")


@_query(f"SELECT cell_id, round(avg(p_size), 9) AS x, round(avg(p_retailprice), 6) AS y FROM (SELECT cell_id, unnest(corners) AS c FROM ({_CELLS})) JOIN part ON p_partkey = c GROUP BY cell_id")
def cell_centers(spark, sf_dir):
    return topology.cell_centers(tables.order_cells(spark, sf_dir), tables.part_points(spark, sf_dir)).select("cell_id", F.round("x", 9).alias("x"), F.round("y", 6).alias("y"))


@_query("SELECT p_partkey AS point_id, [p_size::DOUBLE, p_retailprice] AS position FROM part")
def export_points(spark, sf_dir):
    return transforms.export_points(tables.part_points(spark, sf_dir), 2)


# --- pieces ---

_LOCAL = "SELECT c_nationkey AS piece, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS local FROM customer"


@_query(
    f"WITH l AS ({_LOCAL}), f AS (SELECT piece, coalesce(sum(count(*)) OVER (ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, "
    "coalesce(sum(count(*) - 1) OVER (ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_cell FROM l GROUP BY piece) "
    "SELECT piece, local + first_cell AS cell_id, [local + first, local + 1 + first] AS corners FROM l JOIN f USING (piece) WHERE local + 1 < (SELECT count(*) FROM l m WHERE m.piece = l.piece)"
)
def unstructured_merge(spark, sf_dir):
    from pyspark.sql import Window

    c = tables.table(spark, sf_dir, "customer")
    local = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("bigint") - 1
    points = c.select(F.col("c_nationkey").alias("piece"), local.alias("point_id"))
    ends = F.lead("point_id").over(Window.partitionBy("piece").orderBy("point_id"))
    cells = points.withColumn("next", ends).where("next is not null").select("piece", F.col("point_id").alias("cell_id"), F.array("point_id", "next").alias("corners"))
    return pieces.unstructured_merge(points, cells)[1].select("piece", "cell_id", "corners")


@_query("SELECT id, max_by(v, piece) AS v FROM (SELECT user_id % 100 AS id, event_id % 7 AS piece, max(value) AS v FROM events GROUP BY ALL) GROUP BY id")
def structured_merge(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 100).alias("id"), (F.col("event_id") % 7).alias("piece")).agg(F.max("value").alias("v"))
    return pieces.structured_merge(e, "id", ["v"])


_PIECES = "SELECT n_nationkey AS piece, (n_nationkey % 5) * 1.5::DOUBLE AS o0, (n_nationkey // 5) * 2.0::DOUBLE AS o1, (n_nationkey % 5 + 1)::BIGINT AS e0, (n_nationkey // 5 + 2)::BIGINT AS e1 FROM nation"
_LAYOUT = (
    "SELECT piece, (dense_rank() OVER (ORDER BY o0) - 1)::INTEGER AS r0, (dense_rank() OVER (ORDER BY o1) - 1)::INTEGER AS r1, "
    "coalesce(sum(e0) OVER (PARTITION BY o1 ORDER BY o0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f0, "
    f"coalesce(sum(e1) OVER (PARTITION BY o0 ORDER BY o1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f1, e0, e1 FROM ({_PIECES})"
)


def _layout(spark, sf_dir):
    n = tables.table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("bigint")
    row = F.floor(k / 5)
    p = n.select(k.alias("piece"), ((k % 5) * 1.5).alias("o0"), (row * 2.0).alias("o1"), (k % 5 + 1).alias("e0"), (row + 2).alias("e1"))
    return pieces.piece_layout(p, 2)


@_query(f"SELECT piece::BIGINT AS piece, r0, r1, f0, f1 FROM ({_LAYOUT})")
def piece_layout(spark, sf_dir):
    return _layout(spark, sf_dir).select("piece", "r0", "r1", "f0", "f1")


@_query(f"SELECT max(f0 + e0) AS w0, max(f1 + e1) AS w1 FROM ({_LAYOUT})")
def whole_extent(spark, sf_dir):
    return pieces.whole_extent(_layout(spark, sf_dir), 2)


@_query("SELECT piece, n, coalesce(sum(n) OVER (ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM (SELECT c_nationkey AS piece, count(*) AS n FROM customer GROUP BY 1)")
def rank_prefix(spark, sf_dir):
    n = tables.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("piece")).agg(F.count("*").alias("n"))
    return pieces.exclusive_prefix(n, "piece", "n", "first")


@_query('SELECT a + b AS "index", min(ordinate) AS ordinate FROM (SELECT n_regionkey * 3 AS a, n_nationkey % 4 AS b, (n_regionkey * 3 + n_nationkey % 4) * 0.5::DOUBLE AS ordinate FROM nation) GROUP BY 1')
def merged_ordinates(spark, sf_dir):
    n = tables.table(spark, sf_dir, "nation")
    start, at = (F.col("n_regionkey") * 3).cast("bigint"), (F.col("n_nationkey") % 4).cast("bigint")
    return pieces.merge_ordinates(n.select(start.alias("start"), at.alias("at"), ((start + at) * 0.5).alias("ordinate")))


@_query("SELECT max(n) AS max, min(n) AS min, sum(n)::BIGINT AS sum FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)")
def reduce_min_max_sum(spark, sf_dir):
    return pieces.reduce_all(tables.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), "n")


@_query("SELECT list(n ORDER BY piece) AS gathered FROM (SELECT c_nationkey AS piece, count(*) AS n FROM customer GROUP BY 1)")
def gather_in_order(spark, sf_dir):
    n = tables.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("piece")).agg(F.count("*").alias("n"))
    return pieces.gather_in_order(n, "n")


@_query("SELECT p::INTEGER AS piece, list_transform(range(0, 5), lambda x: p * 5 + x) AS share FROM range(0, 5) t(p)")
def scatter_shares(spark, sf_dir):
    n = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("piece"), F.col("n_nationkey").cast("bigint").alias("v"))
    return pieces.scatter(pieces.gather_in_order(n, "v"), "gathered", 5)


# --- files ---

_ROUNDTRIP = f"SELECT cell_id AS orderkey, o_custkey AS custkey, o_totalprice AS totalprice, {_TYPE} AS cell_type, corners AS partkeys FROM ({_CELLS}) JOIN orders ON o_orderkey = cell_id"


def _read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells with their fields, corners as part keys read back from the points' field."""
    cells = load_table(spark, path, "cells").join(load_table(spark, path, "cell_data"), ["step", "piece", "cell_id"])
    keys = load_table(spark, path, "point_data", "partkey")
    corners = cells.select("piece", "cell_id", F.posexplode("corners").alias("pos", "point_id")).join(keys.drop("step"), ["piece", "point_id"])
    named = corners.groupBy("piece", "cell_id").agg(F.array_sort(F.collect_list(F.struct("pos", "partkey"))).alias("c"))
    named = named.select("piece", "cell_id", F.transform("c", lambda x: x["partkey"]).alias("partkeys"))
    return cells.join(named, ["piece", "cell_id"]).select("piece", "orderkey", "custkey", "totalprice", "cell_type", "partkeys")


def _vtu(name: str, ext: str = "vtu", **options) -> None:
    def roundtrip(spark, sf_dir):
        path = write_mesh(tables.order_mesh(spark, sf_dir), f"{scratch_dir(spark)}/orders.{ext}", **options)
        return _read_cells(spark, path).drop("piece")

    roundtrip.__name__ = name
    _query(_ROUNDTRIP)(roundtrip)


_vtu("mesh_vtu_roundtrip")
_vtu("mesh_vtu_roundtrip_ascii", encoder="ascii")
_vtu("mesh_vtu_roundtrip_raw", encoder="raw", compressor=None)
_vtu("mesh_vtu_roundtrip_base64", encoder="base64", data_format="inlined", compressor=None)
_vtu("mesh_vtu_roundtrip_zlib", encoder="raw", compressor="zlib")
_vtu("mesh_vtu_roundtrip_lzma", encoder="base64", compressor="lzma")
_vtu("mesh_vtu_roundtrip_lz4", encoder="raw", compressor="lz4", header_type="UInt32")
_vtu("vtp_roundtrip", "vtp")


def _pieced(name: str, ext: str) -> None:
    def roundtrip(spark, sf_dir):
        path = write_mesh(tables.pieced_order_mesh(spark, sf_dir), f"{scratch_dir(spark)}/orders.{ext}")
        return _read_cells(spark, path)

    roundtrip.__name__ = name
    _query(f"SELECT (custkey % 4)::INTEGER AS piece, * FROM ({_ROUNDTRIP})")(roundtrip)


_pieced("pvtu_roundtrip", "pvtu")
_pieced("pvtp_roundtrip", "pvtp")


def _points_of(spark: SparkSession, path: str) -> DataFrame:
    keys = ["step", "piece", "point_id"]
    return load_table(spark, path, "points").select(*keys, "x", "y", "z").join(load_table(spark, path, "point_data"), keys).drop("step")


_GRID_SQL = {
    "image": "1.0 + i::DOUBLE * 0.5 AS x, 2.0 + j::DOUBLE * 0.25 AS y, 0.0::DOUBLE AS z",
    "rectilinear": "(i * i)::DOUBLE AS x, j * 0.5::DOUBLE AS y, 0.0::DOUBLE AS z",
    "structured": "i + j * 0.25::DOUBLE AS x, j * 0.5::DOUBLE AS y, i * 0.125::DOUBLE AS z",
}


def _grid(kind: str, ext: str) -> None:
    def serial(spark, sf_dir):
        path = write_mesh(tables.part_grid(spark, sf_dir, kind), f"{scratch_dir(spark)}/parts.{ext}", encoder="raw")
        return _points_of(spark, path).drop("piece")

    def parallel(spark, sf_dir):
        path = write_mesh(tables.in_two_pieces(tables.part_grid(spark, sf_dir, kind)), f"{scratch_dir(spark)}/parts.p{ext}")
        return pieces.structured_merge(_points_of(spark, path), "point_id", ["x", "y", "z", "price"])

    def cells(spark, sf_dir):
        path = write_mesh(tables.in_two_pieces(tables.part_grid(spark, sf_dir, kind)), f"{scratch_dir(spark)}/parts.p{ext}")
        return load_table(spark, path, "cells").join(load_table(spark, path, "cell_data"), ["step", "piece", "cell_id"]).select("cell_id", "cell_type", "corners", "half")

    serial.__name__, parallel.__name__, cells.__name__ = f"{ext}_roundtrip", f"p{ext}_roundtrip", f"p{ext}_cells"
    _query(f"SELECT point_id, {_GRID_SQL[kind]}, price FROM ({_GRID_POINTS})")(serial)
    _query(f"SELECT point_id, {_GRID_SQL[kind]}, price + CASE WHEN j >= {_NY} // 2 THEN 0.25 ELSE 0.0 END::DOUBLE AS price FROM ({_GRID_POINTS})")(parallel)
    p = "(n % 19 + n // 19 * 20)"
    name, order = ("quadrilateral", (0, 1, 21, 20)) if kind == "structured" else ("pixel", (0, 1, 20, 21))
    corners = ", ".join(f"{p} + {c}" for c in order)
    _query(f"SELECT n AS cell_id, '{name}' AS cell_type, [{corners}] AS corners, n * 0.5::DOUBLE AS half FROM range(0, 19 * ({_NY} - 1)) t(n)")(cells)


_grid("image", "vti")
_grid("rectilinear", "vtr")
_grid("structured", "vts")

_SERIES = (
    "WITH d AS (SELECT date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE)::INTEGER AS step, hour(ts) AS h FROM events), "
    "g AS (SELECT step, range AS point_id FROM (SELECT DISTINCT step FROM d), range(0, 24)) "
    "SELECT step, point_id, (SELECT count(*) FROM d WHERE d.step = g.step AND d.h = g.point_id) AS n FROM g"
)
#: Steps are numbered in the order of their days; days without events have none.
_NUMBERED = f"SELECT (dense_rank() OVER (ORDER BY step) - 1)::INTEGER AS step, point_id, n, step * 0.25::DOUBLE AS time FROM ({_SERIES})"


def _series(spark, sf_dir, **options):
    return write_mesh(tables.event_series(spark, sf_dir), f"{scratch_dir(spark)}/days.pvd", "vti", **options)


@_query(f"SELECT step, point_id, n FROM ({_NUMBERED})")
def pvd_roundtrip(spark, sf_dir):
    return load_table(spark, _series(spark, sf_dir), "point_data").drop("piece")


@_query(f"SELECT DISTINCT step, time FROM ({_NUMBERED})")
def steps_table(spark, sf_dir):
    return load_table(spark, _series(spark, sf_dir), "steps").drop("file")


@_query(f"SELECT point_id, n FROM ({_NUMBERED}) WHERE step = 3")
def step_select(spark, sf_dir):
    return load_table(spark, _series(spark, sf_dir), "point_data", "n").where("step = 3").select("point_id", "n")


@_query(f"SELECT DISTINCT step, 'TimeValue' AS name, time AS value FROM ({_NUMBERED})")
def series_meta_data(spark, sf_dir):
    return load_table(spark, _series(spark, sf_dir), "meta_data").select("step", "name", F.element_at("numbers", 1).alias("value"))


@_query(f"SELECT point_id, {_GRID_SQL['image']}, price FROM ({_GRID_POINTS})")
def convert_vti_to_vtu(spark, sf_dir):
    folder = scratch_dir(spark)
    source = write_mesh(tables.part_grid(spark, sf_dir), f"{folder}/parts.vti")
    return _points_of(spark, convert(spark, source, f"{folder}/converted.vtu", encoder="raw", compressor="zlib")).drop("piece")


@_query(f"SELECT step, point_id, n FROM ({_NUMBERED})")
def convert_series(spark, sf_dir):
    source = _series(spark, sf_dir)
    return load_table(spark, convert(spark, source, f"{scratch_dir(spark)}/days.vtu"), "point_data").drop("piece")


@_query(f"SELECT 'unstructured' AS kind, (SELECT count(*) FROM part) AS n_points, count(*) AS n_cells FROM ({_CELLS})")
def grid_info(spark, sf_dir):
    path = write_mesh(tables.order_mesh(spark, sf_dir), f"{scratch_dir(spark)}/orders.vtu")
    return info(spark, path)[0].select("kind", "n_points", "n_cells")


@_query(
    f"WITH n AS (SELECT (SELECT count(*) FROM part) AS p, count(*) AS c FROM ({_CELLS})) SELECT * FROM (VALUES "
    "('point', 'pair', 'Float64', (SELECT p FROM n), 3), ('point', 'partkey', 'Int64', (SELECT p FROM n), 1), ('cell', 'custkey', 'Int64', (SELECT c FROM n), 1), "
    "('cell', 'orderkey', 'Int64', (SELECT c FROM n), 1), ('cell', 'totalprice', 'Float64', (SELECT c FROM n), 1)) t(assoc, name, precision, n_tuples, components)"
)
def field_info(spark, sf_dir):
    path = write_mesh(tables.order_mesh(spark, sf_dir), f"{scratch_dir(spark)}/orders.vtu")
    rows = info(spark, path)[1].where("assoc <> 'meta'")
    return rows.select("assoc", "name", "precision", "n_tuples", F.when(F.size("layout") > 1, F.element_at("layout", 2)).otherwise(1).cast("int").alias("components"))


@_query("SELECT 'title' AS name, 'String' AS precision, 'orders' AS string_value, NULL::DOUBLE AS total UNION ALL SELECT 'numbers', 'Float64', NULL, 3.0::DOUBLE")
def meta_data(spark, sf_dir):
    path = write_mesh(tables.order_mesh(spark, sf_dir), f"{scratch_dir(spark)}/orders.vtu")
    return load_table(spark, path, "meta_data").select("name", "precision", "string_value", F.aggregate("numbers", F.lit(0.0), lambda s, x: s + x).alias("total"))


@_query("SELECT p_brand AS piece_base, 'mesh-' || p_partkey AS file FROM part")
def piece_file_names(spark, sf_dir):
    return tables.table(spark, sf_dir, "part").select(F.col("p_brand").alias("piece_base"), pieces.piece_file_name(F.lit("mesh"), F.col("p_partkey")).alias("file"))


# --- layouts, options and defaults ---


@_query("SELECT r_regionkey, list_transform(range(0, 5), lambda j: (j = r_regionkey)::INTEGER::DOUBLE) AS axis FROM region")
def standard_basis(spark, sf_dir):
    basis = F.array(*[F.array(*map(F.lit, axis)) for axis in grids.standard_basis(5)])
    return tables.table(spark, sf_dir, "region").select("r_regionkey", F.get(basis, F.col("r_regionkey").cast("int")).alias("axis"))


@_query("SELECT s_suppkey, [s_acctbal <= 0, -s_acctbal <= 0, s_nationkey <= 0] AS backwards FROM supplier")
def axis_orientation(spark, sf_dir):
    spacing = F.array(F.col("s_acctbal").cast("double"), -F.col("s_acctbal").cast("double"), F.col("s_nationkey").cast("double"))
    return tables.table(spark, sf_dir, "supplier").select("s_suppkey", grids.axis_orientation(spacing).alias("backwards"))


@_query("SELECT n_name, (n_nationkey % 5)::BIGINT AS i, (n_nationkey // 5)::BIGINT AS j FROM nation")
def index_range(spark, sf_dir):
    """The range of all indices of a layout, in order, beside the entities that it numbers."""
    indices = spark.createDataFrame([(flat, *index) for flat, index in enumerate(Layout((5, 5)).indices())], "n_nationkey bigint, i bigint, j bigint")
    return tables.table(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("bigint")).join(indices, "n_nationkey").select("n_name", "i", "j")


@_query("SELECT count(*) * 64 AS entries, 64::BIGINT AS below, 8::BIGINT AS last, count(*) * 8 * 4 AS replaced FROM embeddings")
def layout_algebra(spark, sf_dir):
    layout = Layout((tables.table(spark, sf_dir, "embeddings").count(), 8, 8))
    row = (layout.entries(), layout.sub_layout().entries(), layout.entries(2), layout.with_sub_layout((4,)).entries())
    return spark.createDataFrame([row], "entries bigint, below bigint, last bigint, replaced bigint")


@_query(f"SELECT vec_id, list_max(v) AS largest, len(v)::BIGINT AS n FROM ({_V})")
def field_export(spark, sf_dir):
    """Fields exported to numpy where their rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = to_numpy(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v.max(1)), pa.array(np.full(len(v), v.shape[1]))], names=["vec_id", "largest", "n"])

    return _vectors(spark, sf_dir).mapInArrow(run, "vec_id bigint, largest double, n bigint")


@_query("SELECT o_orderkey, format('{:016x}', o_orderkey) AS big_endian FROM orders")
def byte_swap(spark, sf_dir):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(0).to_numpy().astype(codecs.dtype_of("Int64", "BigEndian")).tobytes().hex()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([said[at : at + 16] for at in range(0, len(said), 16)], pa.string())], names=["o_orderkey", "big_endian"])

    return tables.table(spark, sf_dir, "orders").select("o_orderkey").mapInArrow(run, "o_orderkey bigint, big_endian string")


@_query(
    "SELECT encoder, data_format, (encoder, data_format) NOT IN (('raw', 'inlined'), ('ascii', 'appended')) AS allowed "
    "FROM (VALUES ('ascii'), ('base64'), ('raw')) e(encoder), (VALUES ('inlined'), ('appended')) f(data_format)"
)
def allowed_combinations(spark, sf_dir):
    def allowed(encoder: str, data_format: str) -> bool:
        try:
            codecs.check_combination(encoder, data_format, None)
        except ValueProblem:
            return False
        return True

    rows = [(e, f, allowed(e, f)) for e, f in itertools.product(("ascii", "base64", "raw"), ("inlined", "appended"))]
    return spark.createDataFrame(rows, "encoder string, data_format string, allowed boolean")


@_query("SELECT * FROM (VALUES (0, 'point', 'partkey'), (0, 'cell', 'custkey'), (0, 'cell', 'orderkey'), (0, 'cell', 'totalprice'), (1, 'point', 'pair')) t(rank, assoc, name)")
def rank_of_fields(spark, sf_dir):
    path = write_mesh(tables.order_mesh(spark, sf_dir), f"{scratch_dir(spark)}/orders.vtu")
    fields = info(spark, path)[1].where("assoc <> 'meta'")
    ranked = [transforms.fields_of_rank(fields, rank).select(F.lit(rank).alias("rank"), "assoc", "name") for rank in (0, 1, 2)]
    return ranked[0].union(ranked[1]).union(ranked[2])


@_query("SELECT * FROM (VALUES ('PointData', 'partkey', 'pair'), ('CellData', 'custkey', '')) t(section, scalars, vectors)")
def active_arrays(spark, sf_dir):
    path = write_mesh(tables.order_mesh(spark, sf_dir), f"{scratch_dir(spark)}/orders.vtu")
    _, piece = open_piece(mesh_parts(path)[0])  # the header alone: payloads of gigabytes are one line
    rows = [(s, piece.active[s].get("Scalars", ""), piece.active[s].get("Vectors", "")) for s in ("PointData", "CellData") if s in piece.active]
    return spark.createDataFrame(rows, "section string, scalars string, vectors string")


@_query(f"SELECT kind, ext, (SELECT 20 * {_NY}) AS n_points FROM (VALUES ('image', 'vti'), ('rectilinear', 'vtr'), ('structured', 'vts')) t(kind, ext) UNION ALL SELECT 'unstructured', 'vtu', count(*) FROM part")
def default_formats(spark, sf_dir):
    """Written under a name without extension, each kind of grid takes its own format."""
    meshes = [*(tables.part_grid(spark, sf_dir, kind) for kind in ("image", "rectilinear", "structured")), tables.order_mesh(spark, sf_dir)]
    rows = []
    for mesh in meshes:
        path = write_mesh(mesh, f"{scratch_dir(spark)}/{mesh.kind}")
        rows.append((mesh.kind, path.rpartition(".")[2], info(spark, path)[0].first()["n_points"]))
    return spark.createDataFrame(rows, "kind string, ext string, n_points bigint")
