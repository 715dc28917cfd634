"""Pieces of distributed grids: merging, layouts, and the collective operations among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_prefix(pieces: DataFrame, piece: str, value: str, name: str) -> DataFrame:
    """For each piece the sum of a value over the pieces before it (one row a piece)."""
    before = Window.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def unstructured_merge(points: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One numbering for all pieces: ids and corners, local from 0, are shifted by the pieces before.

    Points that pieces share stay apart. Counts are a row a piece, so they are broadcast.
    """
    n_points = points.groupBy("piece").agg(F.count("*").alias("n"))
    first_point = F.broadcast(exclusive_prefix(n_points, "piece", "n", "first").select("piece", "first"))
    first_cell = F.broadcast(exclusive_prefix(cells.groupBy("piece").agg(F.count("*").alias("n")), "piece", "n", "first_cell").select("piece", "first_cell"))
    merged_points = points.join(first_point, "piece").withColumn("point_id", F.col("point_id") + F.col("first")).drop("first")
    merged_cells = cells.join(first_point, "piece").join(first_cell, "piece")
    merged_cells = merged_cells.withColumn("corners", F.transform("corners", lambda c: c + F.col("first"))).withColumn("cell_id", F.col("cell_id") + F.col("first_cell"))
    return merged_points, merged_cells.drop("first", "first_cell")


def structured_merge(data: DataFrame, id_column: str, values: Sequence[str], piece: str = "piece") -> DataFrame:
    """One value for each global id: of those that share it, the piece of the highest number wins."""
    picked = F.max_by(F.struct(*values), F.col(piece)).alias("_v")
    return data.groupBy(id_column).agg(picked).select(id_column, *[f"_v.{v}" for v in values])


def global_ids(df: DataFrame, index: Sequence[Column], lower: Sequence[Column], extents: Sequence[int], name: str) -> DataFrame:
    """Ids in the whole extent from local indices and the piece's lower left corner."""
    i, j, k = (a + b for a, b in zip(index, lower, strict=True))
    return df.withColumn(name, i + F.lit(extents[0]) * (j + F.lit(extents[1]) * k))


def piece_layout(pieces: DataFrame, axes: int = 3, digits: int = 8) -> DataFrame:
    """Offsets and places of pieces by their origins along the basis: pieces(piece, o0.., e0..) gets r0.. and f0...

    r is the piece's rank along an axis among the distinct origins (equal up to `digits` decimals), f the sum of extents
    of the pieces before it on its line. The whole extent is the largest f + e of each axis.
    """
    out = pieces
    for a in range(axes):
        out = out.withColumn(f"_o{a}", F.round(F.col(f"o{a}"), digits))
    for a in range(axes):
        others = [f"_o{b}" for b in range(axes) if b != a]
        along = Window.partitionBy(*others).orderBy(f"_o{a}")
        out = out.withColumn(f"r{a}", (F.dense_rank().over(along) - 1).cast("int"))
        out = out.withColumn(f"f{a}", F.coalesce(F.sum(f"e{a}").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop(*[f"_o{a}" for a in range(axes)])


def whole_extent(layout: DataFrame, axes: int = 3) -> DataFrame:
    """(w0, w1, ..): the largest end of a piece along each axis."""
    return layout.agg(*[F.max(F.col(f"f{a}") + F.col(f"e{a}")).alias(f"w{a}") for a in range(axes)])


def merge_ordinates(axes: DataFrame) -> DataFrame:
    """Axis of the whole grid out of pieces' (start, at, ordinate): shared points and repeated intervals count once."""
    return axes.select((F.col("start") + F.col("at")).alias("index"), "ordinate").groupBy("index").agg(F.min("ordinate").alias("ordinate"))


def reduce_all(df: DataFrame, value: str) -> DataFrame:
    """max, min and sum over all pieces; partial results are made where the rows are."""
    return df.agg(F.max(value).alias("max"), F.min(value).alias("min"), F.sum(value).alias("sum"))


def gather_in_order(df: DataFrame, value: str, piece: str = "piece") -> DataFrame:
    """All pieces' values (one each) as an array in the order of pieces."""
    pairs = F.array_sort(F.collect_list(F.struct(piece, value)))
    return df.agg(F.transform(pairs, lambda x: x[value]).alias("gathered"))


def scatter(shares: DataFrame, values: str, pieces: int) -> DataFrame:
    """Equal shares of an array: (piece, share)."""
    n = F.floor(F.size(values) / pieces).cast("int")
    return shares.select(F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), values).select("piece", F.slice(values, F.col("piece") * n + 1, n).alias("share"))


def piece_file_name(base: Column, piece: Column) -> Column:
    """`<base>-<piece>`."""
    return F.concat(base, F.lit("-"), piece.cast("string"))
