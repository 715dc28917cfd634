"""Connectivity, offsets, point numbering and what follows from corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import vtk_type
from ..sources.scratch import materialise


def running_index(df: DataFrame, id_column: str, name: str = "index") -> DataFrame:
    """Number rows from 0 in the order of their ids, without gathering them anywhere.

    Ids are dealt out by range; each range counts its rows, the counts (one a range) are summed up, and rows add their
    place in the range. Ranges are drawn from a sample, so they are written down before they are used twice. Ids have to
    be distinct.
    """
    ranged = materialise(df.repartitionByRange(id_column).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(id_column)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    placed = ranged.withColumn("_place", F.row_number().over(inside) - 1)
    return placed.join(F.broadcast(firsts), "_range").withColumn(name, F.col("_first") + F.col("_place")).drop("_range", "_first", "_place")


def point_id_map(points: DataFrame) -> DataFrame:
    """(point_id, index): running numbers by id."""
    return running_index(points.select("point_id"), "point_id")


def connectivity(cells: DataFrame, id_map: DataFrame) -> DataFrame:
    """(cell_id, pos, index): each corner's running number, by an equi-join; cells of unknown corners get null."""
    corners = cells.select("cell_id", F.posexplode("corners").alias("pos", "point_id"))
    return corners.join(id_map, "point_id", "left").select("cell_id", "pos", "index")


def offsets(cells: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(cell_id, offset): corners of all cells up to this one, in the order of ids.

    With `group` (pieces) sums run within each; without, in two phases like running_index.
    """
    sized = cells.select(*(group or []), "cell_id", F.size("corners").cast("bigint").alias("n"))
    if group:
        return sized.withColumn("offset", F.sum("n").over(Window.partitionBy(*group).orderBy("cell_id"))).drop("n")
    ranged = materialise(sized.repartitionByRange("cell_id").withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_range").orderBy("cell_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_sum", F.sum("n").over(inside))
    return placed.join(F.broadcast(firsts), "_range").select("cell_id", (F.col("_first") + F.col("_sum")).alias("offset"))


def cell_types_column(cells: DataFrame) -> DataFrame:
    """(cell_id, vtk_type)."""
    return cells.select("cell_id", vtk_type(F.col("cell_type")).alias("vtk_type"))


def coordinates_column(points: DataFrame, axes: list[str]) -> DataFrame:
    """(point_id, coordinates): always three components."""
    padded = [F.col(a).cast("double") for a in axes] + [F.lit(0.0)] * (3 - len(axes))
    return points.select("point_id", F.array(*padded).alias("coordinates"))


def cell_centers(cells: DataFrame, points: DataFrame, axes: str = "xyz") -> DataFrame:
    """(cell_id, x, y, z): mean of the corners' positions."""
    corners = cells.select("cell_id", F.explode("corners").alias("point_id"))
    return corners.join(points.select("point_id", *axes), "point_id").groupBy("cell_id").agg(*[F.avg(a).alias(a) for a in axes])


def counts(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(n_points, n_cells, n_corners)."""
    c = cells.agg(F.count("*").alias("n_cells"), F.coalesce(F.sum(F.size("corners").cast("bigint")), F.lit(0)).alias("n_corners"))
    return points.agg(F.count("*").alias("n_points")).crossJoin(c)  # one row each


def center_of(corners: Column, position: Column) -> Column:
    """Mean of positions kept in a map by point id (for cells whose corners' positions lie in the row)."""
    return F.aggregate(corners, F.lit(0.0), lambda s, c: s + F.element_at(position, c)) / F.size(corners)
