"""Transforms of cells: filters, discontinuous grids, polylines in segments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValueProblem
from .mesh import Mesh


def filter_cells(mesh: Mesh, keep: Column) -> Mesh:
    """Cells that fulfil a condition, with all points."""
    cells = mesh.cells.where(keep)
    data = mesh.cell_data
    if data is not None:
        data = data.join(cells.select("cell_id"), "cell_id", "left_semi")
    return replace(mesh, kind="unstructured", cells=cells, cell_data=data, frame=None)


def of_types(*names: str) -> Column:
    """Condition on the cell type."""
    return F.col("cell_type").isin(*names)


def discontinuous(cells: DataFrame, points: DataFrame) -> DataFrame:
    """A point of its own for each corner of each cell: (cell_id, pos, host_point, x, y, z).

    (cell_id, pos) is the new point's identity, so none can collide.
    """
    corners = cells.select("cell_id", F.posexplode("corners").alias("pos", "point_id"))
    return corners.join(points, "point_id").select("cell_id", "pos", F.col("point_id").alias("host_point"), *[c for c in points.columns if c != "point_id"])


def make_discontinuous(mesh: Mesh) -> Mesh:
    """The mesh with a point for each corner, numbered by cell and corner; fields of points are repeated."""
    from .topology import offsets

    points = mesh.points if mesh.point_data is None else mesh.points.join(mesh.point_data, "point_id")
    ends = offsets(mesh.cells)
    placed = mesh.cells.join(ends, "cell_id").withColumn("_first", F.col("offset") - F.size("corners"))
    fresh = placed.withColumn("corners", F.transform("corners", lambda c, i: F.col("_first") + i)).drop("_first", "offset")
    first = placed.select("cell_id", "_first")
    new = discontinuous(mesh.cells, points).join(first, "cell_id").withColumn("point_id", F.col("_first") + F.col("pos"))
    fields = [c for c in (mesh.point_data.columns if mesh.point_data is not None else []) if c not in ("point_id", "step", "piece")]
    return replace(mesh, kind="unstructured", points=new.select("point_id", "x", "y", "z"), cells=fresh, point_data=new.select("point_id", *fields) if fields else None, frame=None)


def polyline_segments(cells: DataFrame) -> DataFrame:
    """Polylines in their segments, others as they are: (host_cell, pos, cell_type, corners)."""
    c = F.col("corners")
    line = F.col("cell_type") == "polyline"
    pairs = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.array(a, b))
    parts = F.when(line & (F.size(c) > 1), pairs).otherwise(F.array(c))
    out = cells.select(F.col("cell_id").alias("host_cell"), F.when(line, "segment").otherwise(F.col("cell_type")).alias("cell_type"), F.posexplode(parts).alias("pos", "corners"))
    return out.select("host_cell", "pos", "cell_type", "corners")


def subdivide_polylines(mesh: Mesh) -> Mesh:
    """The mesh with polylines in segments, cells numbered anew in order; cell data are repeated."""
    from .topology import running_index

    parts = polyline_segments(mesh.cells).withColumn("_order", F.struct("host_cell", "pos"))
    numbered = running_index(parts, "_order", "cell_id").drop("_order")
    data = mesh.cell_data
    if data is not None:
        data = numbered.select("cell_id", "host_cell").join(data.withColumnRenamed("cell_id", "host_cell"), "host_cell").drop("host_cell")
    return replace(mesh, cells=numbered.select("cell_id", "cell_type", "corners"), cell_data=data)


def computed_field(df: DataFrame, name: str, value: Column, precision: str = "double") -> DataFrame:
    """A field by an expression, in a precision."""
    return df.withColumn(name, value.cast(precision))


def fields_of_rank(field_info: DataFrame, rank: int) -> DataFrame:
    """Rows of fields of rank 0 (scalars), 1 (vectors) or 2 (tensors)."""
    return field_info.where(F.size("layout") == rank + 1)


def pick_fields(data: DataFrame, id_column: str, names: Sequence[str]) -> DataFrame:
    """Projection by name; unknown names are an error."""
    if unknown := [n for n in names if n not in data.columns]:
        raise ValueProblem(f"no field named {', '.join(unknown)}")
    return data.select(id_column, *names)


def export_points(points: DataFrame, space_dimension: int) -> DataFrame:
    """(point_id, position) of so many coordinates, cut off or padded with zeros."""
    axes = [F.col(a) for a in "xyz"][:space_dimension] + [F.lit(0.0)] * max(0, space_dimension - 3)
    return points.select("point_id", F.array(*axes).alias("position"))
