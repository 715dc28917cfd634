"""Structured grids out of `spark.range`: every point and cell is arithmetic on its number, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotImplementedHere, SizeProblem, ValueProblem
from ..functions.layout import grid_dimension, inverse_index, number_of_entities
from .mesh import IDENTITY, Frame, Mesh


def point_extents(cells: Sequence[int]) -> list[int]:
    """Points in each direction: one more than cells."""
    return [n + 1 for n in cells]


def standard_basis(dimension: int = 3) -> list[list[float]]:
    """Unit vectors."""
    return [[float(i == j) for j in range(dimension)] for i in range(dimension)]


def ordinates(origin: float, spacing: float, cells: int) -> Column:
    """Coordinates along an axis."""
    return F.transform(F.sequence(F.lit(0), F.lit(cells)), lambda i: F.lit(float(origin)) + i * F.lit(float(spacing)))


def axis_orientation(spacing: Column) -> Column:
    """For each axis whether it runs backwards (or not at all)."""
    return F.transform(spacing, lambda s: s <= 0)


def structured_points(spark: SparkSession, cells: Sequence[int], origin: Sequence[float] = (0, 0, 0), spacing: Sequence[float] = (1, 1, 1), direction: Sequence[float] = IDENTITY, lower: Sequence[int] = (0, 0, 0)) -> DataFrame:
    """(point_id, i, j, k, x, y, z) of a grid of so many cells: origin + direction * (index * spacing)."""
    extents = [n + 1 for n in cells]
    ids = spark.range(number_of_entities(extents)).withColumnRenamed("id", "point_id")
    index = inverse_index(F.col("point_id"), extents)
    out = ids.select("point_id", *[(x + F.lit(lower[a])).alias(n) for a, (n, x) in enumerate(zip("ijk", index, strict=True))])
    return out.select("*", *direction_transform([F.col(n) for n in "ijk"], origin, spacing, direction))


def direction_transform(index: Sequence[Column], origin: Sequence[float], spacing: Sequence[float], direction: Sequence[float] = IDENTITY) -> list[Column]:
    """x, y, z of an index: the row-major 3 x 3 matrix times index * spacing, plus the origin."""
    scaled = [i.cast("double") * F.lit(float(s)) for i, s in zip(index, spacing, strict=True)]
    out = []
    for row, name in enumerate("xyz"):
        total = F.lit(float(origin[row]))
        for a in range(3):
            if direction[3 * row + a]:
                total = total + (scaled[a] if direction[3 * row + a] == 1.0 else F.lit(float(direction[3 * row + a])) * scaled[a])
        out.append(total.alias(name))
    return out


def structured_cells(spark: SparkSession, cells: Sequence[int], axis_aligned: bool = True) -> DataFrame:
    """(cell_id, i, j, k, cell_type, corners) of a grid of so many cells, in any plane.

    Axis-aligned cells (pixels, voxels) list corners first axis fastest; quadrilaterals and hexahedra go round.
    """
    dimension = grid_dimension(cells)
    if not dimension:
        raise NotImplementedHere("a grid without cells in any direction")
    ids = spark.range(number_of_entities(cells)).withColumnRenamed("id", "cell_id")
    index = inverse_index(F.col("cell_id"), cells)
    strides = [1, cells[0] + 1, (cells[0] + 1) * (cells[1] + 1)]
    first = index[0] + index[1] * F.lit(strides[1]) + index[2] * F.lit(strides[2])
    corners = [0]
    for a in range(3):
        if cells[a]:
            corners += [c + strides[a] for c in corners]
    if not axis_aligned and dimension > 1:
        corners = [corners[i] for i in ((0, 1, 3, 2), (0, 1, 3, 2, 4, 5, 7, 6))[dimension - 2]]
    name = {1: ("segment",) * 2, 2: ("quadrilateral", "pixel"), 3: ("hexahedron", "voxel")}[dimension][axis_aligned]
    return ids.select("cell_id", *[x.alias(n) for n, x in zip("ijk", index, strict=True)], F.lit(name).alias("cell_type"), F.array(*[first + F.lit(c) for c in corners]).alias("corners"))


def image_grid(spark: SparkSession, size: Sequence[float], cells: Sequence[int], origin: Sequence[float] | None = None) -> Mesh:
    """A box of equal cells: spacing is size / cells; no direction may be without cells."""
    if len(size) != len(cells) or any(n <= 0 for n in cells):
        raise ValueProblem("an image grid needs cells in each of its directions")
    spacing = [s / n for s, n in zip(size, cells, strict=True)] + [1.0] * (3 - len(cells))
    origin = [*(origin or [0.0] * len(cells)), *[0.0] * (3 - len(cells))]
    cells = [*cells, *[0] * (3 - len(cells))]
    frame = Frame([x for n in cells for x in (0, n)], {}, tuple(map(float, origin)), tuple(map(float, spacing)))
    return Mesh("image", structured_points(spark, cells, origin, spacing), structured_cells(spark, cells), frame=frame)


def rectilinear_points(axes: Sequence[DataFrame]) -> DataFrame:
    """Cross product of up to three axis tables (index, ordinate), x fastest: (point_id, i, j, k, x, y, z).

    Axes are the sides of a grid: the smaller ones are broadcast by Spark, which prunes nothing by hand.
    """
    names = list(zip("ijk", "xyz", strict=True))
    spark = axes[0].sparkSession
    tables = [*axes, *[spark.createDataFrame([(0, 0.0)], "index bigint, ordinate double")] * (3 - len(axes))]
    counts = [t.count() for t in tables]
    out = None
    for t, (i, x) in zip(tables, names, strict=True):
        t = t.select(F.col("index").cast("bigint").alias(i), F.col("ordinate").cast("double").alias(x))
        out = t if out is None else out.crossJoin(t)
    flat = F.col("i") + F.col("j") * F.lit(counts[0]) + F.col("k") * F.lit(counts[0] * counts[1])
    return out.select(flat.alias("point_id"), *"ijkxyz")


def rectilinear_grid(spark: SparkSession, axes: Sequence[Sequence[float]]) -> Mesh:
    """A grid of given ordinates along each axis; missing axes have the single ordinate 0."""
    axes = [list(map(float, a)) or [0.0] for a in axes] + [[0.0]] * (3 - len(axes))
    if len(axes) != 3:
        raise SizeProblem("at most three axes")
    cells = [len(a) - 1 for a in axes]
    tables = [spark.createDataFrame(list(enumerate(a)), "index bigint, ordinate double") for a in axes]
    return Mesh("rectilinear", rectilinear_points(tables), structured_cells(spark, cells), frame=Frame([x for n in cells for x in (0, n)], ordinates=axes))
