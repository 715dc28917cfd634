"""Cell types: names, file ids, and the type that follows from a number of corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotImplementedHere

#: The file format's cell types.
CELL_TYPES = {
    "vertex": 1, "segment": 3, "polyline": 4, "triangle": 5, "polygon": 7, "pixel": 8, "quadrilateral": 9, "tetrahedron": 10,
    "voxel": 11, "hexahedron": 12, "lagrange_segment": 68, "lagrange_triangle": 69, "lagrange_quadrilateral": 70,
    "lagrange_tetrahedron": 71, "lagrange_hexahedron": 72,
}
CELL_NAMES = {v: k for k, v in CELL_TYPES.items()}


def cell_name(number: int) -> str:
    """The name of a file id; others than the known ones are refused."""
    if number not in CELL_NAMES:
        raise NotImplementedHere(f"cell type {number}")
    return CELL_NAMES[number]


def cell_type_table(spark: SparkSession) -> DataFrame:
    """The fifteen types as rows (cell_type, vtk_type)."""
    return spark.createDataFrame(list(CELL_TYPES.items()), "cell_type string, vtk_type int")


def type_by_corners(n: Column) -> Column:
    """Type of a cell of a point set by its number of corners, polygons from five on."""
    return F.when(n == 1, "vertex").when(n == 2, "segment").when(n == 3, "triangle").when(n == 4, "quadrilateral").otherwise("polygon")


def vtk_type(name: Column) -> Column:
    """File id of a type's name, null for unknown ones."""
    pairs = [x for k, v in CELL_TYPES.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), name)
