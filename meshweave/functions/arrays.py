"""Field algebra on columns: vectors are arrays, tensors arrays of arrays; entities are rows with an id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SizeProblem, TypeProblem, ValueProblem


def depth(kind: T.DataType) -> int:
    """0 for a scalar field's column, 1 for a vector's, 2 for a tensor's."""
    return 1 + depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def flatten_field(df: DataFrame, id_column: str, field: str, components: int) -> DataFrame:
    """One row a value: (entry, value), entry being id * components + place."""
    out = df.select(id_column, F.posexplode(field).alias("at", "value"))
    return out.select((F.col(id_column) * components + F.col("at")).alias("entry"), "value")


def reshape(value: Column, layout: Sequence[int], size: int) -> Column:
    """A vector of `size` values as (n,) or (rows, columns)."""
    if len(layout) not in (1, 2) or size != (layout[0] if len(layout) == 1 else layout[0] * layout[1]):
        raise SizeProblem(f"{size} values can't be reshaped to {tuple(layout)}")
    if len(layout) == 1:
        return value
    rows, columns = layout
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(value, r * columns + 1, F.lit(columns)))


def extend(value: Column, kind: T.DataType, sizes: Sequence[int]) -> Column:
    """Pad every inner axis with zeros at its end; rows whose axis is longer fail when they are read."""
    if depth(kind) == 0:
        raise SizeProblem("scalar fields can't be extended")
    if depth(kind) != len(sizes):
        raise SizeProblem(f"{depth(kind)} inner axes can't be extended to {tuple(sizes)}")
    inner = kind.elementType
    if len(sizes) == 2:
        value = F.transform(value, lambda row: extend(row, inner, sizes[1:]))
        zero = F.array_repeat(F.lit(0).cast(inner.elementType), sizes[1])
    else:
        zero = F.lit(0).cast(inner)
    short = F.lit(sizes[0]) - F.size(value)
    fits = F.when(short < 0, F.raise_error(F.lit("extending can't shrink a field")).cast("int")).otherwise(short)
    return F.concat(value, F.array_repeat(zero, fits))


def extend_all(value: Column, kind: T.DataType, size: int) -> Column:
    """The same target for all inner axes."""
    return extend(value, kind, [size] * depth(kind))


def pad_to_3d(value: Column, kind: T.DataType) -> Column:
    """What files ask for: vectors and tensors of three components, if they have fewer in every axis."""
    if depth(kind) == 0:
        return value
    if depth(kind) == 1:
        return F.when(F.size(value) < 3, extend_short(value, kind.elementType)).otherwise(value)
    small = (F.size(value) < 3) & F.forall(value, lambda row: F.size(row) < 3)
    rows = F.transform(value, lambda row: extend_short(row, kind.elementType.elementType))
    zero = F.array_repeat(F.lit(0).cast(kind.elementType.elementType), 3)
    return F.when(small, F.concat(rows, F.array_repeat(zero, F.greatest(F.lit(3) - F.size(value), F.lit(0))))).otherwise(value)


def extend_short(value: Column, inner: T.DataType) -> Column:
    """A vector with zeros up to three components."""
    return F.concat(value, F.array_repeat(F.lit(0).cast(inner), F.greatest(F.lit(3) - F.size(value), F.lit(0))))


def slice_field(df: DataFrame, id_column: str, field: str, start: Sequence[int], stop: Sequence[int]) -> DataFrame:
    """Half-open slice: the first axis by ids (renumbered from 0), the others of each value."""
    kind = df.schema[field].dataType
    if len(start) != len(stop) or len(start) != 1 + depth(kind):
        raise SizeProblem("slice bounds don't fit the field's axes")
    if any(b < a for a, b in zip(start, stop, strict=True)):
        raise SizeProblem("a slice ends before it begins")
    value = F.col(field)
    if len(start) > 2:
        value = F.transform(value, lambda row: F.slice(row, start[2] + 1, stop[2] - start[2]))
    if len(start) > 1:
        value = F.slice(value, start[1] + 1, stop[1] - start[1])
    return df.where((F.col(id_column) >= start[0]) & (F.col(id_column) < stop[0])).select((F.col(id_column) - start[0]).alias(id_column), value.alias(field))


def merge_fields(parts: Sequence[DataFrame], sizes: Sequence[int], id_column: str) -> DataFrame:
    """Concatenate along the entities: part k's ids are shifted by the sizes of those before."""
    if not parts:
        raise ValueProblem("nothing to merge")
    out, shift = None, 0
    for part, size in zip(parts, sizes, strict=True):
        if part.schema.simpleString() != parts[0].schema.simpleString():
            raise ValueProblem("fields to merge differ in layout or precision")
        moved = part.withColumn(id_column, (F.col(id_column) + shift).cast("bigint"))
        out = moved if out is None else out.unionByName(moved)
        shift += size
    return out


def as_sub_field(value: Column) -> Column:
    """One more axis of extent 1."""
    return F.array(value)


def dot_product(a: Column, b: Column) -> Column:
    """Sum of products, from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def transpose(matrix: Column) -> Column:
    """Rows and columns of a small tensor exchanged."""
    columns = F.sequence(F.lit(0), F.size(F.element_at(matrix, 1)) - 1)
    return F.transform(columns, lambda c: F.transform(matrix, lambda row: F.get(row, c)))


def cast_field(value: Column, kind: T.DataType, to: T.DataType) -> Column:
    """Another precision, value by value; floats lose their fraction towards zero, what doesn't fit is an error."""
    if depth(kind) != depth(to) and depth(to):
        raise TypeProblem("precision is of single values")
    return F.transform(value, lambda x: cast_field(x, kind.elementType, to)) if depth(kind) else value.cast(to)


def sort_and_unique(value: Column) -> Column:
    """Distinct values in order."""
    return F.array_sort(F.array_distinct(value))


def unique_within(df: DataFrame, group: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Distinct values of each group where those closer than a tolerance to the one before count as the same."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(*group).orderBy(value))
    return df.select(*group, value).distinct().withColumn("_gap", F.col(value) - before).where(F.col("_gap").isNull() | (F.col("_gap") > tolerance)).drop("_gap")
