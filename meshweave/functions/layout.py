"""Indices of n-dimensional ranges in both conventions, and layouts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SizeProblem


def flat_index_first_fastest(index: Sequence[Column], extents: Sequence[int]) -> Column:
    """i + j * nx + k * nx * ny: grids number points and cells so."""
    out, stride = F.lit(0).cast("bigint"), 1
    for i, n in zip(index, extents, strict=True):
        out, stride = out + i * F.lit(stride), stride * n
    return out


def flat_index_last_fastest(index: Sequence[Column], extents: Sequence[int]) -> Column:
    """Row-major: fields' entries are laid out so."""
    return flat_index_first_fastest(list(index)[::-1], list(extents)[::-1])


def inverse_index(flat: Column, extents: Sequence[int]) -> list[Column]:
    """Index of a flat one, first axis fastest; extents of 0 count as 1."""
    out, stride = [], 1
    for n in (max(1, n) for n in extents):
        out.append(F.floor((flat - flat % stride) / stride).cast("bigint") % n)
        stride *= n
    return out


def number_of_entities(extents: Sequence[int]) -> int:
    """Product of the extents, flat axes counting once."""
    return math.prod(max(1, n) for n in extents)


def grid_dimension(extents: Sequence[int]) -> int:
    """Number of axes that aren't flat."""
    return sum(n > 0 for n in extents)


class Layout(tuple):
    """Extents of a field: entities first, then components."""

    def entries(self, codim: int = 0) -> int:
        """Number of values, or of those below the first `codim` axes."""
        if codim and codim >= len(self):
            raise SizeProblem("codimension too large")
        return math.prod(self[codim:])

    def sub_layout(self, codim: int = 1) -> Layout:
        """The layout below the first axes."""
        if codim >= len(self):
            raise SizeProblem("codimension too large")
        return Layout(self[codim:])

    def with_sub_layout(self, sub: Sequence[int]) -> Layout:
        """The same entities with other components: the last axes are replaced."""
        if len(sub) >= len(self):
            raise SizeProblem("layout too large")
        return Layout((*self[: len(self) - len(sub)], *sub))

    def indices(self):
        """All indices, first axis fastest."""
        for flat in range(self.entries()):
            index = []
            for n in self:
                flat, i = divmod(flat, n)
                index.append(i)
            yield tuple(index)
