"""Bounded samples of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_part(doc_id: str, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo `parts`; -1 for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(-1)).cast("int")


def bounded(rows: DataFrame, doc_id: str, most: int, seed: int = 17) -> DataFrame:
    """About `most` of the rows at most, by a hash of their ids: the same ones however the table is stored.

    A sample of a sample needs a seed of its own: by the same one, its rows have small hashes already.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * most / n))
