"""MinHash near-duplicate removal.

Universal hash minima of each document's shingles are banded; documents that share a band are candidates, pass a check
of their signatures and are confirmed on their full sets; connected groups come from alternating large-star and
small-star. Documents of equal sets are one class from the start. Each bucket's first member is compared with its
others; what that leaves apart is compared block by block, and only links leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_small, map_arrow
from .linking import join_buckets, link_buckets

#: 32 bands of 5 minima: a pair of similarity 0.8 shares no band once in 300,000, one of 0.2 shares one once in 100.
BANDS, ROWS = 32, 5
#: Share of equal signature bytes below which a pair isn't looked at further: six standard deviations under 0.8.
SIGNATURE_SLACK = 0.2
#: Members of a block, and columns of the 0-1 matrix that is held at once.
BLOCK, _COLUMNS = 512, 8192
_WORDS_KEPT = 400_000
_draw = np.random.default_rng(20_240_501)
_A = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct `width`-word shingles; fewer words are one shingle, none give none."""
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z alone, splits at \x20 and \x09 to \x0D
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    if not n:
        return h
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = _mixed(s * _MIX + h[k : len(h) - n + 1 + k])
    return np.unique(s)


def _node(s: np.ndarray) -> int:
    """64-bit key of a set (10^10 different documents would have about three pairs of equal keys)."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """docs(doc_id, row_key, text) to (doc_id, row_key, n_shingles, node, bands, signature); node is null for empty sets."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        bands = np.zeros((len(sets), BANDS), np.uint64)
        signature = np.zeros((len(sets), BANDS * ROWS), np.uint8)
        if len(full):
            x = np.concatenate([sets[i] for i in full])
            start = np.cumsum(sizes[full]) - sizes[full]
            for band in range(BANDS):
                key = np.full(len(full), band + 1, np.uint64)
                for j in range(band * ROWS, (band + 1) * ROWS):
                    low = np.minimum.reduceat(x * _A[j] + _B[j], start)
                    key = _mixed(key * _MIX + low)
                    signature[full, j] = (low * _MIX >> np.uint64(56)).astype(np.uint8)
                bands[full, band] = key
        band_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), band_lists, pa.array([r.tobytes() for r in signature], pa.binary())],
            names=["doc_id", "row_key", "n_shingles", "node", "bands", "signature"],
        )

    return map_arrow(docs, run, "doc_id bigint, row_key bigint, n_shingles bigint, node bigint, bands array<bigint>, signature binary", rows=200)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """docs(node, text) to (node, shingles), where the text's set has the key `node`."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = [(n, s.view(np.int64)) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(s := shingle_set(t, width)) and _node(s) == n]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.list_(pa.int64()))], names=["node", "shingles"])

    return map_arrow(docs, run, "node bigint, shingles array<bigint>", rows=200)


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """pairs(a, b, sa, sb) whose signatures agree in a share `least` of their bytes at least."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            keep = pa.array((sa == sb).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return map_arrow(pairs.select("a", "b", "sa", "sb"), run, "a bigint, b bigint", rows=5000)


def _between(left: list[dict], right: list[dict], percent: int) -> Iterator[tuple[int, int]]:
    """Links between members of different components, by exact sizes of all intersections at once."""
    left = [m for m in left if any(m["comp"] != o["comp"] for o in right)]
    if not left:
        return
    sets = [np.asarray(m["shingles"], np.int64) for m in (*left, *right)]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    # only shingles that two sets have at least matter; columns of a 0-1 matrix, a slice at a time
    shared, place, often = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[place]
    row = np.repeat(np.arange(len(sets)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    n, common = len(left), np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int((often > 1).sum()), _COLUMNS):
        here = (column >= at) & (column < at + _COLUMNS)
        m = np.zeros((len(sets), min(_COLUMNS, int((often > 1).sum()) - at)), np.float32)
        m[row[here], column[here] - at] = 1
        common += m[:n] @ m[n:].T
    apart = np.array([m["comp"] for m in left])[:, None] != np.array([m["comp"] for m in right])
    total = sizes[:n, None] + sizes[n:] - common.astype(np.int64)
    for i, j in zip(*np.nonzero(apart & (100 * common.astype(np.int64) >= percent * total)), strict=True):
        yield left[i]["node"], right[j]["node"]


def _block_links(active: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """All links between different components that share a bucket of active(bucket, node, comp).

    In each bucket, members outside its largest component meet all its members, in blocks of about BLOCK; a block's
    pairs are counted by a matrix product, and only links come out. Every pair of two components has a member outside
    the largest. Blocks are dealt out by both their numbers, so no bucket, however large, is one task's work.
    """
    active = active.select("bucket", "node", "comp")
    counts = active.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    whole = counts.groupBy("bucket").agg(F.max_by("comp", "n").alias("largest"), F.sum("n").alias("n"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("few"))
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    rows = join_buckets(active, scratch.save(whole)).withColumns({"lefts": blocks("few"), "rights": blocks("all")}).join(sets, "node")
    member = F.collect_list(F.struct("node", "comp", "shingles"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = rows.where("comp <> largest").groupBy("bucket", part("lefts").alias("i"), "rights").agg(member.alias("left"))
    left = left.select("bucket", "i", F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"), "left")
    right = rows.groupBy("bucket", part("rights").alias("j"), "lefts").agg(member.alias("right"))
    right = right.select("bucket", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), "j", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: set[tuple[int, int]] = set()
            for k in range(batch.num_rows):
                got.update((min(p), max(p)) for p in _between(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), percent))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["a", "b"])

    return left.join(right, ["bucket", "i", "j"]).select("left", "right").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of their sets of `width`-word shingles.

    Returns a row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable through links, its own
    included) and kept (doc_id = component_id). Texts that are null or have no word have empty sets, are linked with
    nothing and kept. Rows that repeat a doc_id are told apart by their texts; null doc_ids never are a component's id
    (a component of none but these has a null id and is not kept, as null compares to nothing). An empty table gives an
    empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("row_key", F.coalesce("doc_id", F.xxhash64("text")))
    found = scratch.save(signatures(docs.select("doc_id", "row_key", "text"), width))
    classes = scratch.save(found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("row_key").alias("row_key")))
    # one row for each class: the one whose row_key is the class's smallest
    chosen = found.join(classes.select("node", "row_key"), ["node", "row_key"]).dropDuplicates(["node"])
    chosen = scratch.save(chosen.select("node", "row_key", "n_shingles", "bands", "signature"))
    tables: dict[str, DataFrame] = {}

    def prepare(active: DataFrame) -> None:
        nodes = scratch.save(active.select("node").distinct())
        tables["signs"] = scratch.save(chosen.select("node", "row_key", "n_shingles", "signature").join(nodes, "node"))
        keys = scratch.save(tables["signs"].select("row_key", "node"))
        texts = join_small(docs, keys, "row_key")
        tables["sets"] = scratch.save(full_sets(texts.select("node", "text"), width).dropDuplicates(["node"]))
        scratch.drop(chosen, nodes, keys)

    def verify(pairs: DataFrame) -> DataFrame:
        signs, sets = tables["signs"], tables["sets"]

        def both(df: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
            for side in "ab":
                df = df.join(table.select(F.col("node").alias(side), *[F.col(c).alias(s + side) for c, s in columns.items()]), side)
            return df

        near = both(pairs, signs, {"n_shingles": "n", "signature": "s"})
        near = near.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        near = scratch.save(_alike(near, percent / 100 - SIGNATURE_SLACK))
        near = both(near, sets, {"shingles": "x"})
        common = F.size(F.array_intersect("xa", "xb"))
        return near.where(100 * common >= percent * (F.size("xa") + F.size("xb") - common)).select("a", "b")

    members = chosen.select("node", F.explode("bands").alias("bucket"))
    labels = link_buckets(members, verify, scratch, prepare, lambda active: _block_links(active, tables["sets"], percent, scratch))
    grouped = scratch.save(classes.join(labels, "node", "left").select("node", "first_id", F.coalesce("comp", "node").alias("comp")))
    lowest = scratch.save(grouped.groupBy("comp").agg(F.min("first_id").alias("component_id")))
    ids = scratch.save(grouped.join(lowest, "comp").select("node", "component_id"))
    scratch.drop(*tables.values(), grouped, lowest)
    out = found.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("node").isNull().alias("empty"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("empty")).alias("kept"))
