"""Best-fit packing of tokenised documents by exact-complement hashing.

Packing depends on lengths alone, and there are at most `capacity` different ones. So the plan is made on a histogram of
lengths (at most `capacity` rows, whatever the corpus) and says for each length which of its pieces, counted from 0,
go to which sequences. Pieces find their place by their number among those of their length; no group of equal lengths
is ever gathered anywhere.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow


#: Runs of blanks that tiktoken isn't given.
LONG_RUN = re.compile(r"\s{10000}")


class Recipe:
    """Which pieces go where: rows (length, first number, first sequence, offset), each for a run of pieces."""

    def __init__(self, counts: dict[int, int]):
        self.left = Counter(counts)
        self.used: Counter[int] = Counter()
        self.rows: list[tuple[int, int, int, int]] = []
        self.sequences = 0

    def emit(self, pattern: tuple[int, ...], times: int) -> None:
        """Fill `times` sequences with pieces of these lengths, in this order."""
        offset = 0
        for length in pattern:
            self.rows.append((length, self.used[length], self.sequences, offset))
            self.used[length] += times
            offset += length
        self.sequences += times


def plan(counts: dict[int, int], capacity: int) -> Recipe:
    """Fill gaps exactly by one, two or three pieces while counts last; pack the rest best-fit, longest first."""
    out = Recipe(counts)
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    if left[capacity]:
        out.emit((capacity,), int(left[capacity]))
    waiting: list[tuple[int, int]] = []
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            parts = _complement(left, capacity - length)
            left[length] += 1
            if parts is None:
                waiting.append((length, int(left[length])))
                left[length] = 0
                break
            pattern = (length, *parts)
            times = min(int(left[x]) // n for x, n in Counter(pattern).items())
            for x, n in Counter(pattern).items():
                left[x] -= times * n
            out.emit(pattern, times)
    _best_fit(out, waiting, capacity)
    return out


def _complement(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths of sum `gap`, the fewest and longest first."""
    if left[gap]:
        return (gap,)
    have = left[: gap + 1] > 0
    if pair := _pair(left, have, gap):
        return pair
    if gap < 3:
        return None
    # sums of two available lengths, all at once; then the longest third that meets one
    near = have[:gap].astype(np.float64)
    size = 1 << (2 * gap).bit_length()
    sums = np.rint(np.fft.irfft(np.fft.rfft(near, size) ** 2, size))[: gap + 1] > 0
    for first in np.flatnonzero(have[1:gap] & sums[gap - 1 : 0 : -1])[::-1] + 1:
        left[first] -= 1
        pair = _pair(left, left[: gap + 1] > 0, gap - int(first))
        left[first] += 1
        if pair:
            return (int(first), *pair)
    return None


def _pair(left: np.ndarray, have: np.ndarray, gap: int) -> tuple[int, int] | None:
    if gap < 2:
        return None
    half = (gap + 1) // 2
    longer = np.flatnonzero(have[half:gap] & have[gap - half : 0 : -1]) + half
    for a in longer[::-1]:
        if 2 * a != gap or left[a] > 1:
            return int(a), gap - int(a)
    return None


def _best_fit(out: Recipe, waiting: list[tuple[int, int]], capacity: int) -> None:
    """Best fit, longest first, for all pieces of a length at once; open sequences of equal content are one class."""
    classes: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def open_class(pattern: tuple[int, ...], times: int, gap: int) -> None:
        if not classes[gap]:
            bisect.insort(gaps, gap)
        classes[gap].append((pattern, times))

    for length, n in waiting:
        while n:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                pattern, times = classes[gap].pop()
                if not classes[gap]:
                    gaps.pop(at)
                # equal pieces go on into the same sequences while they fit
                each = min(gap // length, -(-n // times))
                if n >= each * times:
                    filled = times
                else:
                    filled, each = (n // each, each) if n >= each else (1, n)
                if filled < times:
                    open_class(pattern, times - filled, gap)
                open_class(pattern + (length,) * each, filled, gap - each * length)
                n -= filled * each
            else:
                each = min(capacity // length, n)
                open_class((length,) * each, n // each, capacity - each * length)
                n %= each
    for gap in gaps:
        for pattern, times in classes[gap]:
            out.emit(pattern, times)


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """The vocabulary of a tokenizers file in tiktoken's encoder, which gives the same ids several times faster."""
    import tiktoken

    from .bpe import PATTERN, load

    bpe = load(path)
    special = bpe.special
    ranks = {raw: i for i, raw in enumerate(bpe.bytes) if raw and i not in special.values()}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _encode(encoder, path: str, text: str) -> np.ndarray:
    """Ids of a text. Texts with a run of blanks so long that tiktoken's pattern gives up go to op2's encoder."""
    if LONG_RUN.search(text):
        from .bpe import load

        return np.array([*load(path).encode_texts([text])][0], np.uint32)
    return encoder.encode_to_numpy(text, allowed_special="all")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise whole texts, end each with `separator`, and cut what is longer than `capacity` (the first piece is shorter).

    Adds for each piece its task (src) and its number among that task's pieces of its length (nth).
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # a worker serves one task at a time, and a task's batches in order
        task = TaskContext.get()
        if counted.get("task") != task.taskAttemptId():
            counted.clear()
            counted["task"], counted["nth"] = task.taskAttemptId(), Counter()
        encoder, nth = _encoder(tokenizer), counted["nth"]
        got: list[tuple] = []
        ids_of: list[np.ndarray] = []
        for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.append(_encode(encoder, tokenizer, t or ""), separator).astype("<u4")
            first = (len(ids) - 1) % capacity + 1
            for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                part = ids[start : start + (capacity if k else first)]
                got.append((doc, k, start, len(part), zlib.crc32(part.tobytes()), task.partitionId(), nth[len(part)]))
                nth[len(part)] += 1
                if keep_ids:
                    ids_of.append(part.astype(np.int32))
        columns = [pa.array(c, k) for c, k in zip(zip(*got, strict=True), _PIECE_TYPES, strict=True)] if got else [pa.array([], k) for k in _PIECE_TYPES]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "src", "nth"]
        if keep_ids:
            columns.append(pa.array(ids_of, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)

    counted: dict = {}
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, src int, nth bigint" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, schema, rows=500)


_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32 (of little-endian 32-bit ids), sequence_id, offset,
    and ids if keep_ids. Null and empty texts are one separator token; null doc_ids stay null; repeated rows are packed
    each; an empty table gives an empty table; other columns are ignored. Ties between pieces of equal length go by
    task and place in it. Texts of any length are cut, never shortened.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    parts = scratch.save(pieces(docs, tokenizer, capacity, separator, keep_ids, doc_id, text))
    # at most `capacity` rows for each task; then a running sum over the tasks, apart for each length
    per_task = scratch.save(parts.groupBy("src", "length").agg(F.count("*").alias("n")))
    # bounded by `capacity` rows
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    recipe = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("src", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = np.array(sorted(recipe.rows) or [(0, 0, 0, 0)], np.int64)
    key = rows[:, 0] << 48 | rows[:, 1]

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "number"))
        at = np.searchsorted(key, length << 48 | nth, side="right") - 1
        columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(rows[at, 2] + nth - rows[at, 1]), pa.array(rows[at, 3])], names=[*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    numbered = parts.join(first, ["src", "length"]).select(*kept, (F.col("first") + F.col("nth")).alias("number"))
    schema = ", ".join(f"{c} {dict(numbered.dtypes)[c]}" for c in kept)
    return map_arrow(numbered, place, f"{schema}, sequence_id bigint, offset bigint", rows=20_000)
