"""Exact top-k search by pivot-table elimination.

Distances of every vector to a few pivots are computed once. For a query, the triangle inequality turns the two rows
of distances into a lower bound of its distance to each candidate, hence an upper bound of their inner product; the
largest of the bounds counts. Candidates are scored in the order of their bounds until none left can reach the k-th
best score, which is known from below from the start: by the sample that pivots are chosen from, then by the blocks that
a task has been through. Queries and candidates meet block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors from which pivots are chosen (those of smallest hash), and rows in a block.
SAMPLE, BLOCK = 2000, 2048
#: Tasks over which each block of queries is dealt at least, and blocks of candidates that make another one necessary.
SALTS, EACH_SALT = 24, 64
#: Blocks of queries that travel together: candidates are sent to each such group once.
GROUP = 8
_FIRST_CHUNK = 64
_LOWEST = np.iinfo(np.int64).min
#: Blocks of queries whose scores a task remembers.
_REMEMBERED = 1000


def quantised(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, q) with q = floor(scale * component), of vectors without null or non-finite components."""
    x = F.col(embedding)
    fine = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(fine).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double"))).alias("q"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Far apart: each next pivot is the vector farthest from those before."""
    if not len(sample):
        return sample
    chosen, gap = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
        chosen.append(int(gap.argmax()))
    return sample[chosen]


def _blocks(rows: DataFrame, pivots: np.ndarray, width: int, size: int) -> DataFrame:
    """(vec_id, q) to blocks (block, ids, q, far): rows' ids, vectors (0 beyond their end) and distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, q = part.column(0).to_numpy(), _matrix(part.column(1), width)
                wide = q.astype(np.float64)
                far = np.stack([np.linalg.norm(wide - p, axis=1) for p in pivots], 1) if len(pivots) else np.zeros((len(ids), 0))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, q, far)], names=["ids", "q", "far"])

    return rows.select("vec_id", "q").mapInArrow(run, "ids binary, q binary, far binary").select(F.xxhash64("ids").alias("block"), "ids", "q", "far")


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    lists = column.to_pylist()
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def search_block(query: np.ndarray, query_far: np.ndarray, ids: np.ndarray, own: int, q: np.ndarray, far: np.ndarray, lengths: np.ndarray, k: int, least: int = _LOWEST) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best of a block for one query that reach `least`: ids and scores, and how many candidates were scored.

    `lengths` holds the candidates' squared lengths. Ties go to smaller ids.
    """
    near = np.abs(far - query_far).max(1) if far.shape[1] else np.zeros(len(ids))
    size = float(query.astype(np.float64) @ query.astype(np.float64))
    bound = (size + lengths - near * near) / 2
    bound += 1e-9 * (size + lengths) + 1e-3  # for rounding
    order = np.argsort(-bound, kind="stable")
    order = order[ids[order] != own]
    best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, chunk = 0, _FIRST_CHUNK
    while at < len(order) and bound[order[at]] >= least and (len(best) < k or bound[order[at]] >= best[-1]):
        now = order[at : at + chunk]
        best_id, best = np.r_[best_id, ids[now]], np.r_[best, q[now] @ query]
        top = np.lexsort((best_id, -best))[:k]
        best_id, best = best_id[top], best[top]
        at, chunk = at + chunk, chunk * 2
    enough = best >= least
    return best_id[enough], best[enough], min(at, len(order))


def known_scores(ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """What each query's k-th best score is at least, by a sample of the candidates."""
    scores = q @ sample.T
    scores[ids[:, None] == sample_ids] = _LOWEST
    return np.sort(scores, 1)[:, -k] if sample.shape[0] >= k else np.full(len(ids), _LOWEST)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, n_pivots: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k best candidates, by integer inner product, of each query (rows whose id is divisible by `every`).

    Rows: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Candidates are all rows but those of
    the query's own id. Rows whose id or vector is null, or whose vector has a null or non-finite component, take no
    part; shorter vectors count as padded with zeros; repeated rows are a query once, and candidates each; scores wrap
    around beyond 64 bits. An empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = scratch.save(quantised(vectors, scale, vec_id, embedding))
    width = rows.agg(F.max(F.size("q"))).first()[0] or 0
    sample = rows.orderBy(F.xxhash64("vec_id", "q")).limit(SAMPLE).collect()  # SAMPLE rows
    sample_ids, matrix = np.array([r["vec_id"] for r in sample], np.int64), np.zeros((len(sample), width), np.int64)
    for i, r in enumerate(sample):
        matrix[i, : len(r["q"])] = r["q"]
    pivots = choose_pivots(matrix.astype(np.float64), n_pivots)
    # counts follow the table's size; small tables are dealt out so that each of the salts has work
    n_blocks = -(-rows.count() // BLOCK)
    n_salts = max(SALTS, -(-n_blocks // EACH_SALT))
    candidates = scratch.save(_blocks(rows.repartition(2 * n_salts), pivots, width, BLOCK))
    asked = scratch.save(rows.where(F.col("vec_id") % every == 0).dropDuplicates())
    n_asked = -(-asked.count() // BLOCK)
    queries = scratch.save(_blocks(asked.repartition(max(1, n_asked)), pivots, width, BLOCK))
    n = max(1, -(-n_asked // GROUP))
    scratch.drop(rows, asked)
    # each block of queries goes to every salt, each block of candidates to every group of queries' blocks
    salts = F.sequence(F.lit(0), F.lit(n_salts - 1))
    dealt = queries.select(F.pmod("block", F.lit(n)).cast("int").alias("group"), F.explode(salts).alias("salt"), *[F.col(c).alias(f"query_{c}") for c in ("ids", "q", "far")])
    groups = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("group")
    met = candidates.select(groups, F.pmod("block", F.lit(n_salts)).cast("int").alias("salt"), "ids", "q", "far").join(dealt, ["group", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[tuple[bytes, bytes], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, query_ids = (np.frombuffer(row[c], np.int64) for c in ("ids", "query_ids"))
                q, query_q = (np.frombuffer(row[c], np.int64).reshape(len(i), width) for c, i in (("q", ids), ("query_q", query_ids)))
                far, query_far = (np.frombuffer(row[c]).reshape(len(i), -1) for c, i in (("far", ids), ("query_far", query_ids)))
                wide = q.astype(np.float64)
                lengths = (wide * wide).sum(1)
                block = row["query_ids"], xxhash.xxh3_128_digest(row["query_q"])
                if block not in reached:
                    if len(reached) >= _REMEMBERED:
                        reached.clear()
                    reached[block] = known_scores(query_ids, query_q, sample_ids, matrix, k)
                known = reached[block]
                got = [(own, *search_block(vector, f, ids, own, q, far, lengths, k, least)[:2]) for own, vector, f, least in zip(query_ids.tolist(), query_q, query_far, known.tolist(), strict=True)]
                # k candidates of one block that reach a score are k of the whole table's
                reached[block] = np.array([max(s, int(b[-1])) if len(b) == k else s for s, (_, _, b) in zip(known.tolist(), got, strict=True)], np.int64)
                counts = [len(best) for _, _, best in got]
                keys = [xxhash.xxh3_64_intdigest(v.tobytes()) >> 1 for v in query_q]
                columns = [np.repeat(query_ids, counts), np.repeat(np.array(keys, np.int64), counts), *(np.concatenate([np.zeros(0, np.int64), *x]) for x in ([i for _, i, _ in got], [b for _, _, b in got]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "query_key", "vec_id", "score"])

    found = met.select("ids", "q", "far", "query_ids", "query_q", "query_far").mapInArrow(run, "query_id bigint, query_key bigint, vec_id bigint, score bigint")
    # a query has k rows from each block at most, and Spark keeps its k best before it shuffles
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
