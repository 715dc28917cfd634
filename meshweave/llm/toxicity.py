"""Toxic spans by a linear-chain conditional random field.

Labels are by document, so tokens are labelled first: words and word beginnings that nearly only toxic documents have
mark their tokens in toxic documents. A two-state chain learns from these tokens; its features are levels of a token's
evidence as a word and as beginnings of four to six letters. Forward-backward marginals give each token's probability of
being toxic; a logistic model over a document's marginals gives its score, and runs of likely tokens its spans.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow
from .training import bounded, crc_part

WORD = regex.compile(r"\p{L}+")
#: Bounds of fitting: labelled documents that evidence is counted on, documents the chain learns from, features kept.
EVIDENCE_DOCS, CHAIN_DOCS, FEATURES = 16_000, 3000, 20_000
#: Least number of toxic documents with a feature, and least log odds of it.
LEAST_DOCS, LEAST_ODDS = 4, 2.5
#: Evidence levels of a token for each of its features; 0 is none.
LEVELS = 4
_WORDS_KEPT = 400_000
KINDS = ("w", "4", "5", "6")


def features(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings of four to six letters."""
    return ("w" + word, *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n))


class _Odds(dict):
    """Words' odds, remembered."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > _WORDS_KEPT:
            self.clear()
        self[word] = odds = self.model.word_odds(word)
        return odds

    def __reduce__(self):
        return (_Odds, (self.model,))


@dataclass
class Model:
    """Evidence by feature, the chain's weights, and the document model's."""

    level: dict[str, int]
    emit: np.ndarray  # kinds x levels: log odds of the toxic state
    bias: float
    move: np.ndarray  # 2 x 2
    weights: np.ndarray
    offset: float

    def __post_init__(self) -> None:
        self.known = _Odds(self)
        self.plain: dict[int, float] = {}

    def word_odds(self, word: str) -> float:
        """Log odds of the toxic state for a word by itself; the bias where nothing is known of it."""
        return self.bias + sum(self.emit[KINDS.index(f[0]), self.level[f]] for f in features(word) if f in self.level)

    def potentials(self, words: list[str]) -> np.ndarray:
        """Log odds of each word by itself."""
        return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))

    def plain_score(self, n: int) -> float:
        """The score of n words of which nothing is known; many texts have the same number."""
        if n not in self.plain:
            self.plain[n] = self.score(chain_marginals(np.full(n, self.bias), self.move)[0])
        return self.plain[n]

    def marginals(self, words: list[str]) -> np.ndarray:
        """Each token's probability of being toxic."""
        return chain_marginals(self.potentials(words), self.move)[0]

    def score(self, marginals: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(summary(marginals) @ self.weights) + self.offset))))


def chain_marginals(odds: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over two states: marginals of state 1, expected moves (2 x 2), log partition.

    Long stretches of tokens of equal odds converge, so messages are computed token by token only near others.
    """
    n = len(odds)
    if not n:
        return odds, np.zeros((2, 2)), 0.0
    t00, t01, t10, t11 = np.exp(move).ravel().tolist()
    e = np.exp(np.clip(odds, -60, 60)).tolist()
    f0, f1, log = [0.0] * n, [0.0] * n, 0.0
    a, b = 1.0, e[0]
    for i in range(n):
        if i:
            a, b = a * t00 + b * t10, (a * t01 + b * t11) * e[i]
        s = a + b
        a, b = a / s, b / s
        log += math.log(s)
        f0[i], f1[i] = a, b
    out = np.empty(n)
    c, d = 1.0, 1.0
    moves = [0.0] * 4
    for i in range(n - 1, -1, -1):
        p, q = f0[i] * c, f1[i] * d
        out[i] = q / (p + q)
        if i:
            x, y = c, d * e[i]
            g0, g1 = f0[i - 1], f1[i - 1]
            m = (g0 * t00 * x, g0 * t01 * y, g1 * t10 * x, g1 * t11 * y)
            s = sum(m)
            for k in range(4):
                moves[k] += m[k] / s
            c, d = t00 * x + t01 * y, t10 * x + t11 * y
            s = c + d
            c, d = c / s, d / s
    return out, np.array(moves).reshape(2, 2), log


def summary(marginals: np.ndarray) -> np.ndarray:
    """What the document model sees: the largest marginal, their sum, and their share."""
    if not len(marginals):
        return np.zeros(3)
    top, total = float(marginals.max()), float(marginals.sum())
    return np.array([top, math.log1p(total), min(1.0, 20 * total / len(marginals))])


def _fit_chain(docs: list[tuple[list[str], int]], level: dict[str, int]) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient ascent on the likelihood of the labelled tokens."""
    emit, bias, move = np.zeros((len(KINDS), LEVELS + 1)), -2.0, np.zeros((2, 2))
    seen = []
    for words, toxic in docs:
        levels = np.zeros((len(words), len(KINDS)), np.int64)
        for i, w in enumerate(words):
            for f in features(w):
                levels[i, KINDS.index(f[0])] = level.get(f, 0)
        y = ((levels.max(1, initial=0) > 0) & bool(toxic)).astype(np.int64)
        # far from any evidence nothing is to be learned beyond the bias: such tokens are left out, but for a margin
        near = np.flatnonzero(levels.any(1))
        keep = np.unique(np.clip(near[:, None] + np.arange(-4, 5), 0, max(0, len(words) - 1)).ravel()) if len(near) else np.arange(min(12, len(words)))
        if len(keep):
            seen.append((levels[keep], y[keep]))
    n = max(1, sum(len(y) for _, y in seen))
    for step in range(40):
        g_emit, g_bias, g_move = np.zeros_like(emit), 0.0, np.zeros((2, 2))
        for levels, y in seen:
            odds = bias + emit[np.arange(len(KINDS)), levels].sum(1)
            p, moves, _ = chain_marginals(odds, move)
            rest = y - p
            for k in range(len(KINDS)):
                g_emit[k] += np.bincount(levels[:, k], rest, LEVELS + 1)
            g_bias += rest.sum()
            g_move -= moves
            np.add.at(g_move, (y[:-1], y[1:]), 1)
        g_emit[:, 0] = 0
        rate = 8.0 / (1 + step / 10)
        emit += rate * (g_emit / n - 1e-4 * emit)
        bias += rate * (g_bias / n)
        move += rate * (g_move / n - 1e-3 * move)
        move[0, 0] = 0
    return emit, bias, move


def _fit_scores(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, slightly held back."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        hold = np.r_[np.full(x.shape[1], 0.05), 1e-6]
        hessian = (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(hold)
        w += np.linalg.solve(hessian, x1.T @ (y - p) - hold * w)
    return w[:-1], float(w[-1])


def fit(rows: DataFrame, evidence_docs: int = EVIDENCE_DOCS, chain_docs: int = CHAIN_DOCS) -> Model | None:
    """Learn from rows (doc_id, text, toxic) of toxic 0 or 1; null if one of the labels doesn't occur.

    Both samples are bounded, by a hash of doc_id. Of texts of one label that share their longest line
    (copies), one counts.
    """
    scratch = Scratch(rows.sparkSession, "toxic")
    rows = rows.where("doc_id is not null and text is not null and toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    longest = F.aggregate(F.split("text", "\n"), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    once = bounded(rows, "doc_id", evidence_docs).groupBy(F.xxhash64(longest).alias("line"), F.col("toxic").alias("mark")).agg(F.min_by(F.struct("doc_id", "text", "toxic"), "doc_id").alias("d")).select("d.*")
    sample = scratch.save(once)
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()), pa.array([counts[0][f] for f in names], pa.int64())], names=["feature", "t", "n"])

    counts = map_arrow(sample.select("text", "toxic"), count, "feature string, t bigint, n bigint", rows=500).groupBy("feature").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    odds = F.ln((F.col("t") + 0.5) / (totals[1] + 1)) - F.ln((F.col("n") + 0.5) / (totals[0] + 1))
    top = counts.where(F.col("t") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("t"), "feature").limit(FEATURES)
    level = {r["feature"]: 1 + min(LEVELS - 1, int((r["odds"] - LEAST_ODDS) // 1.2)) for r in top.collect()}  # FEATURES rows
    chosen = bounded(sample, "doc_id", chain_docs, seed=18).orderBy("doc_id").collect()  # about chain_docs rows
    docs = [(WORD.findall(r["text"].lower()), r["toxic"]) for r in chosen]
    emit, bias, move = _fit_chain(docs, level)
    model = Model(level, emit, bias, move, np.zeros(3), 0.0)
    x = np.array([summary(model.marginals(words)) for words, _ in docs])
    model.weights, model.offset = _fit_scores(x, np.array([t for _, t in docs]))
    model.known.clear()
    model.plain.clear()
    return model


def spans_of(text: str, model: Model) -> tuple[float, list[tuple[int, int]]]:
    """A text's score, and its toxic spans as code-point offsets (end exclusive)."""
    lowered = text.lower()
    words = WORD.findall(lowered)
    odds = model.potentials(words)
    if not (odds != model.bias).any():
        return model.plain_score(len(words)), []
    found = [(m.start(), m.end()) for m in WORD.finditer(text)]
    if len(found) != len(words):  # lower case may come apart differently; places are those of the text
        odds = model.potentials([text[s:e].lower() for s, e in found])
    marginals = chain_marginals(odds, model.move)[0]
    spans: list[tuple[int, int]] = []
    last = -2
    for i in np.flatnonzero(marginals >= 0.5).tolist():
        if i == last + 1:
            spans[-1] = (spans[-1][0], found[i][1])
        else:
            spans.append((found[i][0], found[i][1]))
        last = i
    return model.score(marginals), spans


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text: rows (doc_id, score, predicted, spans).

    spans are the toxic passages' places. Null and empty texts have the score of a text without evidence and no span;
    without a model (one of the labels never occurred) every score is 0. Null doc_ids stay; repeated rows are scored
    each; an empty table gives an empty table; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = [spans_of(t or "", model) if model else (0.0, []) for t in batch.column(1).to_pylist()]
        spans = [[{"start": s, "end": e} for s, e in x] for _, x in got]
        scores = [s for s, _ in got]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            names=["doc_id", "score", "predicted", "spans"],
        )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, run, "doc_id bigint, score double, predicted int, spans array<struct<start:int,end:int>>", rows=500)


def toxicity(docs: DataFrame, labels: DataFrame, held_out_parts: int = 5) -> DataFrame:
    """Fit on labelled rows outside the held-out part (crc32 of doc_id modulo `held_out_parts` is 0) and score all."""
    allowed = labels.where(F.col("toxic").isNotNull() & (crc_part("doc_id", held_out_parts) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    allowed = bounded(allowed, "doc_id", 2 * EVIDENCE_DOCS, seed=19)
    model = fit(docs.select("doc_id", "text").join(F.broadcast(allowed), "doc_id"))
    return score(docs, model).withColumn("held_out", crc_part("doc_id", held_out_parts) == 0)
