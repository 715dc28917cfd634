"""Language identification, words first.

A word that training texts had is scored by its log frequency in each language; an unseen one by its longest known
character n-grams, from four letters down to one. A text's language is that of the largest sum over its words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow
from .training import bounded, crc_part

WORD = regex.compile(r"\p{L}+")
#: Bounds of fitting: documents to learn from, and rows (words or n-grams) that the model keeps,
#: shared out evenly among the languages.
TRAIN_DOCS, MODEL_ROWS = 10_000, 150_000
LONGEST = 4
#: Words whose scores a worker remembers.
_KEPT = 300_000


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its borders."""
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Counts of words (length 0) and n-grams by language (rows of a matrix), and each length's totals."""

    languages: list[str]
    place: dict[int, dict[str, int]]
    counts: np.ndarray
    totals: dict[int, np.ndarray]
    row_of: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def _log(self, n: int, counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.1) / (self.totals[n] + 0.1 * len(self.place[n]) + 1))

    def word_scores(self, word: str) -> np.ndarray:
        """Log frequency by language: the word's, or the mean of its longest known n-grams'."""
        if (seen := self.place[0].get(word)) is not None:
            return self._log(0, self.counts[seen])
        for n in range(LONGEST, 0, -1):
            known = [at for g in grams(word, n) if g.strip() and (at := self.place[n].get(g)) is not None]
            if known:
                return self._log(n, self.counts[known]).mean(axis=0)
        return np.zeros(len(self.languages))

    def predict(self, text: str) -> tuple[str, float]:
        """Language and its posterior, or und and 0 where there is nothing to go by."""
        words = Counter(WORD.findall(text.lower()))
        if not words or not self.languages:
            return "und", 0.0
        if len(self.row_of) > _KEPT:
            self.row_of.clear()
        new = [w for w in words if w not in self.row_of]
        if new:
            at = len(self.row_of)
            if len(self.rows) < at + len(new) or not at:
                grown = np.zeros((max(1024, 2 * (at + len(new))), len(self.languages)))
                if at:
                    grown[:at] = self.rows[:at]
                self.rows = grown
            for i, w in enumerate(new, at):
                self.rows[i] = self.word_scores(w)
                self.row_of[w] = i
        times = np.fromiter(words.values(), np.float64, len(words))
        total = times @ self.rows[[self.row_of[w] for w in words]]
        best = int(total.argmax())
        return self.languages[best], 1 / float(np.exp(np.clip(total - total[best], -700, 0)).sum())


def fit(rows: DataFrame, train_docs: int = TRAIN_DOCS, model_rows: int = MODEL_ROWS) -> Model:
    """Learn from rows (doc_id, text, lang); the sample is bounded by a hash of doc_id, the model by its rows."""
    scratch = Scratch(rows.sparkSession, "language")
    rows = rows.where("text is not null and lang is not null")
    sample = bounded(rows.select("doc_id", "lang", "text"), "doc_id", train_docs)

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault((lang, 0), Counter()).update(WORD.findall(text.lower()))
        # n-grams of each different word once, however often it occurs
        for lang, words in [(lang, x) for (lang, _), x in counts.items()]:
            for n in range(1, LONGEST + 1):
                mine = counts.setdefault((lang, n), Counter())
                for w, times in words.items():
                    for g in grams(w, n):
                        mine[g] += times
        got = [(lang, n, g, c) for (lang, n), x in counts.items() for g, c in x.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], k) for i, k in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "n", "gram", "c"])

    counted = map_arrow(sample.select("text", "lang"), count, "lang string, n int, gram string, c bigint", rows=1000)
    counted = scratch.save(counted.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")))
    totals = counted.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()  # a few rows a language
    languages = sorted({r["lang"] for r in totals})
    best = Window.partitionBy("lang").orderBy(F.desc("c"), "n", "gram")
    each = max(1, model_rows // max(1, len(languages)))
    top = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= each).orderBy("lang", "place").drop("place").toArrow()  # model_rows rows
    scratch.drop(counted)
    column = {lang: i for i, lang in enumerate(languages)}
    place: dict[int, dict[str, int]] = {n: {} for n in range(LONGEST + 1)}
    rows = np.empty(top.num_rows, np.int64)
    size = 0
    for i, (n, gram) in enumerate(zip(top.column("n").to_pylist(), top.column("gram").to_pylist(), strict=True)):
        rows[i] = place[n].setdefault(gram, size)
        size += int(rows[i] == size)
    counts = np.zeros((size, len(languages)), np.float32)
    counts[rows, [column[x] for x in top.column("lang").to_pylist()]] = top.column("c").to_numpy()
    model = Model(languages, place, counts, {n: np.zeros(len(languages)) for n in range(LONGEST + 1)})
    for r in totals:
        model.totals[r["n"]][column[r["lang"]]] = r["c"]
    return model


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The language of every whole text: rows (doc_id, lang_pred, score), the score being the posterior.

    Texts that are null or have no letter are und with score 0; und too is all a model without languages says. Null
    doc_ids stay; repeated rows are judged each; ties go to the first language by name; an empty table gives an empty
    table; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_ROWS rows

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = shared.value
        got = [known.predict(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, run, "doc_id bigint, lang_pred string, score double", rows=1000)


def language_id(docs: DataFrame, held_out_parts: int = 4, held_out: int = 2) -> DataFrame:
    """Fit on documents of known language outside the held-out part (by crc32 of doc_id), then identify all."""
    learned = docs.where(crc_part("doc_id", held_out_parts) != held_out)
    return identify(docs, fit(learned)).withColumn("held_out", crc_part("doc_id", held_out_parts) == held_out)
