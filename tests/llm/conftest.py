"""Documents that hold the hard cases: nulls, empty and very long texts, ties, repeated rows."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng: random.Random, n: int, words: list[str] | None = None) -> str:
    words = words or ["stone", "river", "morning", "light", "paper", "garden", "window", "the", "of", "and", "quiet", "table", "seven", "cloud", "harbour", "letter"]
    out = []
    for k in range(0, n, 12):
        out.append(" ".join(rng.choice(words) + rng.choice(["", "s", "ing", "er"]) for _ in range(min(12, n - k))).capitalize() + ".")
    return "\n".join(out)


def documents() -> list[tuple]:
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(5, 150)) for _ in range(40)]
    texts += ["", None, " \n\t \x0b\x0c\r ", "one", "two words", "\n\n\n", "é 日本語 😀 ß x", "<|endoftext|> between <|endoftext|>", "A" * 5000, prose(rng, 12_000), "x y " * 3000]
    base = prose(rng, 120)
    for k in range(12):  # near copies of one text, and exact ones
        words = base.split(" ")
        for _ in range(k % 6):
            words[rng.randrange(len(words))] = f"changed{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [base] * 4
    rows = [(i, t, ("en", "fr", None)[i % 3], "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id but words enough to count", "en", None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns that operators use themselves or might."""
    from pyspark.sql import functions as F

    names = ["piece", "start", "length", "node", "key", "bucket", "quality", "lines", "base", "all", "_w_body", "_w_words", "score", "shard", "draw"]
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
