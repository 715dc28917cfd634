"""Sharding, top-k, toxicity, language identification and the pipeline."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from conftest import SCHEMA, prose
from meshweave.llm import language, sharding, topk, toxicity
from pyspark.sql import functions as F


def test_sharding(spark, docs, rows, empty, clashing, tmp_path):
    out = sharding.shard(docs, 5, seed=3)
    got = out.select("doc.doc_id", "doc.text", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for d, t, *_ in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert sharding.shard(empty).count() == 0 and sharding.shard(clashing).select("doc.shard").first()[0] == "own shard"
    sharding.write_shards(out.select("doc.doc_id", "shard", "slot"), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_sharding_spreads_repeated_rows(spark):
    out = sharding.shard(spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text")).crossJoin(spark.range(2000)).drop("id"), 4, bucket_bytes=500)
    assert Counter(r.shard for r in out.select("shard").collect()) == Counter({s: 500 for s in range(4)})


def best(vectors, k, every=100):
    rows = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max([0, *(len(v) for _, v in rows)])
    rows = [(i, np.pad(v, (0, width - len(v)))) for i, v in rows]
    out = []
    for q, vector in rows:
        if q % every == 0:
            scores = sorted(((-int(v @ vector), i) for i, v in rows if i != q))[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=8).round(1).tolist()) for i in range(1205)]
    vectors += [(2000, None), (2001, [float("nan")] * 8), (2002, [None] + [1.0] * 7), (2003, [1.0, 2.0]), (2004, []), (None, [1.0] * 8), (2100, [float("inf")] * 8), (2200, [0.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    assert sorted(tuple(r) for r in topk.top_k(df, 10).collect()) == best(single, 10)
    few = df.where("vec_id in (100, 101, 102)")
    assert [r.vec_id for r in topk.top_k(few, 10).orderBy("rank").collect()] == [r[2] for r in best([v for v in single if v[0] in (100, 101, 102)], 10)]
    assert topk.top_k(df.where("false"), 10).count() == 0


def test_top_k_over_many_blocks(spark, monkeypatch):
    """Repeated rows are a query once and candidates each, ties go to smaller ids, clashing columns are no matter."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "EACH_SALT", 1)
    monkeypatch.setattr(topk, "GROUP", 1)
    monkeypatch.setattr(topk, "SAMPLE", 30)
    rng = np.random.default_rng(8)
    vectors = [(i, rng.integers(-2, 3, size=3).astype(float).tolist()) for i in range(700)]
    vectors += [vectors[100], vectors[100], *vectors[:50]]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    for name in ("q", "block", "ids", "far", "group", "salt", "score", "rank", "query_id", "query_key"):
        df = df.withColumn(name, F.lit("own"))
    assert sorted(tuple(r) for r in topk.top_k(df, 10, every=20).collect()) == sorted(set(best(vectors, 10, 20)))


def test_known_scores():
    ids, q = np.array([5, 7]), np.array([[1, 0], [0, 2]])
    sample_ids, sample = np.array([5, 6, 8]), np.array([[9, 9], [3, 4], [1, 7]])
    assert topk.known_scores(ids, q, sample_ids, sample, 2).tolist() == [1, 14]
    assert topk.known_scores(ids, q, sample_ids, sample, 4).tolist() == [topk._LOWEST] * 2


def test_pivots_save_work():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 50
    q = (centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 8))).round().astype(np.int64)
    wide = q.astype(float)
    pivots = topk.choose_pivots(wide, 20)
    far = np.stack([np.linalg.norm(wide - p, axis=1) for p in pivots], 1)
    ids, scores, looked_at = topk.search_block(q[0], far[0], np.arange(2000), 0, q, far, (wide * wide).sum(1), 10)
    expected = sorted((-int(q[i] @ q[0]), i) for i in range(1, 2000))[:10]
    assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == expected and looked_at < 1500


def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    odds, move = rng.normal(size=7), rng.normal(size=(2, 2))
    weight = {y: np.exp(sum(o for o, s in zip(odds, y) if s) + sum(move[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=7)}
    total = sum(weight.values())
    marginals, moves, log = toxicity.chain_marginals(odds, move)
    np.testing.assert_allclose(marginals, [sum(w for y, w in weight.items() if y[i]) / total for i in range(7)])
    np.testing.assert_allclose(moves, [[sum(w * sum(p == (a, b) for p in itertools.pairwise(y)) for y, w in weight.items()) / total for b in (0, 1)] for a in (0, 1)])
    assert log == pytest.approx(np.log(total))


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        text, toxic = prose(rng, 60), int(rng.random() < 0.25)
        words = text.split(" ")
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["wretch", "vermin", "wretched", "verminous"]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity(spark, toxic_rows, docs, empty, clashing):
    rows, labels = toxic_rows
    df, marked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(df, marked).collect()}
    held = [i for i, _, _ in labels if out[i].held_out]
    truth = {i: t for i, _, t in labels}
    assert 60 < len(held) < 180
    assert np.mean([out[i].predicted == truth[i] for i in held]) > 0.97
    spans = [rows[i][1][s.start : s.end].lower() for i in held for s in out[i].spans]
    assert spans and np.mean(["wretch" in s or "vermin" in s for s in spans]) > 0.95
    model = toxicity.fit(df.join(marked, "doc_id"))
    for table, n in ((docs, docs.count()), (empty, 0), (clashing, docs.count())):
        scored = toxicity.score(table, model).collect()
        assert len(scored) == n and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.fit(df.join(marked.where("toxic = 0"), "doc_id")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_language(spark, docs, empty, clashing):
    rng = random.Random(13)
    vocabulary = {"en": ["the", "and", "morning", "window", "through"], "de": ["der", "und", "schön", "fenster", "durch"], "fr": ["le", "et", "matin", "fenêtre", "à"]}
    rows = [(i, prose(rng, 30, vocabulary[lang]), lang, "s", 0) for i in range(400) for lang in [rng.choice(list(vocabulary))]]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in language.language_id(df).collect()}
    held = [r for r in rows if out[r[0]].held_out]
    assert 60 < len(held) < 140 and all(out[r[0]].lang_pred == r[2] for r in held)
    model = language.fit(df)
    assert model.predict("fensterlein schönes undurch")[0] == "de"  # words never seen: n-grams
    for text in ("", " \n", "123 --- 456", "😀", "½ ② ²", "Ⅷ"):
        assert model.predict(text) == ("und", 0.0)
    assert language.identify(docs, model).count() == language.identify(clashing, model).count() == docs.count()
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(empty)).collect()} == {"und"}


def test_backoff_scores_against_plain_counts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("aa ab aa", "x"), ("ab ba", "y"), ("abab", "y"), ("ca", "x")] * 3)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    counts = {}
    for _, text, lang in rows:
        for w in text.split():
            for n in range(language.LONGEST + 1):
                for g in language.grams(w, n) if n else [w]:
                    counts.setdefault(n, {}).setdefault(g, Counter())[lang] += 1
    total = lambda n, lang: sum(c[lang] for c in counts[n].values())
    log = lambda n, g, lang: math.log((counts[n][g][lang] + 0.1) / (total(n, lang) + 0.1 * len(counts[n]) + 1))

    def plain(word, lang):
        if word in counts[0]:
            return log(0, word, lang)
        for n in range(language.LONGEST, 0, -1):
            if known := [g for g in language.grams(word, n) if g.strip() and g in counts[n]]:
                return sum(log(n, g, lang) for g in known) / len(known)
        return 0.0

    for word in ("aa", "abab", "aba", "cab", "bax", "zzz"):
        assert model.word_scores(word).tolist() == pytest.approx([plain(word, lang) for lang in ("x", "y")], abs=1e-6)


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    good = [prose(rng, 150) for _ in range(12)]
    copy = good[0].split(" ")
    copy[5] = "altered"
    secret = "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(30))
    rows = [(i, t) for i, t in enumerate(good)] + [(100, good[0]), (101, " ".join(copy)), (102, "too short"), (103, None), (104, good[3] + f"\nMy {secret} is here for all to see and to use."), (105, "")]
    folder = tmp_path / "sf"
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(str(folder / "documents.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    stages = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(folder))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        stages.append({r.doc_id: r for r in docs.collect()})
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r.n_chars == len(r.text) for r in stages[-1].values())
    assert set(stages[0]) == {*range(12), 100, 101, 104}  # short and null ones go, clean ones stay
    assert set(range(12)) <= set(stages[1]) and 100 not in stages[1]  # all its lines were document 0's
    assert set(range(12)) <= set(stages[2])
    assert all(secret not in r.text for r in stages[3].values())
    assert set(stages[4]) == set(stages[3])
    assert corpus_pipeline.run(spark, str(folder)).count() == len(stages[4])
