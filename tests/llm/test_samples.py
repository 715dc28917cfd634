"""Bounded samples."""

from __future__ import annotations

from meshweave.llm import toxicity
from meshweave.llm.training import bounded
from pyspark.sql import functions as F


def test_a_sample_of_a_sample_is_bounded(spark, monkeypatch):
    sizes = []

    def counted(rows, doc_id, most, **more):
        out = bounded(rows, doc_id, most, **more)
        sizes.append((most, out.count()))
        return out

    monkeypatch.setattr(toxicity, "bounded", counted)
    word = F.when(F.col("id") % 2 == 0, "vile hateful words of scorn").otherwise("quiet friendly words of praise")
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.col("id"), F.lit(" "), word).alias("text"), (1 - F.col("id") % 2).alias("toxic"))
    toxicity.fit(rows, evidence_docs=800, chain_docs=80)
    assert [most for most, _ in sizes] == [800, 80]
    assert all(0.6 * most < n < 1.4 * most for most, n in sizes)
