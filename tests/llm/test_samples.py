from __future__ import annotations

import time

from pyspark.sql import functions as F

from provenlake.llm import byte_cnn, mixture, quality_knn
from provenlake.llm._base import hash_sample


def test_an_id_on_many_rows_is_one_text_of_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_knn, "LatentVoter", lambda x, y, shares: seen.append((len(y), shares)))
    docs = spark.range(4000).select((F.col("id") % 4 * 3).alias("doc_id"), F.concat(F.lit("some text number "), "id").alias("text"))
    labels = spark.createDataFrame([(0, 1), (3, 0), (6, 1), (9, 0)], "doc_id long, quality int")
    from provenlake.llm._base import held_out

    quality_knn.train(docs, labels)
    assert seen and seen[0][0] <= 4 - labels.where(held_out(F.col("doc_id"))).count()
    rows = []
    monkeypatch.setattr(byte_cnn.ByteCNN, "fit", lambda self, x, y, epochs: rows.append(len(y)) or self)
    byte_cnn.train(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")))
    assert rows and rows[0] <= 4 * byte_cnn.WINDOWS_PER_TEXT


def test_labels_are_bounded_and_texts_without_letters_cost_no_language(spark, monkeypatch):
    from provenlake.llm import _base

    monkeypatch.setattr(_base, "MOST_LABELS", 3)
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 20).cast("string").alias("lang"))
    rows = rows.unionByName(spark.range(1000, 1100).select("id", F.lit("0").alias("lang")))
    sample, counts = hash_sample(rows, "lang", "id", 5, 100)
    assert counts == {"0": 120, "1": 20, "10": 20} and {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()} == {"0": 5, "1": 5, "10": 5}
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "ja, ein wort").when(F.col("id") % 2 == 0, "1 2 3").otherwise("some words").alias("text"), F.when(F.col("id") % 2 == 0, "de").otherwise("en").alias("lang"))
    got = []
    monkeypatch.setattr(byte_cnn.ByteCNN, "fit", lambda self, x, y, epochs: got.append((self, len(y))) or self)
    byte_cnn.train(docs, per_lang=4)
    assert sorted(got[0][0].langs) == ["de", "en"] and got[0][1] == 8 * 1


def test_budgets_of_very_many_sources(spark):
    leaves = spark.range(100_000).select(F.lit("d").alias("domain"), F.lit("en").alias("lang"), F.col("id").cast("string").alias("source"), (F.col("id") % 97 + 1).alias("tokens"))
    began = time.time()
    total = mixture.leaf_budgets(leaves, 0.5, 3).agg(F.sum("budget"), F.sum("tokens")).first()
    assert time.time() - began < 30 and abs(total[0] - total[1] / 2) < 100_000
