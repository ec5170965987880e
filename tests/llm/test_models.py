"""The two learned operators: held-out accuracy, leakage, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import langid, quality
from tidemill.llm.queries import op6_quality, op7_langid, remainder


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = op6_quality(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_quality_ignores_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(remainder(3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, labels, remainder(3) != 1) == quality.train(docs, flipped, remainder(3) != 1)


def test_quality_rules_compile_to_what_they_say(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    names = list(quality.statistics(F.lit("")))
    for r in quality.described(docs).withColumn("score", model.score()).collect():
        x = {k: np.array([r[k]]) for k in names}
        z = model.intercept + sum(rule.weight for rule in model.rules if rule.holds(x)[0])
        assert abs(1 / (1 + np.exp(-z)) - r["score"]) < 1e-9


def test_quality_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.predict(odd_docs, quality.train(odd_docs, none)).collect()} == {0.5}
    one = odd_docs.select("doc_id", F.lit(1).alias("quality"))
    rows = quality.predict(odd_docs, quality.train(odd_docs, one)).collect()
    assert len(rows) == odd_docs.count() and all(r["predicted"] == 1 for r in rows)
    assert quality.predict(no_docs, quality.train(no_docs, none)).count() == 0


def test_langid_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op7_langid(spark, sf)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_langid_rejects_other_scripts_and_keeps_clean_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    odd = [None, "", "123 456 !!", "日本語の文章です。これは長い文章です。", "это русский текст о чём-то", "𝒳 → 1"]
    extra = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    got = {r["doc_id"] - 10**9: r for r in langid.predict(extra, model).collect()}
    assert all(got[i]["rejected"] for i in range(5))
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[3]["lang_pred"] != "und"
    n = docs.count()
    assert langid.keep(docs, model).count() >= 0.995 * n
    assert langid.keep(docs, model).columns == docs.columns


def test_langid_odd_rows(odd_docs, no_docs):
    model = langid.train(odd_docs)
    assert langid.predict(odd_docs, model).count() == odd_docs.count()
    empty = langid.train(no_docs)
    assert {r["lang_pred"] for r in langid.predict(odd_docs, empty).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0
    assert langid.keep(odd_docs, model).columns == odd_docs.columns
