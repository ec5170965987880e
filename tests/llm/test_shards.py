import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemill.llm import shards
from tidemill.llm.queries import op4_sharding


def test_whole_table(spark, sf):
    rows = op4_sharding(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) <= set(range(24)) and max(sizes.values()) - min(sizes.get(i, 0) for i in range(24)) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    for r in rows:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), "rows", None)
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in op4_sharding(spark, sf).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


@pytest.mark.parametrize("bucket", [1000, 3])
def test_every_shard_has_the_mixture(spark, monkeypatch, bucket):
    monkeypatch.setattr(shards, "BUCKET_ROWS", bucket)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 200, "hot").when(F.col("id") < 400, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    rows = shards.assign(docs, 10).collect()
    for source, total in (("hot", 200), (None, 200), ("s1", 40)):
        got = Counter(r["shard"] for r in rows if r["source"] == source)
        assert all(abs(got[i] - total / 10) <= 1 for i in range(10))


def test_odd_rows(odd_docs, no_docs):
    rows = shards.assign(odd_docs, 24).collect()
    assert len(rows) == odd_docs.count() == len({(r["shard"], r["slot"]) for r in rows})
    assert {r["size"] for r in rows if r["doc_id"] in (0, 1)} == {8}
    assert shards.assign(no_docs, 24).count() == 0
    assert shards.assign(odd_docs, 1).agg(F.max("slot")).first()[0] == odd_docs.count() - 1
