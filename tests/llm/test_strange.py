"""All operators and stages on rows without ids, ids with several texts, clashing column names, and one very long text."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import bpe, common, decontam, langid, license, linededup, neardup, pii, quality, shards
from tidemill.llm import queries as q

from .conftest import shingle_set
from .test_decontam import brute
from .test_pii import base

WATCH = "alpha beta gamma delta epsilon zeta eta theta"


def bag(df):
    return Counter(map(str, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def folder(spark, strange_docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("strange"))
    strange_docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, WATCH, "x"), (None, "mail joe", "y"), (2, None, "z")], "item_id long, text string, kx string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (9, 1, None), (8, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_bpe(strange_docs):
    lib = Tokenizer.from_file(bpe.vocabulary())
    want = Counter()
    for r in strange_docs.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))]
        want[str((r["doc_id"], len(ids), *sha))] += 1
    assert bag(bpe.digests(strange_docs)) == want


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_decontamination(spark, strange_docs, folder, limit):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in strange_docs.collect()]
    want = brute(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert bag(decontam.report(strange_docs, items, broadcast_bytes=limit)) == Counter(map(str, want))
    out = decontam.clean(strange_docs, items, broadcast_bytes=limit)
    assert out.columns == strange_docs.columns
    bad = {t for (_, t), r in zip(rows, [brute([x], [(i["item_id"], i["text"]) for i in items.collect()])[0] for x in rows], strict=True) if r[-1]}
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(x for x in rows if x[1] not in bad)


def test_near_duplicates(strange_docs):
    """Rows with one id are one document; the groups are those of a plain search over all rows."""
    rows = [(r["doc_id"], r["text"]) for r in strange_docs.collect()]
    sets = [shingle_set(t, 3) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if (rows[i][0] is not None and rows[i][0] == rows[j][0]) or (same and 100 * same >= 85 * (len(sets[i]) + len(sets[j]) - same)):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = Counter(str((d, len(s), least[g], d == least[g])) for (d, _), s, g in zip(rows, sets, group, strict=True))
    assert bag(neardup.components(strange_docs, 3, 85)) == want
    kept = neardup.keep(strange_docs, 3, 85)
    assert kept.columns == strange_docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    full = [x for x in got if shingle_set(x[1], 3)]
    assert len(full) == len({g for g, s in zip(group, sets, strict=True) if s}) and len(got) - len(full) == 3


def test_sharding(strange_docs):
    rows = shards.assign(strange_docs, 5).collect()
    assert len(rows) == strange_docs.count() == len({(r["shard"], r["slot"]) for r in rows})


def test_many_sources_give_the_same_shards(spark, monkeypatch):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    want = bag(shards.assign(docs, 7))
    monkeypatch.setattr(shards, "BROADCAST_BYTES", 0)
    monkeypatch.setattr("tidemill.llm.common.HOT_ROWS", 10)
    assert bag(shards.assign(docs, 7)) == want


def test_line_dedup(strange_docs):
    rows = [(r["doc_id"], r["text"]) for r in strange_docs.collect()]
    owners = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(line.strip()) >= 10:
                owners.setdefault(line.strip().lower(), set()).add(d)

    def kept(d, t):
        return [x for x in (t or "").split("\n") if d is None or len(o := owners.get(x.strip().lower(), ())) < 2 or d == min(o)]

    want = Counter(str((d, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept(d, t)), hashlib.sha256("\n".join(kept(d, t)).encode()).hexdigest())) for d, t in rows)
    assert bag(linededup.report(strange_docs)) == want
    out = linededup.dedup(strange_docs)
    assert out.columns == strange_docs.columns
    assert Counter((r["doc_id"], r["text"] or "", r["_drop"], r["_drop_id"]) for r in out.collect()) == Counter((d, "\n".join(kept(d, t)), 0, 1) for d, t in rows)


def test_personal_data(strange_docs):
    want = Counter((r["doc_id"], ",".join(base(r["text"]))) for r in strange_docs.collect())
    assert Counter((r["doc_id"], r["spans"]) for r in pii.report(strange_docs).collect()) == want
    out = pii.masked(strange_docs)
    assert out.columns == strange_docs.columns
    assert Counter((r["doc_id"], r["text"], r["_spans"], r["_span_id"]) for r in out.collect()) == Counter((r["doc_id"], r["text"] and r["text"].replace("joe@x.org", "*" * 9).replace("10.0.0.1", "*" * 8), 2, 3) for r in strange_docs.collect())


def test_models(strange_docs, folder, spark):
    n = strange_docs.count()
    model = langid.train(strange_docs)
    assert langid.predict(strange_docs, model).count() == n and langid.keep(strange_docs, model).columns == strange_docs.columns
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert quality.predict(strange_docs, quality.train(strange_docs, labels)).count() == n
    for query in (q.op6_quality, q.op7_langid):
        got = query(spark, folder).collect()
        assert len(got) == n and not any(r["held_out"] for r in got if r["doc_id"] is None) and None not in {r["held_out"] for r in got}


def test_too_many_languages_are_an_error(strange_docs, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 1)
    with pytest.raises(ValueError):
        langid.train(strange_docs.withColumn("lang", F.xxhash64("text").cast("string")))


def test_licences(strange_docs):
    assert license.scan(strange_docs).count() == strange_docs.count()


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_queries_and_schemas(spark, folder, name):
    if name == "op5_topk":
        pytest.skip("reads embeddings")
    assert q.QUERIES[name](spark, folder).count() == len(spark.read.parquet(f"{folder}/documents.parquet").collect())


def test_stages(spark, strange_docs, folder):
    docs = strange_docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, strange_docs, folder)
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.collect()
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_one_very_long_text(spark, tmp_path):
    """20 MB in one row among short ones, through every operator."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(5000)])
    long = " ".join(words[rng.integers(0, 5000, 3_600_000)].tolist()) + "\nsee joe@x.org"
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, "short text here", "en", "a", 15), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(long.split(" ")[1000:1030]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert len(long) > 20_000_000
    got = {name: {r["doc_id"]: r for r in f(spark, str(tmp_path)).collect()} for name, f in q.QUERIES.items() if name != "op5_topk"}
    assert all(set(g) == {1, 2, 3} for g in got.values())
    assert got["op2_decontamination"][1]["n_hit"] == 30 and got["op2_decontamination"][1]["n_words"] == 3_600_004
    assert got["op10_pii"][1]["n_email"] == 1 and got["op8_line_dedup"][1]["n_lines"] == 2
    assert got["op3_minhash"][1]["n_shingles"] > 3_500_000


@pytest.mark.parametrize("least", [1000, 2])
def test_skewed_joins_equal_plain_ones(spark, monkeypatch, least):
    monkeypatch.setattr(common, "HOT_ROWS", least)
    rows = spark.range(500).select((F.col("id") % F.when(F.col("id") < 300, 1).otherwise(37)).alias("k"), "id")
    table = rows.where("k != 5").groupBy("k").agg(F.count("*").alias("n"))
    assert bag(common.join_skewed(rows, table, ["k"], "n").select("k", "id", "n")) == bag(rows.join(table, "k").select("k", "id", "n"))
