import hashlib
import re

import pytest

from tidemill.llm import decontam
from tidemill.llm.common import flat_utf8  # noqa: F401

from .conftest import ascii_lower, pairs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=13):
    windows = {}
    for i, t in items:
        w = WORD.findall(ascii_lower(t))
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = WORD.findall(ascii_lower(t))
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    found |= windows[k]
                    hit |= set(range(a, a + n))
        names = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark):
    long = " ".join(f"W{i % 997}" for i in range(40, 90))
    rows = [(1, "the quick brown fox jumps over the lazy dog while seven wise owls keep watch"), (2, "one"), (3, ""), (4, None), (5, long), (6, "tail"), (7, "b c"), (7, "b c"), (8, "日本語 の 文章"), (9, "la la la la la la la la la la la la la la la la")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_both_ways_equal_brute_force(odd_docs, items, limit, spark):
    more = spark.createDataFrame([(100, "la " * 500), (101, "x " * 400 + "the quick brown fox jumps over the lazy dog while seven wise owls")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(more)
    got = decontam.report(docs, items, broadcast_bytes=limit)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(pairs(docs), pairs(items.withColumnRenamed("item_id", "doc_id")))


def test_empty_tables(odd_docs, no_docs, items):
    assert decontam.report(no_docs, items).count() == 0
    for limit in (decontam.BROADCAST_BYTES, -1):
        rows = decontam.report(odd_docs, items.limit(0), broadcast_bytes=limit).collect()
        assert len(rows) == odd_docs.count() and not any(r["contaminated"] for r in rows)


def test_whole_table(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute(pairs(docs), pairs(bench.withColumnRenamed("item_id", "doc_id")))
    assert sorted(map(tuple, decontam.report(docs, bench).collect()), key=str) == want
    assert sorted(map(tuple, decontam.report(docs, bench, broadcast_bytes=0).collect()), key=str) == want


def test_clean_keeps_columns(odd_docs, items):
    out = decontam.clean(odd_docs, items)
    assert out.columns == odd_docs.columns
    assert {6, 7, 8}.isdisjoint(r["doc_id"] for r in out.collect())
    assert 0 in {r["doc_id"] for r in out.collect()}
