import random

import pytest

from tidemill.llm import neardup

from .conftest import near_components, pairs


def check(docs, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.components(docs, k, percent).collect()}
    assert got == near_components(pairs(docs.dropDuplicates(["doc_id"])), k, percent)
    kept = sorted(r["doc_id"] for r in neardup.keep(docs, k, percent).collect())
    assert kept == sorted(i for i, (n, c) in got.items() if i == c or not n)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_families_of_copies(spark, k, percent):
    """A base with independent edits, chains of edits, exact copies, unrelated texts: only some members are alike."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for family in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([30, 80, 200]))]
        now = list(base)
        for _ in range(14):
            edited = list(base if family % 2 else now)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                edited[rnd.randrange(len(edited))] = rnd.choice(words)
            now = edited
            n += 1
            rows.append(((n * 7919) % 100_003, " ".join(edited)))
            if rnd.random() < 0.2:
                n += 1
                rows.append(((n * 7919) % 100_003, " ".join(edited).upper()))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, 5, 80)
    assert neardup.components(odd_docs, 3, 85).count() == odd_docs.count()
    assert neardup.components(no_docs).count() == 0
    kept = neardup.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {0, 1, 2, 3} <= set(ids) and 7 not in ids


def test_miss_is_bounded():
    for percent in (80, 85, 95):
        m = neardup.tuples_for(percent / 100)
        assert 2 * (1 - (percent / 100) ** neardup.R) ** m <= neardup.MISS


def test_rows_with_one_id_are_one_document(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")
    rows = [(3, a), (5, a), (4, b), (5, b), (9, c), (9, ""), (7, c), (2, ""), (2, None), (8, "else where it goes on and on")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == sorted([(3, 3, True), (5, 3, False), (4, 3, False), (5, 3, False), (9, 7, False), (9, 7, False), (7, 7, True), (2, 2, True), (2, 2, True), (8, 8, True)])


def test_rows_without_an_id(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six"
    rows = [(None, a), (6, a), (None, a), (None, b), (None, b + " "), (None, ""), (None, None), (7, "x y z"), (7, "x y z")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _kx int")
    got = sorted(map(str, ((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.components(docs, 3, 85).collect())))
    null = (None, None, True)
    assert got == sorted(map(str, [(None, 6, False), (6, 6, True), (None, 6, False), null, null, null, null, (7, 7, True), (7, 7, True)]))
    kept = neardup.keep(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], (r["text"] or "").strip()) for r in kept.collect()))) == sorted(map(str, [(6, a), (None, b), (None, ""), (None, ""), (7, "x y z")]))
