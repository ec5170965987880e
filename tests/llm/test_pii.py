import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import pii

from .conftest import pairs

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
BITS = ["a@b.c", "x.y+z@", "@", "foo@bar.com%q@r.st", "1.2.3.4", "1.2.3.45.6.7.8", ".", "+", "+1 (234) 555-1234", "4111 1111 1111 1111", "4111-1111-1111-1111 ", " ", "  ", "é😀", "12", "+12345678", "999.1.1.1", "0001.2.3.255", "(555) 123-4567", "a (at) b (dot) com", "-", "5", "+4 ", "00 49"]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in p.finditer(text or "") if passes(k, m[0])]


def votes(kind, m, text, loose):
    """The labelers' votes on a match, from the definition."""
    s, d = m[0], re.sub("[^0-9]", "", m[0])
    if kind == "email":
        inside = bool(re.search(r"[A-Za-z0-9][^A-Za-z0-9@(\[]*(?:@|[(\[]at).*[^A-Za-z0-9][A-Za-z]{2,}$", s, re.S))
    elif kind == "ip":
        inside = bool(set(s) - set("0:")) if loose else passes(kind, s) and not any(len(p) > 1 and p[0] == "0" for p in s.split("."))
    elif kind == "phone":
        inside = 10 <= len(d) <= 15 and not re.fullmatch("1?[01][0-9]{9}", d) if loose else passes(kind, s)
    else:
        inside = passes(kind, s)
    before, after = text[max(0, m.start() - 40, text_gap(m)) : m.start()], text[m.end() : m.end() + 1]
    free = not re.search(r"[^\W_]$", before) and not re.match(r"[^\W_]", after)
    return (not loose, inside, bool(re.search(pii.GAZETTEER[kind], s)), bool(re.search(pii.CUES[kind], before, re.A)), free)


def text_gap(m):
    return getattr(m, "gap", 0)


class Match:
    """A match that knows where the one before it ended: context goes back no further."""

    def __init__(self, m, gap):
        self.m, self.gap, self.start, self.end = m, gap, m.start, m.end

    def __getitem__(self, i):
        return self.m[i]


def matches(pattern, text):
    out, last = [], 0
    for m in pattern.finditer(text):
        out.append(Match(m, last))
        last = m.end()
    return out


def brute_spans(rows):
    """{(id, text): the span string} by plain Python; only the fit of weights to counted votes is shared."""
    cand = {}
    for i, t in rows:
        t = t or ""
        strict = BASE | {"card": re.compile(r"[0-9]([\x20-]?[0-9]){12,}")}  # shorter ones are no candidates
        cand[i, t] = {k: [(m.start(), m.end(), votes(k, m, t, False), passes(k, m[0])) for m in matches(p, t)] + [(m.start(), m.end(), votes(k, m, t, True), False) for m in matches(re.compile(pii.LOOSE[k]), t)] for k, p in strict.items()}
    weights = {}
    for k in BASE:
        n = Counter(c[2] for i, t in rows for c in cand[i, t or ""][k])
        if n:
            v, c = np.array(sorted(n), float), np.array([n[x] for x in sorted(n)], float)
            weights[k] = pii.classifier(v, c, pii.reliabilities(v, c))
    out = {}
    for key, kinds in cand.items():
        said = []
        for k, cs in kinds.items():
            free = lambda c, taken: not any(a < c[1] and c[0] < b for a, b in taken)
            yes = lambda c, k=k: float(np.dot(weights[k], [*c[2], 1])) > np.log(9)
            taken = [c[:2] for c in cs if c[3]]
            taken = taken + [c[:2] for c in cs if c[2][0] and not c[3] and yes(c) and free(c, taken)]
            taken = taken + [c[:2] for c in cs if not c[2][0] and yes(c) and free(c, taken)]
            said += [f"{k}:{a}:{b}" for a, b in sorted(taken)]
        out[key] = ",".join(said)
    return out


def check(docs):
    got, rows = {}, pairs(docs)
    for r in pii.report(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    every = brute_spans(rows)
    for d, t in rows:
        want = base(t)
        for r in got[d]:
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in want) for k in pii.KINDS], t[:200]
            assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert set(want) <= set(r["spans"].split(","))
            assert r["spans"] == every[d, t or ""], (t or "")[:300]
            assert r["n_spans"] == len([x for x in r["spans"].split(",") if x])


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 30)))) for i in range(800)]
    rows += [(1000, "1 " * 20_000), (1001, "a" * 100_000 + "@"), (1002, "+1" * 10_000), (1003, "1.2.3.4 " * 1500)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs)
    assert pii.report(docs).count() == docs.count()


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert pii.report(odd_docs).count() == odd_docs.count() and pii.report(no_docs).count() == 0


def test_added_spans(spark):
    rows = [(i, f"please call +1 (555) 010-{7000 + i} or mail joe{i}@example.com today") for i in range(40)] + [(100, "call (555) 010-7788 now"), (101, "mail joe (at) example (dot) com"), (102, "no. 1234567812345678 is not a card")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:5:19" and got[101] == "email:5:31" and got[102] == ""


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    flip = np.array([0.05, 0.1, 0.2, 0.45])
    votes = (truth[:, None] ^ (rng.random((4000, 4)) < flip)).astype(float)
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    q = pii.reliabilities(patterns, n.astype(float))
    assert ((q[at] > 0.5) == truth).mean() > 0.95
    w = pii.classifier(patterns, n.astype(float), q)
    assert w[0] > w[2] > w[3]


def test_sums_before(spark):
    got = spark.range(1).select(*[pii.sums_before(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("bigint"))).alias(f"n{n}") for n in (1, 511, 512, 513, 2000)], pii.sums_before(F.array().cast("array<bigint>")).alias("n0")).first()
    for n in (0, 1, 511, 512, 513, 2000):
        assert got[f"n{n}"] == [i * (i + 1) // 2 for i in range(n + 1)]


def test_very_many_matches(spark):
    text = "10.0.0.1; 4111 1111 1111 1111, " * 40_000
    got = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got["n_ip"], got["n_card"]) == (40_000, 40_000) and got["spans"].startswith("ip:0:8,ip:31:39,")


def test_masked(spark, odd_docs):
    df = spark.createDataFrame([(1, "é joe@x.org and 10.0.0.1!", 7), (2, None, 8)], "doc_id long, text string, other int")
    got = {r["doc_id"]: (r["text"], r["other"]) for r in pii.masked(df).collect()}
    assert got == {1: ("é ********* and ********!", 7), 2: (None, 8)}
    assert pii.masked(odd_docs).columns == odd_docs.columns


def test_ipv6_and_a_failed_check_can_be_accepted(spark):
    rows = [(i, f"server address 2001:db8:0:0:0:0:{i:x}:1 is up") for i in range(40)] + [(50 + i, f"login from 10.0.{i}.7 now") for i in range(40)]
    rows += [(200 + i, f"credit card {c} ok") for i, c in enumerate(["4111 1111 1111 1111", "5500 0000 0000 0004"] * 30)] + [(300, "credit card 4111 1111 1111 1112 ok"), (301, "x8111111111111113y")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].startswith("ip:15:") for i in range(40)) and got[50] == "ip:11:19"
    assert got[200] == "card:12:31" and got[300] == "card:12:31" and got[301] == ""


def test_labelers_differ(spark, sf):
    """No two labelers vote alike on every candidate of a kind that has both votes of each."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(10**6 + i, "".join(random.Random(i).choices(BITS, k=25))) for i in range(300)], "doc_id long, text string")
    seen = pii.counted(docs.select("doc_id", "text").union(more).where("text is not null").select(*pii.searched(F.col("text"))))
    for kind, rows in seen.items():
        v = np.array([p for p, _ in rows])
        mixed = [j for j in range(v.shape[1]) if 0 < v[:, j].mean() < 1]
        assert all((v[:, a] != v[:, b]).any() for a in mixed for b in mixed if a < b), kind


def test_masked_keeps_clashing_columns(spark):
    rows = [(1, "mail joe@x.org", 1, 2), (1, "other text", 3, 4), (None, "joe@x.org", 5, 6), (1, None, 7, 8)]
    got = pii.masked(spark.createDataFrame(rows, "doc_id long, text string, _spans int, _span_id int"))
    assert got.columns == ["doc_id", "text", "_spans", "_span_id"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "mail *********", 1, 2), (1, "other text", 3, 4), (None, "*********", 5, 6), (1, None, 7, 8)]))
