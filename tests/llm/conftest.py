import json
import re

import pytest

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(text):
    return (text or "").translate(LOW)


class Union:
    """Plain union-find by least member."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_components(rows, k, percent):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    u, ids = Union(sets), sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                u.join(a, b)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, long, repeated and tied rows, with extra columns whose names clash with internal ones."""
    long = " ".join(f"w{i % 997}" for i in range(20_000))
    base = "the quick brown fox jumps over the lazy dog while seven wise owls keep watch"
    texts = [None, "", "   ", "\n\n", "one", "ONE two", base, base.upper(), base + " again", base + "\n" + base, long, long + " tail", "é" * 50, "日本語 の 文章 です", "a\x00b   c", base, "mail me: joe.doe@example.com or +1 (555) 010-7788, 4111 1111 1111 1111 at 10.0.0.256 10.0.0.1"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), "x", i, None) for i, t in enumerate(texts)]
    rows.append(rows[6])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, rep long, shard int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def dumps(x):
    return json.dumps(x, sort_keys=True, default=str)


@pytest.fixture(scope="session")
def strange_docs(spark):
    """Rows without an id, one id with two texts, exact repeats, and columns named like those that operators make."""
    a, b, c = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "mail joe@x.org or 10.0.0.1 today please"
    lines = "first line of some length\nsecond line of some length"
    rows = [(None, a), (None, a), (None, b), (None, None), (5, a), (5, b), (5, b), (6, lines), (7, lines + "\nthird line of some length"), (None, lines), (8, None), (8, ""), (9, c), (9, c + " now"), (None, c), (10, "Released under the MIT License.")]
    names = ["_drop", "_drop_id", "_spans", "_span_id", "_kx", "_ky", "_id", "_bad_text", "key", "rep", "set", "ids", "kx", "h", "v", "met", "path"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    return spark.createDataFrame([(i, t, "en" if j % 3 else None, f"s{j % 2}" if j % 5 else None, len(t or ""), *range(len(names))) for j, (i, t) in enumerate(rows)], schema)
