"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a bounded sample of labelled rows; every path from a root is a conjunctive rule; a
lasso logistic regression (FISTA) keeps few rules; and the kept rules are compiled into one Spark column expression over
the statistics, which are Spark expressions themselves. Scoring runs no Python.

The sample: at most `SAMPLE` labelled rows, those with the least hash of their id; whole texts. Defined results: null
and empty texts have the statistics of an empty text and get a score; without labelled rows every score is 0.5, with
labels of one kind only it is that kind's smoothed share; repeated rows score alike; ids with several labels count once for
each; other columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
TREES = 24
DEPTH = 3
LAMBDA = 2e-3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, by name."""
    n = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"[ \t\n\r]+"), lambda x: x != "")
    lines = F.split(text, "\n")
    share = lambda pattern: 1 - F.length(F.regexp_replace(text, pattern, "")) / n
    n_words = F.greatest(F.size(words), F.lit(1))
    return {
        "chars": F.log1p(F.length(text).cast("double")),
        "word_length": F.length(text) / n_words,
        "upper": share(r"\p{Lu}+"),
        "digit": share("[0-9]+"),
        "stop": share("[.,;:?]+"),
        "symbol": share(r"[!|#$%&*@=<>~^\\/{}\[\]_+]+"),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_words": F.log1p(F.size(words) / F.size(lines)),
    }


def described(docs: DataFrame, *extra: Column) -> DataFrame:
    """doc_id, the extra columns, and a text's statistics."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), *extra, *[c.cast("double").alias(k) for k, c in statistics(text).items()])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold) with its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        return functools.reduce(lambda a, b: a & b, [F.col(k) > t if above else F.col(k) <= t for k, above, t in self.terms])

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([x[k] > t if above else x[k] <= t for k, above, t in self.terms])


@dataclass(frozen=True)
class Model:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1, over the columns of `statistics`."""
        z = functools.reduce(lambda a, b: a + b, [F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-z))


def grown(x: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], rows: np.ndarray, depth: int) -> list[tuple[tuple, float]]:
    """The leaves of a tree by second-order gain: (path, value). A path's terms are (feature, above, threshold)."""
    value = float(-g[rows].sum() / (h[rows].sum() + 1))
    best = (1e-6, None, None)
    if depth and len(rows) >= 40:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        base = total_g**2 / (total_h + 1)
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            bins = np.searchsorted(cuts, x[rows, f], "left")  # bin i: cuts[i-1] < x <= cuts[i]
            gs, hs, ns = (np.cumsum(np.bincount(bins, w, len(cuts) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - base
            gain[(ns < 15) | (ns > len(rows) - 15)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), f, float(cuts[i]))
    _, f, cut = best
    if f is None:
        return [((), value)]
    above = x[rows, f] > cut
    out = []
    for side, mine in ((False, rows[~above]), (True, rows[above])):
        out += [(((f, side, cut), *path), v) for path, v in grown(x, g, h, edges, mine, depth - 1)]
    return out


def fitted(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = LAMBDA) -> Model:
    """A model from statistics [row, name] and labels 0 or 1."""
    if not len(y):
        return Model()
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    if len(set(y.tolist())) == 1:
        return Model(base)
    rng = np.random.default_rng(3)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 63), method="lower")) for f in range(x.shape[1])]
    z = np.full(len(y), base)
    paths: dict[tuple, None] = {}
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        for path, value in grown(x, q - y, q * (1 - q), edges, rows, depth):
            for n in range(1, len(path) + 1):
                paths.setdefault(path[:n])
            holds = np.ones(len(y), bool)
            for f, above, cut in path:
                holds &= (x[:, f] > cut) == above
            z[holds] += 0.3 * value
    rules, columns, seen = [], [], set()
    for path in paths:
        rule = Rule(tuple((names[f], above, cut) for f, above, cut in path))
        holds = rule.holds(dict(zip(names, x.T, strict=True)))
        if 0.002 < holds.mean() < 0.998 and (key := holds.tobytes()) not in seen:
            seen.add(key)
            rules.append(rule)
            columns.append(holds)
    if not rules:
        return Model(base)
    a = np.array(columns, np.float64).T
    mean = a.mean(axis=0)
    a -= mean
    step = 4 / max(1e-9, float(np.linalg.eigvalsh(a.T @ a / len(y))[-1]))
    w = v = np.zeros(a.shape[1])
    b, t = base, 1.0
    for _ in range(400):
        r = 1 / (1 + np.exp(-(a @ v + b))) - y
        new = v - step * (a.T @ r / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= 4 * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    kept = [Rule(r.terms, round(float(x), 12)) for r, x in zip(rules, w, strict=True) if abs(x) > 1e-6]
    return Model(float(b - mean @ w), kept)


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows (doc_id, quality) for which `use`, an expression of doc_id, holds."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = (rows.where(use) if use is not None else rows).select("doc_id", "quality")
    chosen = rows.orderBy(F.xxhash64("doc_id", F.lit("quality sample")), "doc_id", "quality").limit(sample)
    chosen = chosen.select(F.col("doc_id").alias("_id"), "quality")
    # at most `sample` pairs of numbers are broadcast
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    names = list(statistics(F.lit("")))
    got = sorted(described(met, F.col("quality")).collect())
    return fitted(names, np.array([r[2:] for r in got], np.float64).reshape(-1, len(names)), np.array([r[1] for r in got], np.float64))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""
    score = model.score()
    return described(docs).select("doc_id", score.cast("double").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
