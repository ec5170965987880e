"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the spans of the four base patterns (whether or not they pass the contract's check, which makes a base span)
and of a looser pattern for each kind. Labelers vote on every candidate, each from evidence of its own: the pattern (`shape`:
the base one, not the loose one), the digits or labels inside (`check`), a gazetteer, the words before it (`cue`), and
whether it stands free (`border`). The votes' patterns are counted over all documents; expectation-maximisation estimates
each labeler's reliability from these counts; its posteriors train a logistic span classifier over the votes, which is
compiled into a column expression. Candidates of either pattern that it accepts, and that don't overlap a base span of
their kind, are added (loose ones only where no other added one is); base spans always stay.

Patterns match in linear time: every quantifier that can be is possessive, and a match may begin only where a run
begins or the last match ended. Texts without a kind's marker are not searched. Offsets are code points.

Defined results: null and empty texts have no spans; repeated rows have equal results; with no candidates the classifier
accepts nothing; other columns are ignored by `spans` and kept, whatever their names, by `masked`, which judges each row by
its own text; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import id_text
from tidemill.session import cut

KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns, with possessive quantifiers and run borders that leave the matches as they are.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a run of digits is one match, and one of fewer than 13 fails anyway
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
MARKS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
LOOSE_MARKS = {"email": r"(?i)[(\[]at[)\]]", "ip": ":[0-9A-Fa-f]{1,4}:", "card": "[0-9]{4}[./_][0-9]{4}", "phone": "[0-9]{3}[ .-][0-9]{4}"}
#: Gazetteers (top-level domains; first digits of issuers; reserved networks; calling codes) and cue words.
GAZETTEER = {
    "email": r"(?i)[. )\]](?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$",
    "ip": r"(?i)^(?:(?!0+\.|255\.)[0-9]+\.|[23][0-9a-f]{3}:|f[cd][0-9a-f]{2}:|fe80:)",
    "card": r"^(?:3[47]|30|36|38|4|5[1-5]|2[2-7]|6)",
    "phone": r"^(?:\+|00)(?:1|2[07]|3[0-69]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|^\(?[2-9]",
}
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|mailto|address)\W{0,12}(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip\b|address|server|host|addr|from|login)\W{0,12}(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|master ?card|amex|credit|payment|pay)\W{0,12}(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|dial)\W{0,12}(?:\w+\W+){0,2}$",
}
LABELERS = ("shape", "check", "gazetteer", "cue", "border")
CONTEXT = 40
#: The probability from which on a candidate is added: a span that no rule vouches for needs more than a likely guess.
ACCEPT = 0.9


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern passes the contract's check of its kind."""
    d = digits(m)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(d).between(13, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def sound(kind: str, m: Column, loose: bool) -> Column:
    """The labeler `check`: what the inside of a candidate says."""
    if kind == "email":
        return m.rlike(r"[A-Za-z0-9][^A-Za-z0-9@(\[]*+(?:@|[(\[]at).*[^A-Za-z0-9][A-Za-z]{2,}$")
    if kind == "ip":
        return ~m.rlike("^[0:]++$") if loose else valid(kind, m) & ~m.rlike(r"(?:^|\.)0[0-9]")
    if kind == "phone":
        d = digits(m)
        return F.length(d).between(10, 15) & ~d.rlike("^1?[01][0-9]{9}$") if loose else valid(kind, m)
    return valid(kind, m)


def found(text: Column, kind: str, pattern: str, mark: str, loose: bool) -> Column:
    """The candidates of a pattern: array of (start, end, base, and the labelers' votes).

    The text between matches comes from splitting by the pattern, so a match starts after all the lengths before it.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def candidates(x: Column) -> Column:
        ms, gs, ends = x["ms"], x["gs"], x["ends"]

        def span(m: Column, i: Column) -> Column:
            end = F.get(ends, i + 1)
            before, after = F.right(F.get(gs, i), F.lit(CONTEXT)), F.get(gs, i + 1)
            return F.struct(
                (end - F.length(m)).alias("start"),
                end.alias("end"),
                (F.lit(False) if loose else valid(kind, m)).alias("base"),
                F.lit(not loose).alias("shape"),
                sound(kind, m, loose).alias("check"),
                m.rlike(GAZETTEER[kind]).alias("gazetteer"),
                before.rlike(CUES[kind]).alias("cue"),
                (~before.rlike(r"[\p{L}0-9]$") & ~after.rlike(r"^[\p{L}0-9]")).alias("border"),
            )

        return F.transform(ms, span)

    def ends_of(x: Column) -> Column:
        steps = F.transform(x["ms"], lambda m, i: (F.length(m) + F.length(F.get(x["gs"], i))).cast("bigint"))
        return F.element_at(F.transform(F.array(steps), sums_before), 1)

    # one-element arrays bind what is used for every match, so that it is computed once
    once = F.transform(F.array(F.struct(matches.alias("ms"), gaps.alias("gs"))), lambda x: F.struct(x["ms"].alias("ms"), x["gs"].alias("gs"), ends_of(x).alias("ends")))
    return F.when(text.rlike(mark), F.flatten(F.transform(once, candidates)).cast(none_type())).otherwise(F.array().cast(none_type()))


#: Appending to an array copies it, so prefix sums go by runs of this many numbers.
RUN = 512


def sums_before(steps: Column) -> Column:
    """The sums of the first 0, 1, 2, ... numbers of an array."""
    zero = F.lit(0).cast("bigint")

    def prefix(xs: Column, first: Column) -> Column:
        return F.aggregate(xs, F.array(first), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def total(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda a, n: a + n)

    def joined(x: Column) -> Column:
        offsets = F.transform(F.array(prefix(F.transform(x["runs"], total), zero)), lambda o: F.struct(o.alias("o"), x["runs"].alias("runs")))
        return F.flatten(F.transform(offsets, lambda y: F.flatten(F.transform(y["runs"], lambda r, i: F.slice(prefix(r, F.get(y["o"], i)), 2, RUN)))))

    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)), F.lit(RUN)), lambda i: F.slice(steps, i + 1, RUN))
    after = F.transform(F.array(F.struct(runs.alias("runs"))), joined)
    return F.concat(F.array(zero), F.flatten(after))


def none_type() -> str:
    return "array<struct<start:bigint,end:bigint,base:boolean," + ",".join(f"{x}:boolean" for x in LABELERS) + ">>"


def searched(text: Column) -> list[Column]:
    """For each kind, its base-pattern and its loose candidates, named <kind>_strict and <kind>_loose."""
    one = [found(text, k, BASE[k], MARKS[k], False).alias(f"{k}_strict") for k in KINDS]
    return one + [found(text, k, LOOSE[k], LOOSE_MARKS[k], True).alias(f"{k}_loose") for k in KINDS]


def counted(found_: DataFrame) -> dict[str, list[tuple[tuple[int, ...], int]]]:
    """For each kind, how many candidates have each pattern of votes: at most 2 ** labelers rows."""
    def votes_of(kind: str) -> Column:
        return F.transform(F.concat(f"{kind}_strict", f"{kind}_loose"), lambda x: F.struct(F.lit(kind).alias("kind"), *[x[v].alias(v) for v in LABELERS]))

    one = F.array(*map(votes_of, KINDS))
    rows = found_.select(F.explode(F.flatten(one)).alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()
    out: dict[str, list] = {k: [] for k in KINDS}
    for r in sorted(rows, key=str):
        out[r["x"]["kind"]].append((tuple(int(bool(r["x"][v])) for v in LABELERS), r["n"]))
    return out


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posteriors of vote patterns by expectation-maximisation over labelers that err independently. What stands under all
    the evidence (every vote but the first, `shape`) is there, and what stands under none isn't: these two stay fixed, and
    one more of each is counted, so that the two classes never change places."""
    evidence = votes[:, 1:].sum(axis=1)
    fixed = np.where(evidence == votes.shape[1] - 1, 1.0, np.where(evidence == 0, 0.0, np.nan))
    q = np.where(np.isnan(fixed), np.clip(votes.mean(axis=1), 0.05, 0.95), fixed)
    for _ in range(rounds):
        prior = np.clip((n @ q + 1) / (n.sum() + 2), 0.01, 0.99)
        hit = ((n * q) @ votes + 2) / ((n * q).sum() + 3)  # smoothed towards voting for what is there
        false = ((n * (1 - q)) @ votes + 1) / ((n * (1 - q)).sum() + 3)
        up = np.log(prior) + votes @ np.log(hit) + (1 - votes) @ np.log(1 - hit)
        down = np.log(1 - prior) + votes @ np.log(false) + (1 - votes) @ np.log(1 - false)
        q = np.where(np.isnan(fixed), 1 / (1 + np.exp(np.clip(down - up, -50, 50))), fixed)
    return q


def classifier(votes: np.ndarray, n: np.ndarray, q: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights (the last one constant) of a ridge logistic regression on soft labels."""
    x = np.c_[votes, np.ones(len(votes))]
    share = n / n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (share * (p - q)) + 1e-4 * w
        hess = (x.T * (share * p * (1 - p))) @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(found_: DataFrame) -> dict[str, np.ndarray]:
    """For each kind with candidates, the span classifier's weights over the votes."""
    out = {}
    for kind, rows in counted(found_).items():
        if rows:
            votes, n = np.array([v for v, _ in rows], float), np.array([c for _, c in rows], float)
            out[kind] = classifier(votes, n, reliabilities(votes, n))
    return out


def accepted(weights: np.ndarray | None, x: Column) -> Column:
    """Whether the classifier gives a candidate a probability of over `ACCEPT`."""
    if weights is None:
        return F.lit(False)
    return functools.reduce(lambda a, b: a + b, [F.when(x[v], F.lit(float(w))).otherwise(F.lit(0.0)) for v, w in zip(LABELERS, weights, strict=False)], F.lit(float(weights[-1]))) > float(np.log(ACCEPT / (1 - ACCEPT)))


def overlaps(x: Column, others: Column) -> Column:
    return F.exists(others, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))


def base_of(kind: str) -> Column:
    """The base spans (start, end) among <kind>_strict."""
    return F.transform(F.filter(f"{kind}_strict", lambda x: x["base"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def all_of(kind: str, weights: np.ndarray | None) -> Column:
    """The base spans and those that the classifier adds, in order, over <kind>_strict and <kind>_loose."""
    pair = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    base = base_of(kind)
    more = F.filter(f"{kind}_strict", lambda x: ~x["base"] & accepted(weights, x))  # a pattern's matches don't overlap
    taken = F.concat(base, F.transform(more, pair))
    loose = F.filter(f"{kind}_loose", lambda x: accepted(weights, x) & ~overlaps(x, taken))
    return F.array_sort(F.concat(taken, F.transform(loose, pair)))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base_<kind> and all_<kind> (arrays of start, end in order) for each kind. Trains on `docs`."""
    got = cut(id_text(docs).select("doc_id", *searched(F.col("text"))))
    models = train(got)
    return got.select("doc_id", *[base_of(k).alias(f"base_{k}") for k in KINDS], *[all_of(k, models.get(k)).alias(f"all_{k}") for k in KINDS])


def listed(prefix: str) -> Column:
    """kind:start:end of every span, by kind as listed, then start, joined by commas."""

    def one(kind: str) -> Column:
        return F.transform(f"{prefix}_{kind}", lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    return F.array_join(F.concat(*map(one, KINDS)), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> (base spans), base_sha256, spans (all), n_spans (all)."""
    return spans(docs).select(
        "doc_id",
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("all").alias("spans"),
        sum((F.size(f"all_{k}") for k in KINDS), F.lit(0)).cast("long").alias("n_spans"),
    )


def masked(docs: DataFrame, mask: str = "*") -> DataFrame:
    """The documents, with all their columns, with the code points of every span replaced. Trains on `docs`, then
    searches each row's own text."""
    models = train(id_text(docs).select(*searched(F.col("text"))))
    names = [f"_own_{i}" for i in range(len(docs.columns))]  # names of our own, whatever the documents' are
    place = docs.columns.index("text")
    mine = docs.toDF(*names)
    own = F.coalesce(F.col(names[place]), F.lit(""))
    every = F.reverse(F.array_sort(F.concat(*[all_of(k, models.get(k)) for k in KINDS])))
    # from the last span to the first, so that places stay
    text = F.aggregate("_spans", F.col(names[place]), lambda t, s: F.overlay(t, F.repeat(F.lit(mask), (s["end"] - s["start"]).cast("int")), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    got = mine.select(*names, *searched(own)).select(*names, every.alias("_spans"))
    cols = [F.when(F.size("_spans") > 0, text).otherwise(F.col(x)) if i == place else F.col(x) for i, x in enumerate(names)]
    return got.select(*[c.alias(f"_out_{i}") for i, c in enumerate(cols)]).toDF(*docs.columns)
