"""MinHash near-duplicate detection with tensored banding.

A document is the set of its distinct word shingles, each a 64-bit hash. Equal sets are one representative. A
representative gets two families of `m` small minhash tuples of `R` values each; a table key is one tuple of the
first family with one of the second, so m * m tables cost 2 * m tuples. A pair of similarity s meets in no table with a
probability of at most 2 * (1 - s**R)**m; m is chosen so that this is at most `MISS` at the threshold.

The m tables on the diagonal come first, in a quick round: each bucket's members meet its least one, pairs are
confirmed on the full sets, and confirmed links are merged into components. Then come all tables, with keys made only
from tuples that two components still share, and of these only the buckets that hold two components. If one of a key's
tuples is shared by up to `SMALL` representatives, all pairs of different components in its bucket are confirmed.
Representatives that have a key of two tuples that more share, which are mostly documents with a passage in
common, are joined exactly by prefix filtering: shingles are ordered by their frequency among
these documents, rarest first; linked documents have to share one in their first n - ceil(t * n) + 1, and the
place of the first that they share bounds their intersection. These rarer buckets are first met by one hub each, then
by all pairs that the bound leaves. So for every pair that meets in a table, the pair has been confirmed or ruled out,
or its two ends are connected already: no caps, and no expansion of a group of copies into all its pairs.

Buckets that hold a ten-thousandth of a table's rows or more are joined where their rows stand (`join_skewed`).

Defined results: documents without words (or text) have no shingles and are alone; a document of fewer words than
a shingle has one shingle, the whole sequence; rows with one doc_id are one document, linked where any of them is, so that
all its rows have one component; a row without an id is a document of its own, and a component of such rows only has a null
component_id; empty tables give no rows; other columns are ignored by `components` and kept by `keep`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_ROWS, GOLDEN, ROW, join_skewed, keyed, lookup, map_chunks, mix64
from tidemill.llm.decontam import LOWER, Words
from tidemill.session import cut, stored

R = 4
MISS = 2e-5
#: Members of a bucket up to which all its pairs of different components are confirmed.
SMALL = 16

NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, *range(9, 14)]] = False


def tuples_for(threshold: float, miss: float = MISS) -> int:
    """The tuples in each family so that a pair at the threshold is missed with a probability of at most `miss`."""
    return max(2, math.ceil(math.log(miss / 2) / math.log(1 - threshold**R)))


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingle hashes, sorted within each row, and each row's number of them."""
    w = Words(column, LOWER, NOT_BLANK)
    h, whole = w.grams(k)
    row = w.row[: len(h)][whole]
    h = h[whole]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, r in enumerate(short.tolist()):
            for x in w.hash[w.first[r] : w.first[r] + w.count[r]].tolist():
                extra[i] = (int(extra[i]) * GOLDEN + x) & 0xFFFFFFFFFFFFFFFF
        h, row = np.concatenate([h, mix64(extra + np.uint64(1))]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        first = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
        h, row = h[first], row[first]
    return h, np.bincount(row, minlength=len(w.count))


def sketches(h: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """[row, 2 * m] tuple hashes; rows without shingles get zeros."""
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), 2 * m), np.uint64)
    if not len(full):
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 1 << 31, 2 * m * R, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, 2 * m * R, dtype=np.uint32)
    half = (h >> np.uint64(32)).astype(np.uint32)
    x = np.empty_like(half)
    for t in range(2 * m):
        acc = np.full(len(full), t + 1, np.uint64)
        for i in range(t * R, t * R + R):
            np.multiply(np.bitwise_xor(half, shifts[i], out=x), factors[i], out=x)
            acc = acc * np.uint64(GOLDEN) + np.minimum.reduceat(x, starts)
        out[full, t] = mix64(acc)
    return out


def digests(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set."""
    at = np.r_[0, np.cumsum(sizes)]
    totals = (np.r_[np.uint64(0), np.cumsum(x)] for x in (h, mix64(h ^ np.uint64(GOLDEN))))
    first, second = ((t[at[1:]] - t[at[:-1]]).view(np.int64) for t in totals)
    return first, second


def set_table(docs: DataFrame, k: int, m: int) -> DataFrame:
    """kx, ky, doc_id, n_shingles, s1, s2 (a 128-bit digest of the set), tuples array<long>."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        h, sizes = shingle_sets(part.column("text"), k)
        s1, s2 = digests(h, sizes)
        flat = sketches(h, sizes, m).view(np.int64).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * m), pa.int32()), pa.array(flat))
        own = [part.column(c) for c in (*ROW, "doc_id")]
        return pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(s1), pa.array(s2), lists], [*ROW, "doc_id", "n_shingles", "s1", "s2", "tuples"])

    return map_chunks(docs, kernel, f"kx long, ky long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, s1 long, s2 long, tuples array<long>")


def parts_of(reps: DataFrame) -> DataFrame:
    """rep, n, comp, t, value: one row for each tuple."""
    return reps.select("rep", "n", "comp", F.posexplode("tuples").alias("t", "value"))


def mixed(table: DataFrame, label: str, *more) -> DataFrame:
    """The keys of `table` that have more than one `label`, with their numbers of rows; partial results are combined
    before the shuffle."""
    return table.groupBy("key").agg(F.min(label).alias("_a"), F.max(label).alias("_b"), F.count("*").alias("_n"), *more).where("_a != _b")


def in_mixed(table: DataFrame, label: str) -> DataFrame:
    """The rows of `table` whose key has more than one `label`."""
    return join_skewed(table, stored(mixed(table, label).select("key", "_n")), ["key"], "_n").drop("_n")


def diagonal(reps: DataFrame, m: int) -> DataFrame:
    """key, rep, n, comp: the m tables that pair the i-th tuples of both families, where two representatives meet, each a
    component of its own."""
    pairs = F.arrays_zip(F.slice("tuples", 1, m).alias("l"), F.slice("tuples", m + 1, m).alias("r"))
    keys = reps.select("rep", "n", F.posexplode(pairs).alias("t", "p")).select("rep", "n", F.xxhash64("t", "p.l", "p.r").alias("key"))
    return in_mixed(keys, "rep").withColumn("comp", F.col("rep"))


def tensored(reps: DataFrame, labels: DataFrame, m: int, small: bool) -> tuple[DataFrame, DataFrame]:
    """(key, rep, n, comp), (rep, comp): the buckets of all pairs of tuples where two components can meet, and the
    representatives of the large ones.

    Only a tuple that two components have can be in such a key. A key with a tuple that at most SMALL representatives have
    is a bucket of that size at most, and is made. All others pair two tuples that more have: of these no key is made, but
    every representative that has such a pair is listed, to be joined with all the others listed.
    """
    named = reps.join(lookup(labels, small), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    parts = parts_of(named)
    sizes = parts.groupBy("t", "value").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.count("*").alias("size")).where("_a != _b")
    shared = stored(sizes.select("t", "value", "size"))
    live = join_skewed(parts, shared, ["t", "value"], "size").groupBy("rep", "n", "comp").agg(F.collect_list(F.struct("t", "value", (F.col("size") <= SMALL).alias("few"))).alias("live"))
    left, right = F.filter("live", lambda x: x["t"] < m), F.filter("live", lambda x: x["t"] >= m)
    both = stored(live.where((F.size(left) > 0) & (F.size(right) > 0)).select("rep", "n", "comp", left.alias("left"), right.alias("right")))
    wanted = both.select("rep", "n", "comp", F.explode("left").alias("l"), "right").withColumn("right", F.filter("right", lambda x: F.col("l.few") | x["few"]))
    keys = wanted.select("rep", "n", "comp", "l", F.explode("right").alias("r"))
    keys = keys.select("rep", "n", "comp", F.xxhash64("l.t", "l.value", "r.t", "r.value").alias("key"))
    many = lambda c: F.exists(c, lambda x: ~x["few"])
    return stored(in_mixed(keys, "comp")), stored(both.where(many("left") & many("right")).select("rep", "comp"))


def few(table: DataFrame, small: bool) -> DataFrame:
    """A table that is known to be small in as many partitions as there are cores, so that a step over it is few tasks."""
    return table.coalesce(table.sparkSession.sparkContext.defaultParallelism) if small else table


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """rep, comp: `labels` after joining the components that `links` (a, b: representatives) connect.

    Minimum-label propagation over the graph of components with pointer jumping; only the components that links touch
    take part, and each step's table is written to the shared folder.
    """
    n = links.count()
    if not n:
        return labels
    small = 2 * n <= BROADCAST_ROWS
    # only the links' ends are looked up, so the labels are filtered by them and not the other way round
    ends = links.select(F.explode(F.array("a", "b")).alias("rep"))
    near = labels.join(lookup(ends.distinct(), small), "rep", "left_semi")
    la, lb = (near.select(F.col("rep").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    edges = links.join(lookup(la, small), "a").join(lookup(lb, small), "b").where("ca != cb").select(F.explode(F.array(F.struct(F.col("ca").alias("u"), F.col("cb").alias("v")), F.struct(F.col("cb").alias("u"), F.col("ca").alias("v")))).alias("e"))
    both = stored(few(edges.select("e.*").distinct(), small))
    nodes = stored(few(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("p")), small))
    while True:
        # the least label among a node's own and its neighbours', then that label's own label
        asked = both.join(lookup(nodes.select(F.col("u").alias("v"), F.col("p").alias("q")), small), "v").select("u", "q", F.lit(None).cast(nodes.schema["p"].dataType).alias("p"))
        every = asked.unionByName(nodes.select("u", F.col("p").alias("q"), "p"))
        step = stored(few(every.groupBy("u").agg(F.min("q").alias("n"), F.min("p").alias("p")), small))
        jump = step.select(F.col("u").alias("n"), F.col("n").alias("nn"))
        after = step.join(lookup(jump, small), "n", "left").select("u", F.least("n", F.coalesce("nn", "n")).alias("n"), "p")
        after = after if small else stored(after)
        moved = after.where("n != p").limit(1).count()
        nodes = after.select("u", F.col("n").alias("p"))
        if not moved:
            break
    roots = nodes.select(F.col("u").alias("comp"), "p")
    return labels.join(lookup(roots, small), "comp", "left").select("rep", F.coalesce("p", "comp").alias("comp"))


def full_sets(ids: DataFrame, small: bool, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """rep, set: the shingle sets of the classes in `ids` (rep, each once), as sorted 64-bit hashes. docs: kx, text."""
    wanted = classes.join(lookup(ids, small), "rep", "left_semi").select("rep", "kx", "s1", "s2")

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        h, sizes = shingle_sets(part.column("text"), k)
        s1, s2 = digests(h, sizes)
        raw = h.view(np.uint8).tobytes()
        at = (8 * np.r_[0, np.cumsum(sizes)]).tolist()
        return pa.RecordBatch.from_arrays([part.column("kx"), pa.array(s1), pa.array(s2), pa.array([raw[i:j] for i, j in zip(at, at[1:], strict=False)], pa.binary())], ["kx", "s1", "s2", "set"])

    sets = map_chunks(docs.select("kx", "text").join(lookup(wanted.select("kx"), small), "kx", "left_semi"), kernel, "kx long, s1 long, s2 long, set binary")
    # a row is chosen by its key and its set; of rows that agree in both, which are repeats, one stays. This leaves the
    # sets partitioned and sorted for all the joins by rep that follow
    return cut(sets.join(lookup(wanted, small), ["kx", "s1", "s2"]).groupBy("rep").agg(F.first("set").alias("set")).sortWithinPartitions("rep"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    kind = sets.schema["rep"].dataType.simpleString()
    joined = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b")

    def test(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                same = int((large[at] == small).sum())
                good.append(100 * same >= percent * (len(p) + len(q) - same))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.select("a", "b", "sa", "sb").mapInArrow(test, f"a {kind}, b {kind}")


class Linker:
    """Labels (rep, comp) of representatives, made coarser by confirming pairs; no pair is tested twice."""

    def __init__(self, labels: DataFrame, percent: int):
        self.percent, self.done = percent, None
        self.relabel(labels)

    def relabel(self, labels: DataFrame) -> None:
        self.small = labels.count() <= BROADCAST_ROWS
        self.labels = few(labels, self.small)

    def current(self, table: DataFrame) -> DataFrame:
        """`table` (key, rep, ...) with the components. A table that has them already is as fresh as the labels."""
        return table if "comp" in table.columns else stored(table.join(lookup(self.labels, self.small), "rep"))

    def confirm(self, met: DataFrame, sets: DataFrame) -> None:
        """Test pairs (rep, other, n, m) whose sizes allow a link."""
        allowed = met.where(100 * F.least("n", "m") >= self.percent * F.greatest("n", "m"))
        pairs = allowed.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
        if self.done is not None:
            pairs = pairs.join(self.done, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        self.labels = stored(few(merged(self.labels, stored(confirmed(pairs, sets, self.percent))), self.small))
        self.done = pairs if self.done is None else self.done.unionByName(pairs)

    def star(self, table: DataFrame, sets: DataFrame, first) -> None:
        """The members of every bucket with two components meet the member that is least by the column `first`."""
        left = self.current(table)
        least = F.min(F.struct(first.alias("_o"), F.col("rep").alias("other"), F.col("n").alias("m"), F.col("comp").alias("_c"), *self.places(left, "_j")))
        hubs = stored(mixed(left, "comp", least.alias("h")).select("key", "_n", "h.*"))
        self.confirm(self.within(join_skewed(left, hubs, ["key"], "_n").where("comp != _c")), sets)

    def every_pair(self, table: DataFrame, sets: DataFrame) -> None:
        """All pairs of different components in every bucket that has two."""
        left = self.current(table)
        left = left if left is table else stored(in_mixed(left, "comp"))
        right = left.select("key", F.col("rep").alias("other"), F.col("n").alias("m"), F.col("comp").alias("_c"), *self.places(left, "_j"))
        bound = self.bound if "i" in left.columns else F.lit(True)
        met = left.join(right, (left["key"] == right["key"]) & (F.col("rep") < F.col("other")) & (F.col("comp") != F.col("_c")) & bound)
        self.confirm(met.select("rep", "other", "n", "m"), sets)

    @staticmethod
    def places(left: DataFrame, to: str) -> list:
        return [F.col("i").alias(to)] if "i" in left.columns else []

    @property
    def bound(self):
        """What the places of the first shared shingle leave of the intersection has to be enough for a link."""
        return (100 + self.percent) * F.least(F.col("n") - F.col("i"), F.col("m") - F.col("_j")) >= self.percent * (F.col("n") + F.col("m"))

    def within(self, met: DataFrame) -> DataFrame:
        return met.where(self.bound) if "_j" in met.columns else met


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """key, rep, n, i: the shingles in each set's prefix that two sets have at least, with their place in the set, when
    every set is ordered by (frequency among these sets, hash)."""
    kind = sets.schema["rep"].dataType.simpleString()

    def explode(batches):
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                raw = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("set")]
                sizes = np.array([len(x) for x in raw], np.int64)
                rows = np.repeat(np.arange(len(raw)), sizes)
                yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(rows)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(raw))], ["rep", "n", "key"])

    rows = sets.mapInArrow(explode, f"rep {kind}, n long, key long")
    shared = stored(rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    met = join_skewed(rows, shared, ["key"], "df")
    order = Window.partitionBy("rep").orderBy("df", "key")
    # the n - count shingles that no other set has come first
    placed = met.withColumn("i", F.col("n") - F.count("*").over(Window.partitionBy("rep")) + F.row_number().over(order) - 1)
    return placed.where(100 * F.col("i") <= 100 * F.col("n") - F.ceil(F.col("n") * percent / 100) * 100).select("key", "rep", "n", "i")


def repeated(sets: DataFrame, classes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Labels after joining the classes that rows with one doc_id have, and (doc_id, comp) for the ids with several sets;
    None if there is no such id."""
    one = F.struct("s1", "s2", "n_shingles")
    ids = stored(sets.where("doc_id is not null").groupBy("doc_id").agg(F.min(one).alias("_a"), F.max(one).alias("_b")).where("_a != _b").select("doc_id"))
    n = ids.count()
    if not n:
        return None
    rows = sets.where("n_shingles > 0").join(lookup(ids, n <= BROADCAST_ROWS), "doc_id", "left_semi").select("doc_id", "s1", "s2", "n_shingles").distinct()
    has = stored(rows.join(classes.select("s1", "s2", "n_shingles", "rep"), ["s1", "s2", "n_shingles"]).select("doc_id", "rep"))
    fresh = has.select("rep").distinct().join(labels, "rep", "left_anti").select("rep", F.col("rep").alias("comp"))
    labels = stored(labels.unionByName(fresh))
    hubs = has.groupBy("doc_id").agg(F.min("rep").alias("a"))
    links = stored(has.join(hubs, "doc_id").where("a != rep").select("a", F.col("rep").alias("b")).distinct())
    labels = stored(merged(labels, links))
    return labels, stored(hubs.join(labels, hubs["a"] == labels["rep"]).select("doc_id", "comp"))


def labelled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """kx, ky, doc_id, n_shingles, comp (null for a document without shingles), component_id of every row."""
    docs = keyed(docs)
    m = tuples_for(percent / 100)
    sets = stored(set_table(docs, k, m))
    some = sets.where("n_shingles > 0")
    # rows with equal sets are a class, whose text is that of its row with the least key. Classes are numbered in the order
    # of their least doc_id, as a bucket's first hub is its least number and originals mostly come before their copies
    classes = some.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("least"), F.min("kx").alias("kx"), F.count("*").alias("n_rows"), F.first("tuples").alias("tuples"))
    classes = stored(classes.orderBy(F.asc_nulls_last("least"), "s1", "s2").withColumn("rep", F.monotonically_increasing_id()))
    reps = classes.select("rep", F.col("n_shingles").alias("n"), "tuples")
    first = stored(diagonal(reps, m))
    linker = Linker(stored(first.select("rep", F.col("rep").alias("comp")).distinct()), percent)
    linker.star(first, full_sets(linker.labels.select("rep"), linker.small, classes, docs, k), F.col("rep"))
    second, large = tensored(reps, linker.labels, m, linker.small)
    ids = second.select("rep", "comp").unionByName(large)
    ids = stored(ids.distinct())
    fresh = ids.join(lookup(linker.labels, linker.small), "rep", "left_anti")
    linker.relabel(stored(linker.labels.unionByName(fresh)))
    full = full_sets(ids.select("rep"), linker.small, classes, docs, k)
    linker.every_pair(second, full)
    if large.limit(1).count():
        rare = stored(prefixes(full.join(large, "rep", "left_semi"), percent))
        linker.star(rare, full, F.xxhash64("key", "rep"))
        linker.every_pair(rare, full)
    again = repeated(sets, classes, linker.labels)
    if again:
        linker.relabel(again[0])
    placed = classes.select("s1", "s2", "n_shingles", "n_rows", "least", "rep").join(lookup(linker.labels, linker.small), "rep", "left")
    placed = stored(placed.withColumn("comp", F.coalesce("comp", "rep")))
    # only the components that are labelled can have several classes
    least = linker.labels.join(placed.select("rep", "least"), "rep").groupBy("comp").agg(F.min("least").alias("lead"))
    named = placed.join(lookup(least, linker.small), "comp", "left").withColumn("component_id", F.coalesce("lead", "least"))
    named = stored(named.select("s1", "s2", "n_shingles", "n_rows", "comp", "component_id"))
    out = [*ROW, "doc_id", "n_shingles", "comp", "component_id"]
    member = join_skewed(some.drop("tuples"), named, ["s1", "s2", "n_shingles"], "n_rows").select(*out)
    alone = sets.where("n_shingles = 0").select(*ROW, "doc_id", "n_shingles")
    if again:
        of = named.groupBy("comp").agg(F.min("component_id").alias("component_id"))
        alone = alone.join(again[1].join(of, "comp"), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    else:
        alone = alone.withColumn("comp", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return member.unionByName(alone.select(*out))


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked by 100 * intersection >= percent * union of their
    sets of k-word shingles; component_id is the least doc_id that links reach, kept marks the document of that id."""
    rows = labelled(docs, k, percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: of the rows with its least doc_id (or without one, if none has an
    id) the one with the least key; of rows that agree in id and text any. Rows without words stay."""
    rows = stored(labelled(docs, k, percent).where("n_shingles > 0").groupBy("comp", F.col("doc_id").isNull().alias("_no"), "doc_id", *ROW).agg(F.count("*").alias("n")))
    order = F.struct("_no", "doc_id", *ROW)
    best = stored(rows.groupBy("comp").agg(F.min(order).alias("_best"), F.count("*").alias("_rows"), F.sum("n").alias("_all")).where("_all > 1"))
    met = stored(join_skewed(rows, best, ["comp"], "_rows").select(*[F.col(c).alias(f"_{c}") for c in ROW], (order == F.col("_best")).alias("_stays"), "n"))
    gone = met.where("not _stays").select("_kx", "_ky").distinct()
    twice = met.where("_stays and n > 1").select("_kx", "_ky")
    names = [f"_row_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)  # names of our own, whatever the documents' are
    of = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text")}
    hashes = [F.xxhash64(*x, of["doc_id"], F.coalesce(of["text"], F.lit(""))) for x in ((), (F.lit(1),))]
    keys = plain.select("*", hashes[0].alias("_kx"), hashes[1].alias("_ky"))
    left = keys.join(lookup(gone, met.count() <= BROADCAST_ROWS), ["_kx", "_ky"], "left_anti")
    if twice.limit(1).count():
        few_ = lookup(twice, twice.count() <= BROADCAST_ROWS)
        left = left.join(few_, ["_kx", "_ky"], "left_anti").unionByName(left.join(few_, ["_kx", "_ky"], "left_semi").dropDuplicates(["_kx", "_ky"]))
    return left.select(*names).toDF(*docs.columns)
