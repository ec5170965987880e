"""Benchmark decontamination by winnowing.

Words are the runs of digits, ASCII letters (lower-cased) and non-ASCII characters. A benchmark window is
`window` consecutive words of an item; an item of fewer, but not none, is one window. On both sides every k-gram
of words is hashed, and of each `window - k + 1` consecutive k-grams the least hash is kept as a fingerprint, so any
shared span of `window` words shares a fingerprint. Document fingerprints are joined with the benchmark's, each
hit is extended to the whole windows about it, and these are compared word by word. Shorter items use k = their
length, which keeps every k-gram. Nothing is dropped: equal windows of many items are one entry with many owners.

The index over the benchmark is broadcast when the benchmark has at most `BROADCAST_BYTES` of text. Beyond that the same is
done by joins, with the same result: fingerprints of both sides meet; both sides list their windows about the shared ones;
windows meet by their text, hot ones where they stand; and a document's hits are the union of its windows' places. Owners of
a window are a class, and item lists are made once for each set of classes that some document has, so no text
or list of items is copied to pairs. (A list itself is in one place, as its digest is.)

Defined results: null and empty texts have no words and aren't contaminated; items without words match nothing; rows and
items with null or shared ids are judged by their own texts, a null item_id being listed as None; repeated rows are judged
alike; other columns are ignored; empty tables give no rows, or no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_ROWS, GOLDEN, ROW, chunks, flat_utf8, id_text, join_skewed, keyed, lookup, map_chunks, mix64
from tidemill.session import cut, ship

WINDOW = 13
GRAM = 7
#: The words of a text before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most bytes of benchmark text whose index is broadcast; an index takes some 40 times its text.
BROADCAST_BYTES = 8 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
BASE = 0x100000001B3
_powers = {"f": np.ones(1, np.uint64), "b": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse mod 2**64, up to n."""
    if len(_powers["f"]) <= n:
        m = max(n + 1, CHUNK_POWERS)
        for k, b in (("f", BASE), ("b", pow(BASE, -1, 1 << 64))):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers["f"], _powers["b"]


CHUNK_POWERS = 1 << 20


class Words:
    """The words of a column of texts: hash, place in the flat bytes, and the row each word belongs to."""

    def __init__(self, column: pa.Array, lower: np.ndarray = LOWER, in_word: np.ndarray = IN_WORD):
        raw, self.at = flat_utf8(column)
        self.data = lower[raw]
        inside = in_word[self.data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cuts = self.at[1:-1][(self.at[1:-1] > 0) & (self.at[1:-1] < len(raw))]
        begin[cuts] = inside[cuts]
        end[cuts - 1] = inside[cuts - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        forward, back = powers(len(raw))
        total = np.r_[np.uint64(0), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * forward[: len(raw)])]
        self.hash = mix64((total[self.end] - total[self.start]) * back[self.start])
        self.row = np.searchsorted(self.at, self.start, "right") - 1
        self.first = np.searchsorted(self.start, self.at[:-1])
        self.count = np.diff(np.r_[self.first, len(self.start)])

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by a space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the k words from each word on, and whether they lie in one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * np.uint64(GOLDEN) + self.hash[i : i + n]
        return mix64(h), self.row[:n] == self.row[k - 1 :]

    def winnowed(self, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the k-grams that are least in some run of window - k + 1 of them, all ties kept."""
        h, whole = self.grams(k)
        span = window - k + 1
        n = len(h) - span + 1
        if span == 1:
            spot = np.flatnonzero(whole)
            return spot, h[spot]
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = h[:n].copy()
        for i in range(1, span):
            np.minimum(least, h[i : i + n], out=least)
        chosen = np.zeros(len(h), bool)
        same = self.row[:n] == self.row[window - 1 : window - 1 + n]
        for i in range(span):
            chosen[i : i + n] |= (h[i : i + n] == least) & same
        spot = np.flatnonzero(chosen)
        return spot, h[spot]


class Index:
    """The benchmark's fingerprints and distinct windows."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, min(gram, window)
        self.ids = [i for i, _ in items]
        w = Words(pa.array([t or "" for _, t in items], pa.string()))
        owners: dict[tuple[int, bytes], set[int]] = {}
        prints: dict[int, set[int]] = {}
        hashes: dict[int, dict[int, list[tuple[int, bytes]]]] = {}
        for length in sorted({min(int(n), window) for n in w.count if n}):
            k = length if length < window else self.gram
            mine = (w.count == length) if length < window else (w.count >= window)
            h, whole = w.grams(length)
            places = np.flatnonzero(whole & mine[w.row[: len(h)]])
            for p in places.tolist():
                text = w.text(p, p + length)
                key = (length, text)
                if key not in owners:
                    owners[key] = set()
                    hashes.setdefault(length, {}).setdefault(int(h[p]), []).append(key)
                owners[key].add(int(w.row[p]))
            spot, f = w.winnowed(k, length)
            prints[length] = set(f[mine[w.row[spot]]].tolist())
        self.owners = {key: sorted(v) for key, v in owners.items()}
        self.by_hash = {n: (np.array(sorted(d), np.uint64), d) for n, d in hashes.items()}
        self.prints = {n: np.array(sorted(s), np.uint64) for n, s in prints.items()}

    def grams_of(self, length: int) -> int:
        return length if length < self.window else self.gram

    def hits(self, w: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words of `w` are hit, and the items (by place) with windows in each row."""
        n = len(w.hash)
        cover = np.zeros(n + 1, np.int64)
        found: dict[int, set[int]] = {}
        for length, prints in self.prints.items():
            k = self.grams_of(length)
            spot, f = w.winnowed(k, length)
            spot = spot[isin_sorted(f, prints)]
            if not len(spot):
                continue
            # extend: every window about a hit, in the same row
            near = np.unique((spot[:, None] - np.arange(length - k + 1)).ravel())
            near = near[(near >= 0) & (near + length <= n)]
            h, whole = w.grams(length)
            known, entries = self.by_hash[length]
            near = near[whole[near] & isin_sorted(h[near], known)]
            for p, key in zip(near.tolist(), h[near].tolist(), strict=True):
                text = w.text(p, p + length)
                for entry in entries[key]:
                    if entry[1] == text:
                        cover[p] += 1
                        cover[p + length] -= 1
                        found.setdefault(int(w.row[p]), set()).add(entry)
        rows = {row: {i for entry in keys for i in self.owners[entry]} for row, keys in found.items()}
        return np.cumsum(cover[:n]) > 0, rows


def isin_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each of x is in a sorted table, which a bitmap of its low bits goes before."""
    if not len(table) or not len(x):
        return np.zeros(len(x), bool)
    bits = np.uint64((1 << max(12, min(24, len(table).bit_length() + 4))) - 1)
    low = np.zeros(int(bits) + 1, bool)
    low[(table & bits).astype(np.int64)] = True
    out = low[(x & bits).astype(np.int64)]
    spot = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(table, x[spot]), len(table) - 1)
    out[spot] = table[at] == x[spot]
    return out


def judge(part: pa.RecordBatch, index: Index) -> tuple[Words, np.ndarray, np.ndarray, list[list[str]]]:
    """The words, the mask of hit words, hits a row, and each row's items sorted as strings."""
    w = Words(part.column("text"))
    hit, rows = index.hits(w)
    total = np.r_[0, np.cumsum(hit)]
    n_hit = total[w.first + w.count] - total[w.first]
    return w, hit, n_hit, [sorted({str(index.ids[i]) for i in rows.get(r, ())}) for r in range(len(part))]


REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def report(docs: DataFrame, benchmark: DataFrame, share: int = 20, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a document is contaminated when words of it are hit
    and they are at least one in `share` of its words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = id_text(docs)
    items = id_text(benchmark, "item_id").withColumnRenamed("doc_id", "item_id").dropDuplicates()

    def rows(part: pa.RecordBatch, index: Index) -> pa.RecordBatch:
        w, _, n_hit, names = judge(part, index)
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        bad = (n_hit > 0) & (share * n_hit >= w.count)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(w.count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    index_of = shared_index(items, window, gram, broadcast_bytes)
    if index_of:
        return map_chunks(docs, lambda part: rows(part, index_of()), f"doc_id {kind}, {REPORT}")

    # the benchmark is large. Rows go by their own keys, as ids can be null or shared
    rows_of = cut(keyed(docs).select(*ROW, "doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words")))
    found = joined(keyed(docs), items, window, gram)
    table = rows_of.join(lookup(found, found.count() <= BROADCAST_ROWS), list(ROW), "left")
    n_hit, n_items = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n_hit", "n_items"))
    bad = (n_hit > 0) & (share * n_hit >= F.col("n_words"))
    return table.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), bad.alias("contaminated"))


def joined(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """kx, ky, n_hit, n_items, items_sha256 of the documents (kx, ky, text) that hold windows of items (item_id, text)."""
    items = keyed(items, "item_id").withColumn("item", F.coalesce(F.col("doc_id").cast("string"), F.lit("None")))
    lengths = [r[0] for r in map_chunks(items.select("text"), lambda p: _lengths(p, window), "length int").distinct().collect()]
    kinds = "kx long, ky long, length int, print long"
    mine = map_chunks(items.select(*ROW, "text"), lambda p: _prints(p, window, gram, None), kinds).dropDuplicates()
    theirs = map_chunks(docs.select(*ROW, "text"), lambda p: _prints(p, window, gram, lengths), kinds).dropDuplicates()
    on = ["length", "print"]
    both = mine.groupBy(*on).agg(F.count("*").alias("n_mine")).join(theirs.groupBy(*on).agg(F.count("*").alias("n_theirs")), on)
    shared = cut(both)
    windows = _about(items.select(*ROW, "item", "text"), mine, shared, "n_mine", window, gram, None)
    classes = windows.groupBy("length", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    classes = cut(classes.withColumn("class", F.sha2(F.concat_ws(",", "items").cast("binary"), 256)))
    places = cut(_about(docs.select(*ROW, F.lit("").alias("item"), "text"), theirs, shared, "n_theirs", window, gram, lengths).dropDuplicates())
    known = ["length", "words"]
    held = cut(places.groupBy(*known).agg(F.count("*").alias("n")).join(classes.select(*known, "class"), known))
    hits = join_skewed(places, held, known, "n")
    # what a window adds to the places that those before it cover
    before = Window.partitionBy(*ROW).orderBy("place", "length", "class").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("place") + F.col("length")
    adds = F.greatest(F.lit(0), end - F.greatest(F.col("place"), F.coalesce(F.max(end).over(before), F.lit(0))))
    each = hits.withColumn("adds", adds).groupBy(*ROW).agg(F.sum("adds").cast("long").alias("n_hit"), F.array_sort(F.collect_set("class")).alias("has"))
    each = cut(each.withColumn("combination", F.sha2(F.concat_ws(",", "has").cast("binary"), 256)))
    lists = each.select("combination", "has").dropDuplicates(["combination"]).select("combination", F.explode("has").alias("class"))
    lists = lists.join(classes.select("class", "items").dropDuplicates(["class"]), "class").select("combination", F.explode("items").alias("item"))
    named = lists.groupBy("combination").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = named.select("combination", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"))
    return cut(each.join(named, "combination").select(*ROW, "n_hit", "n_items", "items_sha256"))


def _about(rows: DataFrame, prints: DataFrame, shared: DataFrame, n: str, window: int, gram: int, lengths: list[int] | None) -> DataFrame:
    """kx, ky, item, place, length, words: the windows about shared fingerprints in the rows that have any."""
    on = ["length", "print"]
    met = join_skewed(prints, shared.select(*on, n), on, n).groupBy(*ROW).agg(F.collect_set(F.struct(*on)).alias("met"))
    rows_of = rows.groupBy(*ROW).agg(F.count("*").alias("n_rows"))
    whole = join_skewed(rows, cut(met.join(rows_of, list(ROW))), list(ROW), "n_rows")
    return map_chunks(whole.select(*ROW, "item", "text", "met"), lambda p: _windows(p, window, gram, lengths), "kx long, ky long, item string, place long, length int, words binary")


def _windows(part: pa.RecordBatch, window: int, gram: int, lengths: list[int] | None) -> pa.RecordBatch:
    """The windows about the fingerprints in `met`: of all lengths (documents), or of each row's own (items)."""
    w = Words(part.column("text"))
    own = np.minimum(w.count, window)
    met: dict[int, set[int]] = {}
    for x in part.column("met").flatten().to_pylist():
        met.setdefault(x["length"], set()).add(x["print"])
    rows, places, sizes, texts = [], [], [], []
    for n, prints in met.items():
        k = n if n < window else min(gram, window)
        spot, f = w.winnowed(k, n)
        spot = spot[isin_sorted(f, np.array(sorted(x & 0xFFFFFFFFFFFFFFFF for x in prints), np.uint64))]
        near = np.unique((spot[:, None] - np.arange(n - k + 1)).ravel())
        near = near[(near >= 0) & (near + n <= len(w.hash))]
        near = near[w.row[near] == w.row[near + n - 1]]
        if lengths is None:
            near = near[own[w.row[near]] == n]
        rows.append(w.row[near])
        places.append(near - w.first[w.row[near]])
        sizes.append(np.full(len(near), n, np.int32))
        texts += [w.text(p, p + n) for p in near.tolist()]
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    who = part.select(["kx", "ky", "item"]).take(pa.array(cat(rows, np.int64)))
    return pa.RecordBatch.from_arrays([*who.columns, pa.array(cat(places, np.int64), pa.int64()), pa.array(cat(sizes, np.int32), pa.int32()), pa.array(texts, pa.binary())], ["kx", "ky", "item", "place", "length", "words"])


def shared_index(items: DataFrame, window: int, gram: int, broadcast_bytes: int):
    """A function that gives a worker the benchmark's index, if the benchmark is small enough to be broadcast."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return None
    collected = sorted((tuple(r) for r in items.collect()), key=str)
    table = items.sparkSession.sparkContext.broadcast(collected)
    version = (hashlib.sha256(repr(collected).encode()).hexdigest(), window, gram)
    return lambda: built(table, version)


_built: dict[tuple, Index] = {}


def built(table, version: tuple) -> Index:
    """The worker's index of a broadcast benchmark, built once for a version of it."""
    if version not in _built:
        _built.clear()
        _built[version] = Index(table.value, *version[1:])
    return _built[version]


def _lengths(part: pa.RecordBatch, window: int) -> pa.RecordBatch:
    n = np.unique(np.minimum(Words(part.column("text")).count, window))
    return pa.RecordBatch.from_arrays([pa.array(n[n > 0], pa.int32())], ["length"])


def _prints(part: pa.RecordBatch, window: int, gram: int, lengths: list[int] | None) -> pa.RecordBatch:
    """Fingerprints of rows: of all lengths (documents), or of each row's own (items)."""
    w = Words(part.column("text"))
    rows, sizes, prints = [], [], []
    for n in lengths if lengths is not None else np.unique(np.minimum(w.count[w.count > 0], window)).tolist():
        spot, f = w.winnowed(n if n < window else min(gram, window), n)
        if lengths is None:
            own = np.minimum(w.count[w.row[spot]], window) == n
            spot, f = spot[own], f[own]
        rows.append(w.row[spot])
        sizes.append(np.full(len(f), n, np.int32))
        prints.append(f.view(np.int64))
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    who = part.select(["kx", "ky"]).take(pa.array(cat(rows, np.int64)))
    return pa.RecordBatch.from_arrays([*who.columns, pa.array(cat(sizes, np.int32)), pa.array(cat(prints, np.int64))], ["kx", "ky", "length", "print"])


def clean(docs: DataFrame, benchmark: DataFrame, share: int = 20, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that aren't contaminated, with all their columns; a row's own text decides. With a small benchmark
    each row is judged where it stands, else each distinct text once, and rows go by the digest of theirs."""
    items = id_text(benchmark, "item_id").withColumnRenamed("doc_id", "item_id").dropDuplicates()
    index_of = shared_index(items, window, gram, broadcast_bytes)
    if index_of:
        ship(docs.sparkSession)
        place = docs.columns.index("text")

        def run(batches):
            for batch in batches:
                texts = pa.RecordBatch.from_arrays([pa.array(range(len(batch)), pa.int64()), batch.column(place)], ["doc_id", "text"])
                for part in chunks(texts):
                    w, _, n_hit, _ = judge(part, index_of())
                    good = pa.array((n_hit == 0) | (share * n_hit < w.count))
                    yield batch.slice(part.column("doc_id")[0].as_py(), len(part)).filter(good)

        return docs.mapInArrow(run, docs.schema)
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    texts = docs.select(digest.alias("doc_id"), "text").dropDuplicates(["doc_id"])
    judged = report(texts, benchmark, share, window, gram, broadcast_bytes).where("contaminated").select(F.col("doc_id").alias("_bad_text"))
    return docs.join(judged, digest == judged["_bad_text"], "left_anti")
