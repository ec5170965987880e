"""Language ID by nearest centroid.

A text's vector holds the hashed counts of its character 1-, 2- and 3-grams (lower case, everything but letters as
one blank, words with digits left out), damped by a logarithm, weighted by inverse document frequency over all training documents, and normalised.
Each language has several centroids, clustered by spherical k-means from a bounded sample; a text takes the
language of the centroid with the highest cosine. It is rejected if it has no letter, or if that cosine is less
than a floor. From `LONG` distinct grams on, that is `LONG_FLOOR` of the least cosine that such texts of the language's own
sample reach; texts with fewer (short ones, or a few words repeated) have lower floors, down to `FLOOR` of the least of all
texts of the sample, as their cosines scatter.

The sample: about `SAMPLE` distinct texts a language, chosen by a hash of id and text, whole texts; each language's are clustered
in one task, and only its centroids and floors come to the driver. Document frequencies: all training texts. More than
`MOST_LANGS` different values of lang are an error, as such a column isn't one of languages. Defined results: null texts and texts without letters are `und` with score 0 and rejected; repeated rows
and ties go alike (the first centroid in the order of languages); without training rows all are `und`; other columns
are ignored by `predict` and kept by `keep`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import chunks, id_text, map_chunks
from tidemill.session import ship

DIMS = 4096
SAMPLE = 400
MOST_LANGS = 4096
#: Bytes of text and rows that a worker holds at once; a row's counts take 16 KB, whatever its length.
CHUNK_BYTES, CHUNK_ROWS = 256 << 10, 256
CENTROIDS = 4
#: A text is rejected under this share of the least cosine that its language's own sample reaches: the shortest texts
FLOOR = 0.25
#: under the first, those of at least `LONG` distinct grams under the second, of the least of such texts.
LONG_FLOOR, LONG = 0.65, 200

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts [text, hashed gram] as float32, and the number of letters of each text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    n_letters = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        c = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[c]
        n_letters[i] = is_letter.sum()
        if not n_letters[i]:
            continue
        is_letter = in_words(c, is_letter)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[0] = True  # one blank between words
        c = np.where(is_letter, c, 32)[keep].astype(np.uint64)
        two = c[:-1] << np.uint64(21) | c[1:]
        three = two[:-1] << np.uint64(21) | c[2:]
        for grams in (c[is_letter[keep]], two, three):
            out[i] += np.bincount((hashed(grams) & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS)
    return out, n_letters


def in_words(c: np.ndarray, is_letter: np.ndarray) -> np.ndarray:
    """The letters without those of runs of letters and digits that hold a digit (keys, numbers, codes), unless there
    are no others."""
    digit = (c >= 48) & (c <= 57)
    if not digit.any():
        return is_letter
    inside = is_letter | digit
    run = np.cumsum(inside & ~np.r_[False, inside[:-1]])
    coded = np.bincount(run, digit, int(run[-1]) + 1) > 0
    rest = is_letter & ~coded[run]
    return rest if rest.any() else is_letter


def hashed(grams: np.ndarray) -> np.ndarray:
    """A cheap mix of at most 63 bits into the low ones."""
    x = grams * np.uint64(0x9E3779B97F4A7C15)
    return x >> np.uint64(40)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def clustered(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means; the first is the one nearest to the mean, each next the farthest from those chosen."""
    mean = v.mean(axis=0)
    chosen = [int(np.argmax(v @ mean))]
    for _ in range(min(k, len(v)) - 1):
        chosen.append(int(np.argmin((v @ v[chosen].T).max(axis=1))))
    centres = v[chosen]
    for _ in range(rounds):
        near = np.argmax(v @ centres.T, axis=1)
        sums = np.stack([v[near == j].sum(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


class Model:
    """Inverse document frequencies, and each language's centroids and floors [language, short or long]."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, owner: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centres, self.owner, self.least = idf, langs, centres, owner, least

    def floors(self, lang: np.ndarray, n_grams: np.ndarray) -> np.ndarray:
        """The cosine under which a text of this many distinct grams is rejected."""
        short, long = self.least[lang].T
        return short + (long - short) * np.minimum(n_grams / LONG, 1) ** 3

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        counts, n_letters = gram_counts(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = vectors(counts, self.idf) @ self.centres.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        lang = self.owner[best]
        none = n_letters == 0
        score[none] = 0
        rejected = none | (score < self.floors(lang, (counts > 0).sum(axis=1)))
        return ["und" if x else self.langs[i] for i, x in zip(lang.tolist(), none.tolist(), strict=True)], score, rejected


def train(docs: DataFrame, use: Column | None = None, sample: int = SAMPLE, centroids: int = CENTROIDS, floor: float = FLOOR) -> Model:
    """A model from the rows of `docs` that have a lang, and for which `use` holds."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(use) if use is not None else rows
    rows = rows.select("doc_id", F.col("text"), "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values of lang")
    if not sizes:
        return Model(np.ones(DIMS), [], np.zeros((0, DIMS)), np.zeros(0, int), np.zeros((0, 2)))

    ship(docs.sparkSession)

    def frequencies(batches):
        n, df = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            for part in chunks(batch, limit=CHUNK_BYTES, rows=CHUNK_ROWS):
                counts, letters_of = gram_counts(part.column("text").to_pylist())
                n += int((letters_of > 0).sum())
                df += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([[n, *df.tolist()]], pa.list_(pa.int64()))], ["df"])

    # one row of counts a task, summed by place in the JVM
    parts = rows.select("text").mapInArrow(frequencies, "df array<long>")
    summed = parts.select(F.posexplode("df")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    total = np.zeros(DIMS + 1)
    for r in summed:
        total[r["pos"]] = r["n"]
    idf = np.log((1 + total[0]) / (1 + total[1:])) + 1

    at = F.xxhash64("doc_id", "text", F.lit("langid sample"))
    share = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(int(min(1.0, sample / n) * (1 << 30))))])
    taken = rows.withColumn("h", at).where(F.col("h").bitwiseAND(F.lit((1 << 30) - 1)) < share[F.col("lang")]).dropDuplicates(["lang", "h"]).select("lang", "h", "text")

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        counts, n = gram_counts(part.column("text").to_pylist())
        v = [x.tobytes() if k else None for x, k in zip(vectors(counts, idf).astype(np.float16), n.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(v, pa.binary()), pa.array((counts > 0).sum(axis=1) >= LONG)], ["lang", "h", "v", "long"])

    def cluster(table: pa.Table) -> pa.Table:
        lang, centres, least = fit(table, centroids, floor)
        flat = centres.astype(np.float32).ravel()
        return pa.table({"lang": pa.array([lang], pa.string()), "centres": pa.array([flat.tolist()], pa.list_(pa.float32())), "least": pa.array([list(least)], pa.list_(pa.float64()))})

    embedded = map_chunks(taken, kernel, "lang string, h long, v binary, long boolean", CHUNK_BYTES, CHUNK_ROWS).where("v is not null")
    found = sorted(embedded.groupBy("lang").applyInArrow(cluster, "lang string, centres array<float>, least array<double>").collect())
    langs, centres, owner, least = [], [np.zeros((0, DIMS), np.float32)], [], []
    for r in found:
        centres.append(np.array(r["centres"], np.float32).reshape(-1, DIMS))
        owner += [len(langs)] * len(centres[-1])
        langs.append(r["lang"])
        least.append(r["least"])
    return Model(idf.astype(np.float32), langs, np.concatenate(centres), np.array(owner, np.int64), np.array(least).reshape(-1, 2))


def fit(table: pa.Table, centroids: int = CENTROIDS, floor: float = FLOOR) -> tuple[str, np.ndarray, tuple[float, float]]:
    """One language's centroids and floors from its sample (lang, h, v, long), in the order of h."""
    table = table.sort_by("h")
    v = np.stack([np.frombuffer(x, np.float16).astype(np.float32) for x in table.column("v").to_pylist()])
    own = clustered(v, centroids)
    cosine, is_long = (v @ own.T).max(axis=1), np.array(table.column("long").to_pylist())
    short = floor * float(cosine.min())
    return table.column("lang")[0].as_py(), own, (short, max(short, LONG_FLOOR * float(cosine[is_long].min())) if is_long.any() else short)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    df = id_text(docs)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, rejected = shared.value.predict(part.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return map_chunks(df, kernel, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean", CHUNK_BYTES, CHUNK_ROWS)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that the model doesn't reject; a row's own text decides."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    column = docs.columns[place]

    def run(batches):
        for batch in batches:
            for part in chunks(batch, column, CHUNK_BYTES, CHUNK_ROWS):
                _, _, rejected = shared.value.predict([t or "" for t in part.column(place).to_pylist()])
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
