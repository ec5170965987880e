"""Line dedup: lines that stand in several documents stay in one of them.

Every document's distinct line keys are exploded as 128-bit hashes and aggregated by hash (with map-side partial
aggregation, so a line in a third of all documents is one row a task): the least doc_id and whether the documents
are at least `min_docs`. Only hashes over the threshold go back to the (document, hash) pairs, those of very frequent
lines by broadcast (there are ten thousand at most); the documents that lose lines are then reassembled in line order.

Defined results: a null or empty text is one empty line, which is too short to be a key; rows with one doc_id are one
document; a row without an id counts as no document and keeps all its lines; repeated lines in the keeping document stay;
empty tables give no rows; other columns, whatever their names, ride along in `dedup`.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import chunks, id_text, join_skewed, map_chunks
from tidemill.session import cut, ship

#: What is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
MIN_LENGTH = 10


def line_key(line: str, min_length: int = MIN_LENGTH) -> bytes | None:
    """The 128-bit hash of a line's key; None if the key is shorter than `min_length` code points."""
    s = line.strip(BLANK)
    return hashlib.blake2b(s.encode().lower(), digest_size=16).digest() if len(s) >= min_length else None


def line_keys(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, key: every document's distinct line keys."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        at, keys = [], []
        for i, text in enumerate(part.column("text").to_pylist()):
            mine = {line_key(x, min_length) for x in text.split("\n")} - {None}
            at += [i] * len(mine)
            keys += mine
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return map_chunks(docs, kernel, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary")


def drops(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = 2) -> DataFrame:
    """doc_id, drop array<binary>: the keys whose lines go, for the documents that have any. `docs`: doc_id, text."""
    keys = cut(line_keys(docs, min_length))
    common = keys.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("_last"), F.count("*").alias("n"))
    if min_docs == 2:
        common = common.where("keeper < _last")
    elif min_docs > 2:  # a row's keys are distinct already, but rows may share a doc_id
        enough = keys.distinct().groupBy("key").agg(F.count("*").alias("_d")).where(F.col("_d") >= min_docs).select("key")
        common = common.join(enough, "key", "left_semi")
    common = cut(common.drop("_last"))
    gone = join_skewed(keys, common, ["key"], "n").where("doc_id != keeper")
    return gone.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def _lines(part: pa.RecordBatch, min_length: int):
    for text, drop in zip(part.column("text").to_pylist(), part.column("drop").to_pylist(), strict=True):
        lines = text.split("\n")
        gone = set(drop or ())
        yield lines, [x for x in lines if line_key(x, min_length) not in gone] if gone else lines


def report(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    docs = id_text(docs)

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        both = list(_lines(part, min_length))
        sha = [hashlib.sha256("\n".join(kept).encode()).hexdigest() for _, kept in both]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(a) for a, _ in both], pa.int64()), pa.array([len(a) - len(b) for a, b in both], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = docs.join(drops(docs, min_length, min_docs), "doc_id", "left").select("doc_id", "text", "drop")
    return map_chunks(joined, kernel, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")


def dedup(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = 2) -> DataFrame:
    """The documents, with all their columns, without the lines that go; n_chars, if there, follows the text.
    Rows that lose nothing are passed on as they are (a null text stays null)."""
    ship(docs.sparkSession)
    names, last = docs.columns, len(docs.columns)
    place = names.index("text")
    own = [f"_own_{i}" for i in range(last)]  # names of our own, whatever the documents' are
    gone = drops(id_text(docs), min_length, min_docs).select(F.col("doc_id").alias("_id"), F.col("drop").alias("_drop"))
    joined = docs.toDF(*own).join(gone, F.col(own[names.index("doc_id")]) == F.col("_id"), "left").select(*own, "_drop")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, own[place]):
                view = pa.RecordBatch.from_arrays([part.column(place).fill_null(""), part.column(last)], ["text", "drop"])
                texts = [old if drop is None else "\n".join(kept) for old, drop, (_, kept) in zip(part.column(place).to_pylist(), view.column("drop").to_pylist(), _lines(view, min_length), strict=True)]
                cols = [part.column(i) for i in range(last)]
                cols[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
