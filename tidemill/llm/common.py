"""What the corpus operators share: flat views of text columns and bounded chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import ship

#: Bytes of text that a numpy kernel holds at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

GOLDEN = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, with each row's start and the end. Null is empty."""
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `limit` bytes of text and `rows` rows, or one row."""
    _, at = flat_utf8(batch.column(column))
    i = 0
    while i < len(batch):
        j = min(i + rows, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def map_chunks(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> DataFrame:
    """`kernel` on every bounded chunk of `df`, which has a column text."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, limit=limit, rows=rows):
                yield kernel(part)

    return df.mapInArrow(run, schema)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, named doc_id and text; null texts are empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: What tells a row of documents from all others that aren't equal to it: two hashes of its id and text.
ROW = ("kx", "ky")


def keyed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """kx, ky, doc_id, text: a row's own key, as ids can be null or stand for several texts."""
    docs = id_text(docs, id_col)
    return docs.select(F.xxhash64("doc_id", "text").alias("kx"), F.xxhash64(F.lit(1), "doc_id", "text").alias("ky"), "doc_id", "text")


#: Most rows of a few numbers that are broadcast for a join; beyond it both sides are shuffled.
BROADCAST_ROWS = 1 << 20


def lookup(table: DataFrame, small: bool) -> DataFrame:
    """A table of ids for a join: broadcast, if it has been counted to have at most BROADCAST_ROWS rows."""
    return F.broadcast(table) if small else table


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of data[starts[i] : starts[i] + lengths[i]]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


#: A key is hot from this part of all rows on, so there are at most this many hot keys; fewer rows are no burden to a task.
HOT_KEYS = 10_000
HOT_ROWS = 1000


def join_skewed(rows: DataFrame, table: DataFrame, on: list[str], n: str) -> DataFrame:
    """rows INNER JOIN table, where `table` has each key once with the number `n` of its rows in `rows`.

    Hot keys, those with a ten-thousandth of the rows or more, are ten thousand at most, so their part of the table is
    broadcast and their rows stay where they are; no other key is large enough to make a partition uneven. Without hot keys
    it is a plain join.
    """
    total, most = table.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    if most < HOT_ROWS or most * HOT_KEYS < total:
        return rows.join(table, on)
    hot = (F.col(n) * HOT_KEYS >= total) & (F.col(n) >= HOT_ROWS)
    few = table.where(hot)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(table.where(~hot), on)
    return rows.join(F.broadcast(few), on).unionByName(rest)
