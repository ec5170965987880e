"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Within each source rows are ranked in a seeded pseudo-random order (by the MD5 of seed and id); a row's position is its fractional rank, (rank +
1/2) / rows of the source; all rows are sorted by position, and the sequence is cut into runs of equal length. So each
shard holds nearly the same share of every source, and row counts differ by one at most (the law `rows`).

Neither order needs one task: ranks are counted within hash buckets of a source, of some `BUCKET_ROWS` rows (a source
with a third of all rows has as many buckets as it needs, up to `MOST_BUCKETS`, and is never dealt by source alone), plus the sizes of the buckets
before; likewise for positions. Texts are read once and not shuffled.

Defined results: a null text has size 8 and the checksum of an empty one; a null source is a source of its own; rows
that agree in everything are told apart arbitrarily but each has its own slot; an empty table gives no rows; with
fewer rows than shards some shards are empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import join_skewed
from tidemill.session import cut

BUCKET_ROWS = 1000
MOST_BUCKETS = 1 << 16
#: Most bytes of source names and counts that are broadcast.
BROADCAST_BYTES = 4 << 20


def running(sizes: DataFrame, by: list[str], order: str, n: str, to: str) -> DataFrame:
    """`to`: the rows in the buckets before. `sizes` has at most MOST_BUCKETS rows for each `by`."""
    window = Window.partitionBy(*by) if by else Window.partitionBy()
    before = F.sum(n).over(window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn(to, F.coalesce(before, F.lit(0)))


def assign(docs: DataFrame, n_shards: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = cut(rows.withColumn("h", seeded).withColumn("stratum", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))))
    counts = cut(rows.groupBy("stratum").agg(F.count("*").alias("n_s")))
    total, strata = counts.agg(F.coalesce(F.sum("n_s"), F.lit(0)), F.count("*")).first()
    buckets = lambda n: F.least(F.lit(MOST_BUCKETS), F.ceil(n / BUCKET_ROWS)).cast("long")
    # with very many sources the large ones, of which there are few, still take their count where their rows stand
    sized = rows.join(F.broadcast(counts), "stratum") if strata * 16 <= BROADCAST_BYTES else join_skewed(rows, counts, ["stratum"], "n_s")
    # the leading 32 bits of the hash, scaled: buckets are in the order of the hash
    lead = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    sized = sized.withColumn("bucket", F.shiftright(lead * buckets(F.col("n_s")), 32))
    before = running(sized.groupBy("stratum", "bucket").agg(F.count("*").alias("n_b")), ["stratum"], "bucket", "n_b", "before").drop("n_b")
    place = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "text_crc32", "size"))
    ranked = sized.withColumn("_at", place).join(before, ["stratum", "bucket"])
    n_f = max(1, min(MOST_BUCKETS, -(-total // BUCKET_ROWS)))
    twice = 2 * (F.col("before") + F.col("_at")) - 1  # 2 * rank + 1, ranks from 0
    ranked = ranked.withColumn("position", twice / (2 * F.col("n_s")))
    ranked = ranked.withColumn("part", F.least(F.lit(n_f - 1), F.floor(F.col("position") * n_f)))
    ranked = cut(ranked.select("doc_id", "source", "size", "text_crc32", "h", "position", "part"))
    earlier = running(ranked.groupBy("part").agg(F.count("*").alias("n_p")), [], "part", "n_p", "earlier").drop("n_p")
    at = F.row_number().over(Window.partitionBy("part").orderBy("position", "h", "doc_id", "text_crc32", "size"))
    # the g-th row of all (from 0) goes to shard g * n_shards div total, whose first row is ceil(shard * total / n_shards)
    out = ranked.withColumn("_at", at).join(F.broadcast(earlier), "part").withColumn("g", F.col("earlier") + F.col("_at") - 1)
    out = out.withColumn("shard", F.expr(f"cast(g * {n_shards}L div {max(1, total)}L as int)"))
    out = out.withColumn("slot", F.expr(f"g - (shard * {total}L + {n_shards - 1}L) div {n_shards}L"))
    return out.select("doc_id", "source", "size", "text_crc32", "shard", "slot")
