"""The filter's counters against the reference's filter written down plainly, and past the size at which it is oversaturated."""

import random
from math import ceil, exp, floor, log

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemill.config import Dedupe
from tidemill.operators import dedupe

#: With 100,000 expected keys at 0.01, the first number of insertions whose estimated rate is above 0.02.
FIRST_OVER = 116_159


def plain(rows, window, expected, rate):
    """`rows` (key, now) through the filter: the map is scanned at every check; insertions count since the last rebuild, those of a key's return too."""
    size = ceil(-expected * log(rate) / log(2) ** 2)
    hashes = max(1, floor(size / expected * log(2) + 0.5))

    def places(key):
        a, b = 2166136261, 5381
        for c in map(ord, key):
            a, b = (a ^ c) * 16777619 % 2**32, (b * 33 + c) % 2**32
        return {(a + i * (b | 1)) % 2**32 % size for i in range(hashes)}

    seen, bits, added, evicted, skips, wrong, duplicates = {}, set(), 0, 0, 0, 0, 0
    for key, now in rows:
        live = {k: at for k, at in seen.items() if at > now - window}
        evicted += len(seen) - len(live)
        if len(live) < len(seen) / 2:
            bits, added = {x for k in live for x in places(k)}, len(live)
        seen, at = live, places(key)
        if at <= bits and key in seen:
            duplicates += 1
            continue
        skips, wrong = skips + (not at <= bits), wrong + (at <= bits)
        seen[key], bits, added = now, bits | at, added + 1
    over = (1 - exp(-hashes * added / size)) ** hashes > 2 * rate
    return {
        "queue": "all", "checked": len(rows), "duplicates": duplicates, "duplicate_rate": duplicates / len(rows), "tracked_keys": len(seen), "evicted": evicted, "configured_rate": rate,
        "skip_rate": skips / len(rows), "false_positives": wrong, "observed_rate": wrong / (skips + wrong), "bloom_bytes": ceil(size / 8), "oversaturated": over,
    }


@pytest.mark.parametrize("back", [False, True])
@pytest.mark.parametrize("expected", [5, 10_000])
def test_counters_are_the_plain_filters(spark, back, expected):
    rnd, now, rows = random.Random(7), 0, []
    for _ in range(400):
        now += rnd.randint(-30 if back else 0, 30)
        rows.append((f"k{rnd.randrange(40)}", now))
    log_ = spark.createDataFrame([(i, t, f"m{i}", k) for i, (k, t) in enumerate(rows)], "seq long, now_ms long, id string, dedupe_key string").repartition(3)
    got = dedupe.diagnostics(log_, Dedupe(100, expected_keys=expected, false_positive_rate=0.01)).first().asDict()
    assert got == plain(rows, 100, expected, 0.01)
    assert got["oversaturated"] == (expected == 5)


@pytest.mark.parametrize("n", [FIRST_OVER - 1, FIRST_OVER])
def test_query_tells_of_an_oversaturated_filter(spark, tmp_path, n):
    """A message a second, each with a key of its own: nothing is rebuilt, so every message is an insertion. All but the last column is what SQL says."""
    i = F.col("id")
    ts = F.timestamp_seconds(i + 1_704_067_200).cast("timestamp_ntz").alias("ts")
    events = spark.range(n).select(i.alias("event_id"), ts, i.alias("user_id"), F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["dedupe_bloom_diagnostics"](spark, str(tmp_path)).first()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    said = con.execute(entry.oracle_sql()["dedupe_bloom_diagnostics"])
    assert got[:-1] == said.fetchone()[:-1] and got["tracked_keys"] == 3600
    assert got["oversaturated"] == (n >= FIRST_OVER)
