"""The registered queries of the message-flow engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.config import Dedupe, QueueConfig, Visibility
from tidemill.functions import hashing
from tidemill.operators import dedupe, journal, lanes, leases, retries, scheduling
from tidemill.session import read_table
from tidemill.sources import adapters
from tidemill.sources.adapters import EVENT_LANES, ORDER_LANES
from tidemill.sources.readers import lanes_frame

HOUR, DAY = 3_600_000, 86_400_000
LEASE = Visibility(7 * DAY, 2)
#: The moment at which snapshots of orders and of line items are taken.
ORDERS_NOW, ITEMS_NOW = 915_148_800_000, 904_608_000_000
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


EV = """
ev AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS now_ms, CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_key,
         CAST(user_id AS VARCHAR) || ':' || event_type AS type_key, props AS payload,
         CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'normal' WHEN 'click' THEN 'normal' ELSE 'low' END AS lane
       FROM events)"""
ODR = "odr AS (SELECT o_orderkey AS id, o_orderpriority AS lane, epoch_us(o_orderdate) // 1000 AS enqueued_at_ms FROM orders)"
LI = """
li AS (SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INTEGER) AS attempt,
         l_suppkey AS consumer_id, epoch_us(l_shipdate) // 1000 AS claimed_at_ms,
         CASE l_returnflag WHEN 'N' THEN 'ack' WHEN 'R' THEN 'nack' ELSE 'expired' END AS outcome FROM lineitem)"""
CL = """
cl AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'normal' ELSE 'low' END AS lane, l_suppkey AS consumer_id,
         epoch_us(l_shipdate) // 1000 AS claimed_at_ms, epoch_us(l_shipdate) // 1000 + 604800000 AS deadline_ms, CAST(l_partkey % 4 AS INTEGER) AS extensions FROM lineitem)"""
EVENT_LANES_SQL = "lanes AS (SELECT * FROM (VALUES ('critical', 8, 0), ('high', 4, 1), ('normal', 2, 2), ('low', 1, 3)) AS t(lane, weight, lane_ord))"
ORDER_LANES_SQL = "lanes AS (SELECT * FROM (VALUES ('1-URGENT', 8, 0), ('2-HIGH', 4, 1), ('3-MEDIUM', 2, 2), ('4-NOT SPECIFIED', 1, 3), ('5-LOW', 1, 4)) AS t(lane, weight, lane_ord))"
RELEASES = f"""{LI}, rel AS (SELECT id, attempt, consumer_id, outcome AS reason, CAST(CASE outcome WHEN 'expired' THEN 604800000 ELSE 302400000 END AS BIGINT) AS held_for_ms,
  outcome = 'expired' AS presumed_dead, claimed_at_ms + CASE outcome WHEN 'expired' THEN 604800000 ELSE 302400000 END AS released_at_ms FROM li)"""


def folded(window: int, key: str = "user_key") -> str:
    """CTEs up to f: every message with its anchor."""
    return f"""RECURSIVE {EV}, e AS (SELECT *, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS rn FROM ev),
f AS (SELECT k, rn, seq, now_ms, id, lane, false AS duplicate, now_ms AS anchor, id AS original FROM e WHERE rn = 1
      UNION ALL
      SELECT e.k, e.rn, e.seq, e.now_ms, e.id, e.lane, e.now_ms < f.anchor + {window}, CASE WHEN e.now_ms < f.anchor + {window} THEN f.anchor ELSE e.now_ms END,
        CASE WHEN e.now_ms < f.anchor + {window} THEN f.original ELSE e.id END
      FROM f JOIN e ON e.k = f.k AND e.rn = f.rn + 1)"""


def _log(spark, sf_dir, window=HOUR, key="user") -> DataFrame:
    return dedupe.windowed(adapters.enqueue_log(spark, sf_dir, key), window)


# dedupe


@query(f"WITH {folded(HOUR)} SELECT seq, k AS dedupe_key, id, duplicate FROM f")
def dedupe_windowed_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("seq", "dedupe_key", "id", "duplicate")


@query(f"WITH {folded(DAY, 'type_key')} SELECT seq, k AS dedupe_key, id, duplicate FROM f")
def dedupe_windowed_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, DAY, "type").select("seq", "dedupe_key", "id", "duplicate")


@query(f"WITH {folded(DAY, 'type_key')} SELECT seq, k AS dedupe_key, id, duplicate, CASE WHEN duplicate THEN original END AS original_id, CASE WHEN duplicate THEN now_ms - anchor END AS original_age_ms FROM f")
def dedupe_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JVM form, for keys of bounded size."""
    out = dedupe.windowed_native(adapters.enqueue_log(spark, sf_dir, "type"), DAY)
    return out.select("seq", "dedupe_key", "id", "duplicate", "original_id", "original_age_ms")


@query(f"WITH {folded(DAY)} SELECT seq, id, original AS original_id, now_ms - anchor AS original_age_ms FROM f WHERE duplicate")
def dedupe_original_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, DAY).where("duplicate").select("seq", "id", "original_id", "original_age_ms")


@query(f"WITH {folded(HOUR)} SELECT count(*) AS checked, count(*) FILTER (duplicate) AS duplicates, count(*) FILTER (duplicate) / count(*) AS duplicate_rate FROM f")
def dedupe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.statistics(_log(spark, sf_dir))


@query(f"WITH {folded(HOUR)} SELECT count(*) AS accepted, count(*) FILTER (gone) AS evicted, count(*) FILTER (NOT gone) AS tracked_keys FROM (SELECT anchor + {HOUR} <= (SELECT max(now_ms) FROM f) AS gone FROM f WHERE NOT duplicate)")
def dedupe_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.evictions(_log(spark, sf_dir), HOUR)


@query(f"WITH {folded(DAY)} SELECT DISTINCT k AS dedupe_key FROM f WHERE NOT duplicate AND anchor + {DAY} > (SELECT max(now_ms) FROM f)")
def dedupe_tracked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir, DAY)
    last = rows.agg(F.max("now_ms").alias("last_ms"))
    return rows.where("not duplicate").join(F.broadcast(last)).where(F.col("anchor_ms") + DAY > F.col("last_ms")).select("dedupe_key").distinct()


@query(f"WITH {folded(DAY)} SELECT k AS dedupe_key, count(*) AS messages, count(*) FILTER (NOT duplicate) AS accepted, count(*) FILTER (duplicate) AS duplicates, max(CASE WHEN duplicate THEN now_ms - anchor END) AS max_age_ms FROM f GROUP BY k")
def dedupe_key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.key_report(_log(spark, sf_dir, DAY))


@query(f"WITH {folded(DAY)} SELECT seq, id, k AS dedupe_key, original AS original_id, now_ms - anchor AS original_age_ms FROM f")
def dedupe_original_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message (anchors too) finds its anchor by a range join with the accepted ones."""
    log = adapters.enqueue_log(spark, sf_dir)
    return dedupe.original_by_range(log, dedupe.windowed(log, DAY).where("not duplicate"), DAY)


@query(f"WITH {folded(HOUR)} SELECT 'all' AS queue, count(*) AS checked, count(*) FILTER (duplicate) AS duplicates, round(count(*) FILTER (duplicate) / count(*), 12) AS duplicate_rate, (SELECT count(*) FROM f WHERE NOT duplicate AND anchor + {HOUR} > (SELECT max(now_ms) FROM f)) AS tracked_keys, CAST(119814 AS BIGINT) AS bloom_bytes, false AS oversaturated FROM f")
def dedupe_bloom_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL says `oversaturated` as the constant false, which holds up to 116,158 insertions since the last rebuild; beyond them
    the filter is oversaturated, and so says the query. The filter's other counters are tested against a plain fold."""
    out = dedupe.diagnostics(adapters.enqueue_log(spark, sf_dir), Dedupe(HOUR))
    return out.select("queue", "checked", "duplicates", F.round("duplicate_rate", 12).alias("duplicate_rate"), "tracked_keys", "bloom_bytes", "oversaturated")


# bloom filter

SIZES = [(100_000, 0.01), (1000, 0.01), (10, 0.5), (100_000, 1e-9), (0, 0.9)]
SIZES_SQL = "s AS (SELECT * FROM (VALUES (100000, CAST(0.01 AS DOUBLE)), (1000, 0.01), (10, 0.5), (100000, 1e-9), (0, 0.9)) AS t(keys, rate)), " + (
    "m AS (SELECT keys, rate, greatest(keys, 1) AS n, CAST(ceil(-greatest(keys, 1) * ln(least(greatest(rate, 1e-6), 0.5)) / power(ln(2), 2)) AS BIGINT) AS bits FROM s), "
    "h AS (SELECT keys, rate, bits, CAST(greatest(1, floor(bits / n * ln(2) + 0.5)) AS INTEGER) AS hashes FROM m)"
)


def _sizes(spark: SparkSession) -> DataFrame:
    s = spark.createDataFrame(SIZES, "keys int, rate double")
    return s.withColumn("bits", hashing.bloom_bits(F.col("keys"), F.col("rate"))).withColumn("hashes", hashing.bloom_hashes(F.col("keys"), F.col("rate")))


@query(f"WITH {SIZES_SQL} SELECT keys, rate, bits, hashes, CAST(ceil(bits / 8) AS BIGINT) AS bytes FROM h")
def bloom_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark).withColumn("bytes", hashing.bloom_bytes(F.col("bits")))


@query(f"""WITH {SIZES_SQL}, e AS (SELECT count(DISTINCT user_id) AS n FROM events), r AS (SELECT keys, rate, n, power(1 - exp(-hashes * n / bits), hashes) AS est FROM h, e)
SELECT keys, rate, round(est, 12) AS estimated_rate, est > 2 * rate AS oversaturated FROM r""")
def bloom_estimated_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As after inserting every user once."""
    users = read_table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("n"))
    rows = _sizes(spark).join(F.broadcast(users)).withColumn("est", hashing.estimated_rate(F.col("bits"), F.col("hashes"), F.col("n")))
    return rows.select("keys", "rate", F.round("est", 12).alias("estimated_rate"), hashing.oversaturated(F.col("est"), F.col("rate")).alias("oversaturated"))


NAMES_SQL = "n AS (SELECT n_name AS name FROM nation UNION SELECT event_type FROM events UNION SELECT '' UNION SELECT 'a' UNION SELECT 'foobar')"
FNV_SQL = "CAST(list_reduce(list_prepend(2166136261::HUGEINT, [ord(x)::HUGEINT FOR x IN string_split(name, '') IF x <> '']), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296) AS BIGINT)"
DJB_SQL = "CAST(list_reduce(list_prepend(5381::HUGEINT, [ord(x)::HUGEINT FOR x IN string_split(name, '') IF x <> '']), lambda h, c: (h * 33 + c) % 4294967296) AS BIGINT)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame([("",), ("a",), ("foobar",)], "name string")
    return read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(read_table(spark, sf_dir, "events").select("event_type")).union(fixed).distinct()


@query(f"WITH {NAMES_SQL} SELECT name, {FNV_SQL} AS hash FROM n")
def hash_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).withColumn("hash", hashing.fnv1a(F.col("name")))


@query(f"WITH {NAMES_SQL} SELECT name, {DJB_SQL} AS hash FROM n")
def hash_djb2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).withColumn("hash", hashing.djb2(F.col("name")))


WIDE_SQL = "n AS (SELECT n_name || chr(CAST(128512 + n_nationkey AS INTEGER)) || chr(233) || chr(CAST(65536 + n_nationkey AS INTEGER)) AS name FROM nation)"
UNITS_SQL = "flatten([CASE WHEN ord(x) > 65535 THEN [55296 + (ord(x) - 65536) // 1024, 56320 + (ord(x) - 65536) % 1024] ELSE [ord(x)] END FOR x IN string_split(name, '') IF x <> ''])"


@query(f"""WITH {WIDE_SQL}, u AS (SELECT name, [x::HUGEINT FOR x IN {UNITS_SQL}] AS units FROM n)
SELECT name, CAST(list_reduce(list_prepend(2166136261::HUGEINT, units), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296) AS BIGINT) AS fnv1a,
CAST(list_reduce(list_prepend(5381::HUGEINT, units), lambda h, c: (h * 33 + c) % 4294967296) AS BIGINT) AS djb2 FROM u""")
def hash_beyond_the_basic_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with characters that are two UTF-16 units each."""
    wide = lambda start: F.decode(F.unhex(F.lpad(F.hex(F.col("n_nationkey").cast("long") + start), 8, "0")), "UTF-32")
    names = read_table(spark, sf_dir, "nation").select(F.concat("n_name", wide(128512), F.lit("\u00e9"), wide(65536)).alias("name"))
    return names.select("name", hashing.fnv1a(F.col("name")).alias("fnv1a"), hashing.djb2(F.col("name")).alias("djb2"))


@query(f"WITH {NAMES_SQL}, h AS (SELECT name, {FNV_SQL} AS a, {DJB_SQL} | 1 AS b FROM n) SELECT name, i, CAST((a + i * b) % 4294967296 % 958506 AS BIGINT) AS bit FROM h, range(7) AS r(i)")
def bloom_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _names(spark, sf_dir)
    bits = hashing.bloom_indices(hashing.fnv1a(F.col("name")), hashing.djb2(F.col("name")), 958_506, 7)
    return rows.select("name", F.posexplode(bits).alias("i", "bit")).withColumn("i", F.col("i").cast("long"))


# lanes


@query(f"WITH {folded(HOUR)}, {EVENT_LANES_SQL} SELECT lane, count(seq) AS depth FROM lanes LEFT JOIN (SELECT lane, seq FROM f WHERE NOT duplicate) AS x USING (lane) GROUP BY lane")
def lane_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted messages of each lane: windowed dedupe, then a count joined back to the declared lanes."""
    log = adapters.enqueue_log(spark, sf_dir)
    accepted = dedupe.windowed(log, HOUR).where("not duplicate").select("seq").join(log.select("seq", "lane", F.col("now_ms").alias("enqueued_at_ms")), "seq")
    return lanes.states(accepted, lanes_frame(spark, EVENT_LANES), ["seq"]).select("lane", "depth")


@query(f"WITH {ODR} SELECT lane, id, enqueued_at_ms FROM odr QUALIFY row_number() OVER (PARTITION BY lane ORDER BY enqueued_at_ms, id) = 1")
def lane_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.heads(adapters.backlog(spark, sf_dir), ["enqueued_at_ms", "id"]).select("lane", "id", "enqueued_at_ms")


STATES_SQL = f"{ODR}, {ORDER_LANES_SQL}, st AS (SELECT lane, weight, lane_ord, count(id) AS depth, arg_min(enqueued_at_ms, (enqueued_at_ms, id)) AS oldest_enqueued_at_ms FROM lanes LEFT JOIN odr USING (lane) GROUP BY ALL)"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.states(adapters.backlog(spark, sf_dir), lanes_frame(spark, ORDER_LANES), ["enqueued_at_ms", "id"])


@query(f"WITH {STATES_SQL} SELECT lane, CAST(weight AS DOUBLE) AS weight, lane_ord, depth, oldest_enqueued_at_ms FROM st")
def lane_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


@query(f"WITH {ODR} SELECT lane, id, CAST(row_number() OVER w AS INTEGER) AS rank FROM odr WINDOW w AS (PARTITION BY lane ORDER BY enqueued_at_ms, id) QUALIFY row_number() OVER w <= 10")
def lane_fifo_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.heads(adapters.backlog(spark, sf_dir), ["enqueued_at_ms", "id"], 10).select("lane", "id", "rank")


@query(f"WITH {ODR} SELECT lane, count(*) AS n FROM odr WHERE lane NOT IN ('1-URGENT', '2-HIGH') GROUP BY lane")
def unknown_lane_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lanes_frame(spark, ORDER_LANES).where("weight >= 4")
    return lanes.unknown_lanes(adapters.backlog(spark, sf_dir), known).groupBy("lane").agg(F.count("*").alias("n"))


WAITED = f"greatest(0, {ORDERS_NOW} - oldest_enqueued_at_ms)"


@query(f"WITH {STATES_SQL} SELECT lane, {WAITED} AS waited_ms, {WAITED} - 2592000000 AS over_by FROM st WHERE depth > 0 AND {WAITED} > 2592000000")
def starvation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.violations(_states(spark, sf_dir), ORDERS_NOW, ORDER_LANES.max_starvation_ms)


@query(f"WITH {STATES_SQL} SELECT lane, {WAITED} AS waited_ms FROM st WHERE depth > 0 AND {WAITED} > 2592000000 AND (SELECT count(*) FROM st WHERE depth > 0) > 1 ORDER BY waited_ms DESC, lane_ord LIMIT 1")
def starvation_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.starving_pick(_states(spark, sf_dir), ORDERS_NOW, ORDER_LANES.max_starvation_ms)


@query(f"WITH {EVENT_LANES_SQL} SELECT lane, weight / sum(weight) OVER () AS expected_share FROM lanes")
def expected_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.expected_share(lanes_frame(spark, EVENT_LANES))


def credit_sql(n: int, c: bool, h: bool, m: bool, w: bool) -> str:
    """CTEs up to r(seq, lane): n selections with the given lanes always waiting, as four credit columns."""
    lanes_ = [("critical", 8, c), ("high", 4, h), ("normal", 2, m), ("low", 1, w)]
    cols = ["dc", "dh", "dn", "dl"]
    earn = ", ".join(f"{d} + {weight if on else 0} AS {d}" for d, (_, weight, on) in zip(cols, lanes_, strict=True))
    on = [(d, x[0]) for d, x in zip(cols, lanes_, strict=True) if x[2]]
    best = f"greatest({', '.join(d for d, _ in on)})"
    pick = "CASE " + " ".join(f"WHEN {d} = {best} THEN '{name}'" for d, name in on) + " END"
    pay = ", ".join(f"{d} - CASE WHEN lane = '{x[0]}' THEN 15 ELSE 0 END" for d, x in zip(cols, lanes_, strict=True))
    return f"""r(seq, lane, dc, dh, dn, dl) AS (SELECT 0, '', 0, 0, 0, 0 UNION ALL
  SELECT seq, lane, {pay} FROM (SELECT seq, {pick} AS lane, dc, dh, dn, dl FROM (SELECT seq + 1 AS seq, {earn} FROM r WHERE seq < {n})))"""


@query(f"WITH RECURSIVE {credit_sql(1500, True, True, True, True)} SELECT CAST(seq AS BIGINT) AS seq, lane FROM r WHERE seq > 0")
def wrr_sequence_all_backlogged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.backlogged_sequence(spark, EVENT_LANES, 1500)


@query(f"WITH RECURSIVE {credit_sql(1500, False, True, False, True)} SELECT lane, round(count(*) / 1500, 12) AS share FROM r WHERE seq > 0 GROUP BY lane")
def wrr_subset_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed form; the SQL counts 1500 selections."""
    return scheduling.subset_shares(spark, EVENT_LANES, ["high", "low"]).withColumn("share", F.round("share", 12))


#: The first 300 events wait; one is taken every minute after the last came.
OVERRIDE_SQL = f"""RECURSIVE {EV}, b AS (SELECT * FROM ev ORDER BY seq LIMIT 300), t0 AS (SELECT max(now_ms) AS t FROM b),
ls AS (SELECT coalesce(list(now_ms ORDER BY seq) FILTER (lane = 'critical'), []) AS c, coalesce(list(now_ms ORDER BY seq) FILTER (lane = 'high'), []) AS h,
              coalesce(list(now_ms ORDER BY seq) FILTER (lane = 'normal'), []) AS m, coalesce(list(now_ms ORDER BY seq) FILTER (lane = 'low'), []) AS w FROM b),
s(seq, now_ms, lane, reason, waited_ms, i1, i2, i3, i4, d1, d2, d3, d4) AS (
  SELECT 0, CAST(0 AS BIGINT), '', '', CAST(0 AS BIGINT), 1, 1, 1, 1, 0, 0, 0, 0
  UNION ALL
  SELECT seq, now_ms, lane, reason, CASE lane WHEN 'critical' THEN a1 WHEN 'high' THEN a2 WHEN 'normal' THEN a3 ELSE a4 END,
    i1 + CAST(lane = 'critical' AS INTEGER), i2 + CAST(lane = 'high' AS INTEGER), i3 + CAST(lane = 'normal' AS INTEGER), i4 + CAST(lane = 'low' AS INTEGER),
    CASE WHEN reason = 'weighted' THEN e1 - CASE WHEN lane = 'critical' THEN 15 ELSE 0 END ELSE d1 END, CASE WHEN reason = 'weighted' THEN e2 - CASE WHEN lane = 'high' THEN 15 ELSE 0 END ELSE d2 END,
    CASE WHEN reason = 'weighted' THEN e3 - CASE WHEN lane = 'normal' THEN 15 ELSE 0 END ELSE d3 END, CASE WHEN reason = 'weighted' THEN e4 - CASE WHEN lane = 'low' THEN 15 ELSE 0 END ELSE d4 END
  FROM (SELECT *, CASE WHEN alone THEN 'only_nonempty' WHEN worst > 64800000 THEN 'starvation_override' ELSE 'weighted' END AS reason,
      CASE WHEN alone OR worst > 64800000 THEN CASE worst WHEN a1 THEN 'critical' WHEN a2 THEN 'high' WHEN a3 THEN 'normal' ELSE 'low' END
           ELSE CASE greatest(CASE WHEN a1 >= 0 THEN e1 END, CASE WHEN a2 >= 0 THEN e2 END, CASE WHEN a3 >= 0 THEN e3 END, CASE WHEN a4 >= 0 THEN e4 END)
                WHEN CASE WHEN a1 >= 0 THEN e1 END THEN 'critical' WHEN CASE WHEN a2 >= 0 THEN e2 END THEN 'high' WHEN CASE WHEN a3 >= 0 THEN e3 END THEN 'normal' ELSE 'low' END END AS lane
    FROM (SELECT *, greatest(a1, a2, a3, a4) AS worst, CAST(a1 >= 0 AS INTEGER) + CAST(a2 >= 0 AS INTEGER) + CAST(a3 >= 0 AS INTEGER) + CAST(a4 >= 0 AS INTEGER) = 1 AS alone,
        d1 + CASE WHEN a1 >= 0 THEN 8 ELSE 0 END AS e1, d2 + CASE WHEN a2 >= 0 THEN 4 ELSE 0 END AS e2, d3 + CASE WHEN a3 >= 0 THEN 2 ELSE 0 END AS e3, d4 + CASE WHEN a4 >= 0 THEN 1 ELSE 0 END AS e4
      FROM (SELECT p.seq + 1 AS seq, t + 60000 * (p.seq + 1) AS now_ms, i1, i2, i3, i4, d1, d2, d3, d4,
          coalesce(t + 60000 * (p.seq + 1) - c[i1], -1) AS a1, coalesce(t + 60000 * (p.seq + 1) - h[i2], -1) AS a2, coalesce(t + 60000 * (p.seq + 1) - m[i3], -1) AS a3, coalesce(t + 60000 * (p.seq + 1) - w[i4], -1) AS a4
        FROM s AS p, t0, ls WHERE p.seq < (SELECT count(*) FROM b)))))"""


def _override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections while a start-up backlog of 300 messages (the scenario's size) drains."""
    first = adapters.enqueue_log(spark, sf_dir).orderBy("seq").limit(300)
    last = first.agg(F.max("now_ms")).first()[0] or 0
    return scheduling.drained(first.select("lane", F.col("now_ms").alias("enqueued_at_ms"), F.col("seq").alias("pos")), EVENT_LANES, last + 60_000, 60_000)


@query(f"WITH {OVERRIDE_SQL} SELECT CAST(seq AS BIGINT) AS seq, lane, reason, waited_ms FROM s WHERE seq > 0")
def scheduler_with_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _override(spark, sf_dir).select("seq", "lane", "reason", "waited_ms")


OBSERVED = f"{OVERRIDE_SQL}, {EVENT_LANES_SQL}, ob AS (SELECT lane, weight, count(seq) AS selections, count(*) FILTER (reason = 'starvation_override') AS overrides, count(seq) / sum(count(seq)) OVER () AS observed_share, weight / sum(weight) OVER () AS expected_share FROM lanes LEFT JOIN (SELECT * FROM s WHERE seq > 0) USING (lane) GROUP BY lane, weight)"


@query(f"WITH {OBSERVED} SELECT lane, selections, overrides, observed_share FROM ob")
def observed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.observed_share(_override(spark, sf_dir), lanes_frame(spark, EVENT_LANES))


@query(f"WITH {OBSERVED} SELECT lane, round(observed_share, 12) AS observed_share, round(expected_share, 12) AS expected_share, round(observed_share - expected_share, 12) AS distortion FROM ob")
def share_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lanes.distortion(_override(spark, sf_dir), lanes_frame(spark, EVENT_LANES))
    return out.select("lane", *[F.round(c, 12).alias(c) for c in ("observed_share", "expected_share", "distortion")])


@query(f"WITH {OVERRIDE_SQL} SELECT lane, count(*) AS selections FROM s WHERE seq > 100 GROUP BY lane")
def selections_since_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics were reset after the hundredth selection."""
    resets = spark.createDataFrame([(40,), (100,)], "seq long")
    return lanes.since_reset(_override(spark, sf_dir), resets).groupBy("lane").agg(F.count("*").alias("selections"))


def _drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections while all events drain, each user's as a queue of its own. A recursive query over whole tables is too
    slow, so what follows has no SQL; the four queries above are the scenario of 300 messages that has."""
    log = adapters.enqueue_log(spark, sf_dir)
    rows = log.select("lane", F.col("now_ms").alias("enqueued_at_ms"), F.col("seq").alias("pos"), F.col("dedupe_key").alias("user_key"))
    return scheduling.drained(rows, EVENT_LANES, None, 60_000, "user_key")


@query()
def scheduler_with_override_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir).select("queue", "seq", "lane", "reason", "waited_ms")


@query()
def observed_share_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.observed_share(_drained(spark, sf_dir), lanes_frame(spark, EVENT_LANES))


@query()
def share_distortion_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.distortion(_drained(spark, sf_dir), lanes_frame(spark, EVENT_LANES))


@query()
def selections_since_reset_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each queue's statistics were reset after its fifth selection."""
    resets = spark.createDataFrame([(2,), (5,)], "seq long")
    return lanes.since_reset(_drained(spark, sf_dir), resets).groupBy("lane").agg(F.count("*").alias("selections"))


@query(f"WITH {EV}, d AS (SELECT lane, now_ms // {DAY} * {DAY} AS bucket_ms, count(*) AS change FROM ev GROUP BY ALL) SELECT lane, bucket_ms, change, CAST(sum(change) OVER (PARTITION BY lane ORDER BY bucket_ms) AS BIGINT) AS depth FROM d")
def running_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = adapters.enqueue_log(spark, sf_dir)
    return lanes.running_depth(log.select("lane", "now_ms", F.lit(1).alias("delta")), DAY)


# claims


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.with_deadline(adapters.delivery_claims(spark, sf_dir), LEASE)


@query(f"WITH {CL} SELECT id, line, consumer_id, claimed_at_ms, deadline_ms, CAST(604800000 * 3 AS BIGINT) AS max_hold_ms FROM cl")
def claim_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("id", "line", "consumer_id", "claimed_at_ms", "deadline_ms", F.lit(int(LEASE.max_hold_ms)).cast("long").alias("max_hold_ms"))


@query(f"WITH {CL} SELECT id, line, lane, 'expired' AS reason, {ITEMS_NOW} - claimed_at_ms AS held_for_ms, true AS presumed_dead FROM cl WHERE deadline_ms <= {ITEMS_NOW}")
def expired_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.expired(_claims(spark, sf_dir), ITEMS_NOW).select("id", "line", "lane", "reason", "held_for_ms", "presumed_dead")


@query(f"WITH {CL} SELECT id, line, lane, deadline_ms FROM cl WHERE consumer_id = 7")
def claims_for_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.of_consumer(_claims(spark, sf_dir), 7).select("id", "line", "lane", "deadline_ms")


@query(f"WITH {CL} SELECT count(*) AS in_flight, count(*) FILTER (deadline_ms - {ITEMS_NOW} <= 60480000) AS nearing_expiry, count(*) FILTER (extensions >= 2) AS at_extension_cap FROM cl")
def inflight_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.statistics(_claims(spark, sf_dir), ITEMS_NOW, LEASE)


@query(f"WITH {CL} SELECT lane, consumer_id, count(*) AS claims FROM cl GROUP BY GROUPING SETS ((), (lane), (consumer_id))")
def inflight_by_lane_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.by_lane_and_consumer(_claims(spark, sf_dir))


def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.ledger(adapters.attempts(spark, sf_dir), LEASE)


@query(f"WITH {RELEASES} SELECT * FROM rel")
def release_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _releases(spark, sf_dir)


COMMANDS_SQL = f"{CL}, cm AS (SELECT id, CASE WHEN line % 3 = 0 THEN consumer_id + 1 ELSE consumer_id END AS consumer_id, line FROM cl)"


def _commands(claims: DataFrame) -> DataFrame:
    """Acks of every claim, each third one by another consumer."""
    return claims.select("id", F.when(F.col("line") % 3 == 0, F.col("consumer_id") + 1).otherwise(F.col("consumer_id")).alias("consumer_id"), "line")


@query(f"WITH {COMMANDS_SQL} SELECT id, consumer_id, line FROM cm SEMI JOIN cl USING (id, consumer_id)")
def ownership_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    return leases.owned(_commands(claims), claims).select("id", "consumer_id", "line")


@query(f"WITH {COMMANDS_SQL} SELECT id, consumer_id, line FROM cm ANTI JOIN cl USING (id, consumer_id)")
def rejected_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    return leases.rejected(_commands(claims), claims).select("id", "consumer_id", "line")


@query(f"""WITH {LI}, i AS (SELECT id, attempt AS seq, claimed_at_ms, claimed_at_ms + 604800000 AS end_ms FROM li)
SELECT DISTINCT b.id, b.seq AS later_seq FROM i a JOIN i b ON a.id = b.id AND a.seq < b.seq AND b.claimed_at_ms < a.end_ms""")
def claim_overlap_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items aren't claims by one queue, so here the operator does find overlaps."""
    rows = adapters.attempts(spark, sf_dir).select("id", F.col("attempt").alias("seq"), "claimed_at_ms", (F.col("claimed_at_ms") + int(LEASE.timeout_ms)).alias("end_ms"))
    return leases.overlaps(rows).select("id", "later_seq")


@query(f"""WITH {CL}, d AS (SELECT bucket_ms, CAST(sum(d) AS BIGINT) AS change FROM (SELECT claimed_at_ms // {DAY} * {DAY} AS bucket_ms, 1 AS d FROM cl UNION ALL SELECT deadline_ms // {DAY} * {DAY}, -1 FROM cl) GROUP BY ALL)
SELECT bucket_ms, change, CAST(sum(change) OVER (ORDER BY bucket_ms) AS BIGINT) AS in_flight FROM d""")
def inflight_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.gauge(_claims(spark, sf_dir).withColumnRenamed("deadline_ms", "end_ms"), DAY)


HEARTBEAT = Visibility(2 * HOUR, 2)


@query(f"""WITH RECURSIVE {EV}, e AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq) AS rn FROM ev),
h AS (SELECT user_key, rn, seq, 'claimed' AS outcome, now_ms + {2 * HOUR} AS deadline, 0 AS ext FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_key, e.rn, e.seq, CASE WHEN h.deadline <= e.now_ms THEN 'claimed' WHEN h.ext >= 2 THEN 'EXTENSION_CAP_REACHED' ELSE 'OK' END,
    CASE WHEN h.deadline > e.now_ms AND h.ext >= 2 THEN h.deadline ELSE e.now_ms + {2 * HOUR} END, CASE WHEN h.deadline <= e.now_ms THEN 0 WHEN h.ext >= 2 THEN h.ext ELSE h.ext + 1 END
  FROM h JOIN e ON e.user_key = h.user_key AND e.rn = h.rn + 1)
SELECT seq, user_key AS id, outcome FROM h""")
def heartbeat_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a user extends the user's claim; where that has expired (or there is none), it claims anew."""
    log = adapters.enqueue_log(spark, sf_dir).select("seq", "now_ms", F.col("dedupe_key").alias("id"), F.lit("low").alias("lane"), F.lit("c").alias("consumer_id"))
    both = log.withColumn("op", F.explode(F.array(F.lit("heartbeat"), F.lit("claim"))))
    both = both.withColumn("seq", 2 * F.col("seq") + (F.col("op") == "claim").cast("long"))
    told = journal.leased(both, HEARTBEAT).where("event = 'claimed' or event = 'extended' or reason = 'EXTENSION_CAP_REACHED'")
    return told.select((F.col("seq") / 2).cast("long").alias("seq"), "id", F.when(F.col("event") == "claimed", "claimed").otherwise(F.col("reason")).alias("outcome"))


# retries and dead letters


@query(f"WITH {RELEASES} SELECT id, attempt, reason, CASE WHEN attempt >= 5 THEN 'dead' ELSE 'requeue' END AS disposition, CASE WHEN attempt < 5 THEN attempt + 1 END AS next_attempt FROM rel WHERE reason <> 'ack'")
def retry_or_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retries.classified(_releases(spark, sf_dir), 5).select("id", "attempt", "reason", "disposition", "next_attempt")


@query(f"WITH {RELEASES} SELECT id, attempt AS attempts, reason, presumed_dead AS outcome_unknown FROM rel WHERE reason <> 'ack' AND attempt >= 5")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retries.dead_letters(_releases(spark, sf_dir), 5)


@query(f"WITH {RELEASES} SELECT count(*) AS dead_letters, count(*) FILTER (presumed_dead) AS unknown_outcomes FROM rel WHERE reason <> 'ack' AND attempt >= 5")
def unknown_outcome_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retries.dead_letters(_releases(spark, sf_dir), 5).agg(F.count("*").alias("dead_letters"), F.count_if("outcome_unknown").alias("unknown_outcomes"))


REPLAY_SQL = f"""{RELEASES}, dl AS (SELECT id, attempt AS ord, row_number() OVER (PARTITION BY id ORDER BY attempt) AS nth FROM rel WHERE reason <> 'ack' AND attempt >= 5),
rq AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY place) AS nth FROM (SELECT o_orderkey AS id, o_orderkey AS place FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderkey + 1000000000 FROM orders WHERE o_custkey % 4 = 0))"""


def _replay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders of even customers are asked for, those of each other one of them twice."""
    dead = retries.dead_letters(_releases(spark, sf_dir), 5).select("id", F.col("attempts").alias("ord"))
    orders = read_table(spark, sf_dir, "orders")
    once = orders.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("place"), F.col("o_orderkey").alias("id"))
    twice = orders.where("o_custkey % 4 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("place"), F.col("o_orderkey").alias("id"))
    return retries.replayed(dead, once.unionByName(twice))


@query(f"WITH {REPLAY_SQL} SELECT id, ord FROM dl JOIN rq USING (id, nth)")
def replay_nth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay(spark, sf_dir)[0].select("id", "ord")


@query(f"WITH {REPLAY_SQL} SELECT id, ord FROM dl ANTI JOIN rq USING (id, nth)")
def replay_left_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay(spark, sf_dir)[1].select("id", "ord")


@query(f"WITH {RELEASES} SELECT 'requeued' AS origin, count(*) AS n FROM rel WHERE reason <> 'ack' AND attempt < 5 UNION ALL SELECT 'replayed', count(*) FROM rel WHERE reason <> 'ack' AND attempt >= 5")
def waiting_after_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = retries.classified(_releases(spark, sf_dir), 5)
    again = kinds.where("disposition = 'requeue'").select("id", F.col("next_attempt").alias("attempt"), F.lit("requeued").alias("origin"))
    back = kinds.where("disposition = 'dead'").select("id", F.lit(1).alias("attempt"), F.lit("replayed").alias("origin"))
    return retries.waiting_after(again, back).groupBy("origin").agg(F.count("*").alias("n"))


@query(f"""WITH {RELEASES} SELECT id, arg_max(reason, attempt) AS last_error, min(released_at_ms) AS first_failed_at_ms FROM rel WHERE reason <> 'ack' GROUP BY id""")
def failure_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retries.failure_history(_releases(spark, sf_dir))


@query(f"WITH {RELEASES} SELECT id, attempt AS attempts, reason FROM rel WHERE reason = 'nack' AND attempt >= 5 ORDER BY attempts DESC, id LIMIT 50")
def dead_letters_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of at most fifty: the limit is the documented feature."""
    dead = retries.dead_letters(_releases(spark, sf_dir), 5).withColumn("ord", F.struct(-F.col("attempts"), "id"))
    return retries.select_dead(dead, "nack", 50).select("id", "attempts", "reason")


# the whole queue


def queue_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event an enqueue, a claim, and what the claim's consumer does with the message that came three events ago."""
    log = adapters.enqueue_log(spark, sf_dir)
    older = F.lag("id", 3).over(Window.partitionBy("queue").orderBy("seq"))
    base = log.withColumn("queue", F.concat(F.lit("q"), (F.col("seq") % 4).cast("string"))).withColumn("old", older)
    ending = F.when(F.col("seq") % 7 == 0, "nack").when(F.col("seq") % 5 == 0, "heartbeat").otherwise("ack")
    ops = base.select("*", F.posexplode(F.array(F.lit("enqueue"), F.lit("claim"), ending)).alias("k", "op"))
    target = F.when(F.col("op") == "enqueue", F.col("id")).when(F.col("op") != "claim", F.col("old"))
    return ops.select(
        "queue",
        (3 * F.col("seq") + F.col("k")).alias("seq"),
        "now_ms",
        "op",
        target.alias("id"),
        F.when(F.col("op") == "enqueue", F.col("lane")).alias("lane"),
        F.when(F.col("op") != "enqueue", F.lit("c")).alias("consumer_id"),
        F.when(F.col("op") == "enqueue", F.col("dedupe_key")).alias("dedupe_key"),
        F.when(F.col("op") == "enqueue", F.col("payload")).alias("payload"),
        F.when(F.col("op") == "nack", F.lit("failed")).alias("reason"),
    )


QUEUE = QueueConfig(EVENT_LANES, Visibility(30 * 60_000, 2), Dedupe(HOUR), 3)


@query()
def queue_replay_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal of four queues over a whole command log."""
    return journal.replayed(queue_commands(spark, sf_dir), QUEUE).drop("payload")


@query(f"WITH {folded(HOUR, 'user_key').replace('PARTITION BY user_key', 'PARTITION BY user_key, seq % 4').replace('user_key AS k', chr(39) + 'q' + chr(39) + ' || seq % 4 || user_key AS k')} SELECT 3 * seq AS seq, CASE WHEN duplicate THEN original ELSE id END AS id, duplicate AS deduplicated, CASE WHEN duplicate THEN original END AS original_id, CASE WHEN duplicate THEN now_ms - anchor END AS original_age_ms FROM f")
def queue_enqueue_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole queues' fold says of enqueues; the SQL folds dedupe alone."""
    return journal.enqueue_results(journal.replayed(queue_commands(spark, sf_dir), QUEUE)).drop("queue")


@query()
def queue_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.dead_letters(journal.replayed(queue_commands(spark, sf_dir), QUEUE))


@query()
def queue_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.event_counts(journal.replayed(queue_commands(spark, sf_dir), QUEUE))


@query()
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = journal.queue_stats(journal.replayed(queue_commands(spark, sf_dir), QUEUE), QUEUE.lanes)
    return out.withColumns({c: F.to_json(c) for c in ("depth_by_lane", "selections_by_lane")})


# documented extensions


@query(f"WITH {LI} SELECT DISTINCT attempt, CAST(least(300000, 1000 * power(2, attempt - 1)) AS BIGINT) AS cap_ms FROM li")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.attempts(spark, sf_dir).select("attempt", retries.backoff_cap_ms(F.col("attempt")).alias("cap_ms")).distinct()


@query(f"WITH {LI} SELECT attempt, count(*) AS retries, true AS in_range FROM li WHERE outcome <> 'ack' GROUP BY attempt")
def backoff_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.attempts(spark, sf_dir).where("outcome != 'ack'").withColumn("delay", retries.backoff_ms(F.col("id"), F.col("attempt")))
    return rows.groupBy("attempt").agg(F.count("*").alias("retries"), F.every(F.col("delay").between(0, retries.backoff_cap_ms(F.col("attempt")))).alias("in_range"))


@query(f"WITH {EV} SELECT lane, count(*) AS n FROM ev WHERE now_ms + seq % 10 * {DAY} <= (SELECT max(now_ms) FROM ev) GROUP BY lane")
def delayed_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages delayed by up to nine days, at the time of the last one."""
    log = adapters.enqueue_log(spark, sf_dir)
    last = log.agg(F.max("now_ms")).first()[0] or 0
    rows = log.select("lane", F.col("now_ms").alias("enqueued_at_ms"), ((F.col("seq") % 10) * DAY).alias("delay_ms"))
    return retries.due(rows, last).groupBy("lane").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, d AS (SELECT lane, now_ms // {HOUR} * {HOUR} AS bucket_ms, count(*) AS depth FROM ev GROUP BY ALL),
p AS (SELECT *, depth > 3 AS pressed, coalesce(lag(depth > 3) OVER (PARTITION BY lane ORDER BY bucket_ms), false) AS was FROM d)
SELECT lane, bucket_ms, depth, CASE WHEN pressed THEN 'pressed' ELSE 'relieved' END AS edge FROM p WHERE pressed <> was""")
def backpressure_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of an hour as the depth, with three as the most."""
    log = adapters.enqueue_log(spark, sf_dir)
    hours = log.groupBy("lane", (F.floor(F.col("now_ms") / HOUR) * HOUR).cast("long").alias("bucket_ms")).agg(F.count("*").alias("depth"))
    return retries.pressure_edges(hours, 3)


@query(f"""WITH {EV}, d AS (SELECT lane, now_ms // {HOUR} * {HOUR} AS bucket_ms, count(*) AS depth FROM ev GROUP BY ALL)
SELECT lane, arg_max(depth > 3, bucket_ms) AS throttle FROM d GROUP BY lane HAVING bool_or(depth > 3)""")
def backpressure_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retries.throttled(backpressure_edges(spark, sf_dir))


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A group of the even nations becomes that of the nations whose number isn't divisible by three; suppliers are dealt."""
    nations = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("member"))
    parts = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("partition"))
    none = spark.createDataFrame([], "partition long, member long")
    old = retries.assigned(nations.where("member % 2 = 0"), parts, none)
    return old, retries.assigned(nations.where("member % 3 != 0"), parts, old)


@query("""WITH m AS (SELECT n_nationkey AS member, row_number() OVER (ORDER BY n_nationkey) AS i, count(*) OVER () AS k FROM nation WHERE n_nationkey % 2 = 0), p AS (SELECT count(*) AS n FROM supplier)
SELECT CAST(member AS BIGINT) AS member, CAST(n // k + CAST(i <= n % k AS INTEGER) AS BIGINT) AS partitions FROM m, p WHERE n // k + CAST(i <= n % k AS INTEGER) > 0""")
def group_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)[0].groupBy("member").agg(F.count("*").alias("partitions"))


@query()
def group_assignment_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retries.moves(*_groups(spark, sf_dir))


# queries of other modules, which register themselves
from tidemill.plans import lifecycles  # noqa: E402, F401
