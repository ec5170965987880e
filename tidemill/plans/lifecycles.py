"""Whole queues whose every message has a known life: each event of a user goes through one of eight scripts, to its end,
before the next, so SQL can say what the fold of commands has to emit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import journal
from tidemill.plans.catalogue import EV, QUEUE, query
from tidemill.sources import adapters

HOLD = QUEUE.visibility.timeout_ms
#: The scripts' commands: op, consumer, reason, lane (null: the event's own), whether it has the dedupe key, and how much later it comes.
SCRIPTS = [
    [("enqueue",), ("claim", "c"), ("ack", "c")],
    [("enqueue",), ("claim", "c"), ("ack", "x"), ("heartbeat", "x"), ("nack", "x", "not mine"), ("ack", "c"), ("ack", "c")],
    [("enqueue",), ("claim", "c"), ("nack", "c", "f1"), ("claim", "d"), ("nack", "d", "f2"), ("claim", "c"), ("nack", "c", "f3"), ("claim", "c")],
    [("enqueue",), ("claim", "c"), ("nack", "c", "f1"), ("claim", "c"), ("nack", "c", "f2"), ("claim", "c"), ("nack", "c", "f3"), ("replay",), ("replay",), ("claim", "c"), ("ack", "c")],
    [("enqueue",), ("claim", "c"), ("heartbeat", "c"), ("heartbeat", "c"), ("heartbeat", "c"), ("ack", "c")],
    [("enqueue",), ("claim", "c"), ("dead_letter", "x", "not mine"), ("dead_letter", "c", "poison")],
    [("enqueue",), ("claim", "c"), ("reap", None, None, None, False, HOLD - 1), ("reap", None, None, None, False, HOLD), ("claim", "d", None, None, False, HOLD), ("ack", "d", None, None, False, HOLD)],
    [("enqueue", None, None, "nowhere"), ("claim", "c"), ("enqueue", None, None, None, True), ("claim", "c"), ("ack", "c"), ("enqueue", None, None, None, True), ("forget", None, None, None, True), ("forget", None, None, None, True), ("enqueue", None, None, None, True), ("claim", "c"), ("ack", "c")],
]
#: What the scripts have to emit, by hand from the rules: kind, place of the command, number of the event, event, reason, attempt, ok, held or left ms.
EXPECTED = """
(0,0,0,'enqueued',NULL,1,true,NULL),(0,1,0,'selected','only_nonempty',NULL,NULL,0),(0,1,1,'claimed',NULL,1,true,NULL),(0,2,0,'released','ack',1,true,0),
(1,0,0,'enqueued',NULL,1,true,NULL),(1,1,0,'selected','only_nonempty',NULL,NULL,0),(1,1,1,'claimed',NULL,1,true,NULL),(1,2,0,'refused','NOT_OWNED',NULL,false,NULL),
(1,3,0,'refused','WRONG_CONSUMER',NULL,false,NULL),(1,4,0,'refused','NOT_OWNED',NULL,false,NULL),(1,5,0,'released','ack',1,true,0),(1,6,0,'refused','NOT_OWNED',NULL,false,NULL),
(2,0,0,'enqueued',NULL,1,true,NULL),(2,1,0,'selected','only_nonempty',NULL,NULL,0),(2,1,1,'claimed',NULL,1,true,NULL),(2,2,0,'released','nack',1,true,0),(2,2,1,'requeued','f1',2,true,NULL),
(2,3,0,'selected','only_nonempty',NULL,NULL,0),(2,3,1,'claimed',NULL,2,true,NULL),(2,4,0,'released','nack',2,true,0),(2,4,1,'requeued','f2',3,true,NULL),
(2,5,0,'selected','only_nonempty',NULL,NULL,0),(2,5,1,'claimed',NULL,3,true,NULL),(2,6,0,'released','nack',3,true,0),(2,6,1,'dead','f3',3,false,NULL),(2,7,0,'empty',NULL,NULL,false,NULL),
(3,0,0,'enqueued',NULL,1,true,NULL),(3,1,0,'selected','only_nonempty',NULL,NULL,0),(3,1,1,'claimed',NULL,1,true,NULL),(3,2,0,'released','nack',1,true,0),(3,2,1,'requeued','f1',2,true,NULL),
(3,3,0,'selected','only_nonempty',NULL,NULL,0),(3,3,1,'claimed',NULL,2,true,NULL),(3,4,0,'released','nack',2,true,0),(3,4,1,'requeued','f2',3,true,NULL),
(3,5,0,'selected','only_nonempty',NULL,NULL,0),(3,5,1,'claimed',NULL,3,true,NULL),(3,6,0,'released','nack',3,true,0),(3,6,1,'dead','f3',3,false,NULL),
(3,7,0,'replayed',NULL,1,true,NULL),(3,9,0,'selected','only_nonempty',NULL,NULL,0),(3,9,1,'claimed',NULL,1,true,NULL),(3,10,0,'released','ack',1,true,0),
(4,0,0,'enqueued',NULL,1,true,NULL),(4,1,0,'selected','only_nonempty',NULL,NULL,0),(4,1,1,'claimed',NULL,1,true,NULL),(4,2,0,'extended','OK',1,true,NULL),(4,3,0,'extended','OK',0,true,NULL),
(4,4,0,'refused','EXTENSION_CAP_REACHED',NULL,false,NULL),(4,5,0,'released','ack',1,true,0),
(5,0,0,'enqueued',NULL,1,true,NULL),(5,1,0,'selected','only_nonempty',NULL,NULL,0),(5,1,1,'claimed',NULL,1,true,NULL),(5,2,0,'refused','NOT_OWNED',NULL,false,NULL),
(5,3,0,'released','nack',1,true,0),(5,3,1,'dead','poison',1,false,NULL),
(6,0,0,'enqueued',NULL,1,true,NULL),(6,1,0,'selected','only_nonempty',NULL,NULL,0),(6,1,1,'claimed',NULL,1,true,NULL),(6,3,0,'released','expired',1,true,1800000),(6,3,1,'requeued','visibility timeout expired',2,true,NULL),
(6,4,0,'selected','only_nonempty',NULL,NULL,0),(6,4,1,'claimed',NULL,2,true,NULL),(6,5,0,'released','ack',2,true,0),
(7,0,0,'rejected','unknown lane',NULL,false,NULL),(7,1,0,'empty',NULL,NULL,false,NULL),(7,2,0,'enqueued',NULL,1,true,NULL),(7,3,0,'selected','only_nonempty',NULL,NULL,0),(7,3,1,'claimed',NULL,1,true,NULL),
(7,4,0,'released','ack',1,true,0),(7,5,0,'duplicate',NULL,NULL,false,0),(7,6,0,'forgotten',NULL,NULL,true,NULL),(7,7,0,'forgotten',NULL,NULL,false,NULL),(7,8,0,'enqueued',NULL,1,true,NULL),
(7,9,0,'selected','only_nonempty',NULL,NULL,0),(7,9,1,'claimed',NULL,1,true,NULL),(7,10,0,'released','ack',1,true,0)"""
JOURNAL = f"""{EV}, x(kind, k, n, event, reason, attempt, ok, amount_ms) AS (VALUES {EXPECTED}),
j AS (SELECT user_key AS queue, 20 * seq + k AS seq, CAST(n AS INTEGER) AS n, event, ev.id, ev.lane, reason, CAST(attempt AS INTEGER) AS attempt, ok, CAST(amount_ms AS BIGINT) AS amount_ms, seq AS event_id, payload FROM ev JOIN x ON seq % 8 = kind)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's script, in the queue of its user."""
    one = lambda s: (*s, *(None,) * (6 - len(s)))
    said = [(kind, k, *one(s)) for kind, script in enumerate(SCRIPTS) for k, s in enumerate(script)]
    scripts = spark.createDataFrame(said, "kind long, k long, op string, consumer_id string, reason string, to string, keyed boolean, later long")
    log = adapters.enqueue_log(spark, sf_dir).withColumn("kind", F.col("seq") % 8).withColumnRenamed("dedupe_key", "user")
    rows = log.join(F.broadcast(scripts), "kind")  # the scripts are some sixty rows
    own = F.col("op").isin("enqueue", "ack", "nack", "heartbeat", "dead_letter")
    return rows.select(
        F.col("user").alias("queue"),
        (20 * F.col("seq") + F.col("k")).alias("seq"),
        (F.col("now_ms") + F.coalesce("later", F.lit(0))).alias("now_ms"),
        "op",
        F.when(own, F.col("id")).alias("id"),
        F.when(F.col("op") == "enqueue", F.coalesce("to", "lane")).alias("lane"),
        "consumer_id",
        F.when(F.col("keyed"), F.col("id")).alias("dedupe_key"),
        F.when(F.col("op") == "enqueue", F.col("payload")).alias("payload"),
        "reason",
        F.when(F.col("op") == "replay", F.array("id")).alias("ids"),
    )


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.replayed(commands(spark, sf_dir), QUEUE)


@query(f"WITH {JOURNAL} SELECT queue, seq, n, event, reason, attempt, ok, amount_ms FROM j")
def lifecycle_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that happens in the queues: claims, extensions, refusals, releases, retries, dead letters, replays, duplicates."""
    return _journal(spark, sf_dir).select("queue", "seq", "n", "event", "reason", "attempt", "ok", "amount_ms")


@query(f"WITH {JOURNAL} SELECT queue, event, count(*) AS n FROM j GROUP BY queue, event")
def lifecycle_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.event_counts(_journal(spark, sf_dir))


@query(f"WITH {JOURNAL} SELECT queue, seq, arg_max(event, n) AS event, arg_max(ok, n) AS ok FROM j GROUP BY queue, seq")
def lifecycle_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each command that had an effect or an answer."""
    return journal.outcomes(_journal(spark, sf_dir)).select("queue", "seq", "event", "ok")


@query(f"WITH {JOURNAL} SELECT queue, id, lane, payload, attempt AS attempts, reason, false AS outcome_unknown FROM j WHERE event = 'dead'")
def lifecycle_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead letters keep their messages' payloads through retries."""
    rows = journal.dead_letters(_journal(spark, sf_dir))
    return rows.select("queue", "message.id", "message.lane", "message.payload", "attempts", "reason", "outcome_unknown")


@query(f"""WITH {JOURNAL} SELECT queue, CAST(0 AS BIGINT) AS total_depth, CAST(0 AS BIGINT) AS in_flight, count(*) FILTER (event = 'dead' AND event_id % 8 <> 3) AS dead_letters,
CAST(0 AS BIGINT) AS unknown_outcomes, CAST(0 AS BIGINT) AS overrides, count(*) FILTER (event = 'selected') AS selections FROM j GROUP BY queue""")
def lifecycle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each queue's figures after its last command: nothing waits or is held, and dead letters that weren't replayed are left."""
    out = journal.queue_stats(_journal(spark, sf_dir), QUEUE.lanes)
    return out.select("queue", "total_depth", "in_flight", "dead_letters", "unknown_outcomes", "overrides", "selections")


@query(f"WITH {JOURNAL} SELECT queue, seq, n, lane, reason, attempt, amount_ms AS held_for_ms, reason = 'expired' AS presumed_dead FROM j WHERE event = 'released'")
def lifecycle_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.releases(_journal(spark, sf_dir)).drop("id")
