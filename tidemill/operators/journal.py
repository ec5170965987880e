"""Command logs folded into a journal, and the journal's relations as plain DataFrame views."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidemill.config import QueueConfig, Visibility
from tidemill.operators.folds import fold_sorted
from tidemill.operators.machine import LeaseMachine, QueueMachine
from tidemill.sources.schemas import COMMANDS, JOURNAL

COLUMNS = [c.split()[0] for c in COMMANDS.split(", ")]


def padded(commands: DataFrame) -> DataFrame:
    """The commands with every column of the schema; missing ones are null, and the queue is `all`."""
    kinds = dict(c.split(" ") for c in COMMANDS.split(", "))
    fill = {"queue": F.lit("all")}
    return commands.select(*[F.col(c).cast(t).alias(c) if c in commands.columns else fill.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def numbered(machine, row: dict):
    """A machine's events for a command, with queue, seq and their number."""
    for n, event in enumerate(machine.step(row)):
        yield {"queue": row["queue"], "seq": row["seq"], "n": n} | event


def _fold(commands: DataFrame, key: str, make) -> DataFrame:
    # the schema as Arrow's, made on the driver: workers need no session for it
    arrow = to_arrow_schema(_parse_datatype_string(JOURNAL))

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, arrow)

    return fold_sorted(padded(commands), key, ["seq"], lambda _: make(), numbered, JOURNAL, out)


def replayed(commands: DataFrame, config: QueueConfig) -> DataFrame:
    """The journal of whole queues. A queue's commands are folded in order of seq; queues run in parallel."""
    return _fold(commands, "queue", lambda: QueueMachine(config))


def leased(commands: DataFrame, config: Visibility) -> DataFrame:
    """The journal of claims on their own, in parallel by id."""
    return _fold(commands, "id", lambda: LeaseMachine(config))


def enqueue_results(journal: DataFrame) -> DataFrame:
    """seq, id (the original's for duplicates), deduplicated, original_id, original_age_ms."""
    dup = F.col("event") == "duplicate"
    rows = journal.where(F.col("event").isin("enqueued", "duplicate"))
    return rows.select("queue", "seq", F.when(dup, F.col("original_id")).otherwise(F.col("id")).alias("id"), dup.alias("deduplicated"), "original_id", F.col("amount_ms").alias("original_age_ms"))


def selections(journal: DataFrame) -> DataFrame:
    return journal.where("event = 'selected'").select("queue", "seq", "lane", "reason", F.col("amount_ms").alias("waited_ms"))


def claims(journal: DataFrame) -> DataFrame:
    return journal.where("event = 'claimed'").select("queue", "seq", "id", "lane", "consumer_id", "attempt", F.col("now_ms").alias("claimed_at_ms"), "deadline_ms")


def releases(journal: DataFrame) -> DataFrame:
    return journal.where("event = 'released'").select("queue", "seq", "n", "id", "lane", "reason", "attempt", F.col("amount_ms").alias("held_for_ms"), F.col("unknown").alias("presumed_dead"))


def dead_letters(journal: DataFrame) -> DataFrame:
    """queue, ord (seq, n), message, reason, attempts, dead_lettered_at_ms, outcome_unknown, in order of ord."""
    message = F.struct("id", "lane", "payload", F.col("now_ms").alias("enqueued_at_ms"), "attempt", "dedupe_key")
    rows = journal.where("event = 'dead'")
    return rows.select("queue", F.struct("seq", "n").alias("ord"), message.alias("message"), "reason", F.col("attempt").alias("attempts"), F.col("now_ms").alias("dead_lettered_at_ms"), F.col("unknown").alias("outcome_unknown"))


def outcomes(journal: DataFrame) -> DataFrame:
    """One row a command: the last thing that happened, and whether it was what was asked for."""
    last = F.max_by(F.struct("event", "ok", "reason"), F.col("n"))
    return journal.groupBy("queue", "seq").agg(last.alias("x")).select("queue", "seq", "x.*")


def event_counts(journal: DataFrame) -> DataFrame:
    return journal.groupBy("queue", "event").agg(F.count("*").alias("n"))


def lane_balance(journal: DataFrame) -> DataFrame:
    """queue, lane, waiting: messages that went in less those that went out."""
    change = F.when(F.col("event").isin("enqueued", "requeued", "replayed"), 1).when(F.col("event") == "claimed", -1).otherwise(0)
    return journal.groupBy("queue", "lane").agg(F.sum(change).cast("long").alias("waiting")).where(F.col("lane").isNotNull())


def queue_stats(journal: DataFrame, lanes: list[str]) -> DataFrame:
    """One row a queue after its last command: depth_by_lane (declared lanes, zeros too), total_depth, in_flight,
    dead_letters, unknown_outcomes (of all dead letters ever), selections_by_lane, overrides, selections."""
    event, n = F.col("event"), lambda cond: F.count_if(cond)
    into, out = event.isin("enqueued", "requeued", "replayed"), event == "claimed"
    depth = [(n(into & (F.col("lane") == x)) - n(out & (F.col("lane") == x))).alias(f"d{i}") for i, x in enumerate(lanes)]
    chosen = [n((event == "selected") & (F.col("lane") == x)).alias(f"s{i}") for i, x in enumerate(lanes)]
    rows = journal.groupBy("queue").agg(
        *depth,
        *chosen,
        (n(out) - n(event == "released")).alias("in_flight"),
        (n(event == "dead") - n(event.isin("replayed", "dropped"))).alias("dead_letters"),
        n((event == "dead") & F.col("unknown")).alias("unknown_outcomes"),
        n((event == "selected") & (F.col("reason") == "starvation_override")).alias("overrides"),
        n(event == "selected").alias("selections"),
    )
    as_map = lambda p: F.create_map(*[c for i, x in enumerate(lanes) for c in (F.lit(x), F.col(f"{p}{i}"))])
    total = sum((F.col(f"d{i}") for i in range(1, len(lanes))), F.col("d0"))
    return rows.select("queue", as_map("d").alias("depth_by_lane"), total.alias("total_depth"), "in_flight", "dead_letters", "unknown_outcomes", as_map("s").alias("selections_by_lane"), "overrides", "selections")
