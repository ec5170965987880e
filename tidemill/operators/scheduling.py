"""Weighted lane selection: closed forms as joins, and the credit rule as a fold."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from fractions import Fraction
from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.config import Scheduling


@dataclass
class Credits:
    """Credit of each lane. Every waiting lane earns its weight in a round; the one with the most pays all weights.
    Lanes that don't wait keep what they have, debts included."""

    scheduling: Scheduling
    order: Sequence[str] = ()
    credit: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.order = tuple(self.order or self.scheduling.weights)
        for lane in self.order:
            self.credit.setdefault(lane, 0)

    def pick(self, waiting: Iterable[str]) -> str:
        weights = self.scheduling.weights
        lanes = [x for x in self.order if x in set(waiting)]
        for lane in lanes:
            self.credit[lane] += weights[lane]
        # the most credit, then the larger weight, then the earlier lane
        rank = {lane: -i for i, lane in enumerate(lanes)}
        winner = max(lanes, key=lambda x: (self.credit[x], weights[x], rank[x]))
        self.credit[winner] -= self.scheduling.total
        return winner

    def select(self, oldest: dict[str, int | None], now: int) -> tuple[str, str, int] | None:
        """(lane, reason, waited) for the waiting lanes with their heads' times, or None."""
        waiting = [x for x in self.order if x in oldest]
        if not waiting:
            return None
        waited = {x: 0 if oldest[x] is None else max(0, now - oldest[x]) for x in waiting}
        if len(waiting) == 1:
            return waiting[0], "only_nonempty", waited[waiting[0]]
        late = [x for x in waiting if waited[x] > self.scheduling.max_starvation_ms]
        if late:
            first = max(late, key=lambda x: waited[x])  # of equals the earlier lane
            return first, "starvation_override", waited[first]
        lane = self.pick(waiting)
        return lane, "weighted", waited[lane]


def period(scheduling: Scheduling, active: Sequence[str] | None = None) -> list[str]:
    """One period of selections of lanes that all always wait, when these are all lanes."""
    parts = [Fraction(w).limit_denominator(10**6) for w in scheduling.weights.values()]
    scale = 1
    for p in parts:
        scale = scale * p.denominator // gcd(scale, p.denominator)
    whole = [int(p * scale) for p in parts]
    rounds = sum(whole) // gcd(*whole)
    credits = Credits(scheduling)
    return [credits.pick(active or scheduling.weights) for _ in range(rounds)]


def backlogged_sequence(spark: SparkSession, scheduling: Scheduling, n: int) -> DataFrame:
    """seq (from 1), lane: n selections when all lanes always wait, by joining seq mod period with one period."""
    pattern = period(scheduling)
    small = spark.createDataFrame(list(enumerate(pattern)), "_at int, lane string")
    rows = spark.range(1, n + 1).withColumnRenamed("id", "seq").withColumn("_at", F.pmod(F.col("seq") - 1, F.lit(len(pattern))).cast("int"))
    return rows.join(F.broadcast(small), "_at").select("seq", "lane")


def subset_shares(spark: SparkSession, scheduling: Scheduling, active: Sequence[str]) -> DataFrame:
    """lane, share: long-run shares of lanes that always wait while the others never do (two lanes at least)."""
    total, part, k = scheduling.total, sum(scheduling.weights[x] for x in active), len(active)
    rows = [(x, float(scheduling.weights[x])) for x in active]
    lanes = spark.createDataFrame(rows, "lane string, weight double")
    return lanes.select("lane", (F.col("weight") / total + (1 - part / total) / k).alias("share"))


SELECTION = "seq long, now_ms long, lane string, reason string, waited_ms long"


def drained(log: DataFrame, scheduling: Scheduling, first_poll_ms: int | None, every_ms: int, queue: str | None = None) -> DataFrame:
    """Selections when a backlog (id, lane, enqueued_at_ms, pos; optionally a queue column) is polled every `every_ms` until
    it is empty, from `first_poll_ms` on; if that is None, each queue from `every_ms` after its last message on. The rule
    needs a queue's whole order, so the parallelism is across queues; a queue's state is its lanes' waiting times only."""
    from tidemill.session import ship

    ship(log.sparkSession)
    key = F.col(queue) if queue else F.lit("all")
    rows = log.select(key.cast("string").alias("queue"), "lane", "enqueued_at_ms", "pos")

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos", kind="stable")
        waiting = {lane: list(part) for lane, part in pdf.groupby("lane")["enqueued_at_ms"]}
        at = dict.fromkeys(waiting, 0)
        credits, out = Credits(scheduling), []
        start = int(pdf["enqueued_at_ms"].max()) + every_ms if first_poll_ms is None else first_poll_ms
        for i in range(len(pdf)):
            now = start + i * every_ms
            lane, reason, waited = credits.select({x: waiting[x][at[x]] for x in waiting if at[x] < len(waiting[x])}, now)
            at[lane] += 1
            out.append((key[0], i + 1, now, lane, reason, waited))
        return pd.DataFrame(out, columns=["queue", "seq", "now_ms", "lane", "reason", "waited_ms"])

    return rows.groupBy("queue").applyInPandas(run, f"queue string, {SELECTION}")
