"""Retry, dead letters and replay over delivery attempts, and the documented extensions, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classified(releases: DataFrame, max_attempts: int) -> DataFrame:
    """Releases that aren't acks, with their disposition: dead or requeue (with the next attempt)."""
    dead = F.col("attempt") >= max_attempts
    rows = releases.where("reason != 'ack'").withColumn("disposition", F.when(dead, "dead").otherwise("requeue"))
    return rows.withColumn("next_attempt", F.when(~dead, F.col("attempt") + 1))


def dead_letters(releases: DataFrame, max_attempts: int) -> DataFrame:
    """id, attempts, reason, outcome_unknown of spent messages."""
    spent = classified(releases, max_attempts).where("disposition = 'dead'")
    return spent.select("id", F.col("attempt").alias("attempts"), "reason", F.col("presumed_dead").alias("outcome_unknown"))


def replayed(dead: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(taken, left): the n-th request for an id takes its n-th dead letter. dead: id, ord; asked: place, id."""
    nth = lambda df, order: df.withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy(order)))
    entries, requests = nth(dead, "ord"), nth(asked, "place").select("id", "_nth", "place")
    return entries.join(requests, ["id", "_nth"]).drop("_nth"), entries.join(requests, ["id", "_nth"], "left_anti").drop("_nth")


def waiting_after(waiting: DataFrame, *more: DataFrame) -> DataFrame:
    """The union of what waits with what comes back (reaped, requeued, replayed)."""
    for df in more:
        waiting = waiting.unionByName(df, allowMissingColumns=True)
    return waiting


def backoff_cap_ms(attempt: Column, base_ms: int = 1000, most_ms: int = 300_000) -> Column:
    """Extension: the longest delay before a retry, doubling from `base_ms`."""
    return F.least(F.lit(most_ms).cast("long"), (base_ms * F.pow(F.lit(2.0), F.least(attempt, F.lit(40)) - 1)).cast("long"))


def backoff_ms(id_: Column, attempt: Column, seed: int = 0, base_ms: int = 1000, most_ms: int = 300_000) -> Column:
    """Extension: full jitter, the same whenever it is computed: a hash of message and attempt picks from 0 to the cap."""
    return F.pmod(F.xxhash64(id_, attempt, F.lit(seed)), backoff_cap_ms(attempt, base_ms, most_ms) + 1)


def due(messages: DataFrame, now_ms: int) -> DataFrame:
    """Extension: messages whose delay (enqueued_at_ms, delay_ms) is over."""
    return messages.where(F.col("enqueued_at_ms") + F.coalesce("delay_ms", F.lit(0)) <= now_ms)


def pressure_edges(depths: DataFrame, max_depth: int, max_lag_ms: int | None = None) -> DataFrame:
    """Extension: where a lane's depth goes over `max_depth` (or its head's lag over `max_lag_ms`) or back; depths: lane,
    bucket_ms, depth (and lag_ms)."""
    window = Window.partitionBy("lane").orderBy("bucket_ms")
    pressed = F.col("depth") > max_depth
    if max_lag_ms is not None:
        pressed = pressed | (F.coalesce("lag_ms", F.lit(0)) > max_lag_ms)
    flagged = depths.withColumn("pressed", pressed)
    was = F.coalesce(F.lag("pressed").over(window), F.lit(False))
    return flagged.withColumn("_was", was).where("pressed != _was").select("lane", "bucket_ms", "depth", F.when(F.col("pressed"), "pressed").otherwise("relieved").alias("edge"))


def throttled(edges: DataFrame) -> DataFrame:
    """Extension: lane, throttle: whether each lane's last edge left it pressed."""
    return edges.groupBy("lane").agg((F.max_by("edge", "bucket_ms") == "pressed").alias("throttle"))


def assigned(members: DataFrame, partitions: DataFrame, old: DataFrame) -> DataFrame:
    """Extension: partition, member after a change of the group, moving only what has to move.

    Members (a bounded list: a group's consumers) get quotas that differ by one at most; each keeps up to its quota of what
    it had, and the rest goes to what is missing. members: member; partitions: partition; old: partition, member.
    """
    n_p, n_m = partitions.count(), max(1, members.count())
    held = old.join(F.broadcast(members), "member", "left_semi").join(partitions, "partition", "left_semi")
    have = held.groupBy("member").agg(F.count("*").alias("had"))
    # those that have most get the quotas that are one larger, so that fewer partitions move
    order = Window.orderBy(F.desc("had"), "member")
    quota = members.join(have, "member", "left").fillna(0, ["had"]).withColumn("_i", F.row_number().over(order))
    quota = quota.withColumn("quota", F.lit(n_p // n_m) + (F.col("_i") <= n_p % n_m).cast("int"))
    place = F.row_number().over(Window.partitionBy("member").orderBy("partition"))
    kept = held.withColumn("_at", place).join(F.broadcast(quota.select("member", "quota")), "member").where("_at <= quota").select("partition", "member")
    free = partitions.join(kept, "partition", "left_anti").withColumn("_slot", F.row_number().over(Window.orderBy("partition")))
    count = kept.groupBy("member").agg(F.count("*").alias("_k"))
    wanted = quota.join(count, "member", "left").fillna(0, ["_k"]).where("quota > _k").select("member", F.explode(F.sequence(F.col("_k") + 1, F.col("quota").cast("long"))).alias("_n"))
    slots = wanted.withColumn("_slot", F.row_number().over(Window.orderBy("_n", "member")))
    return kept.unionByName(free.join(slots, "_slot").select("partition", "member"))


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Extension: the rebalance event of each member: sorted partitions that it got and that it lost."""
    full = old.withColumnRenamed("member", "was").join(new.withColumnRenamed("member", "now"), "partition", "full_outer")
    moved = full.where(~F.col("was").eqNullSafe(F.col("now")))
    got = moved.where("now is not null").select(F.col("now").alias("member"), "partition", F.lit(True).alias("got"))
    lost = moved.where("was is not null").select(F.col("was").alias("member"), "partition", F.lit(False).alias("got"))
    part = lambda flag: F.sort_array(F.collect_list(F.when(F.col("got") == flag, F.col("partition"))))
    return got.unionByName(lost).groupBy("member").agg(part(True).alias("assigned"), part(False).alias("revoked"))


def failure_history(releases: DataFrame) -> DataFrame:
    """Extension: id, last_error, first_failed_at_ms over releases that failed (id, attempt, reason, released_at_ms)."""
    failed = releases.where("reason != 'ack'")
    return failed.groupBy("id").agg(F.max_by("reason", "attempt").alias("last_error"), F.min("released_at_ms").alias("first_failed_at_ms"))


def select_dead(dead: DataFrame, reason: str | None = None, limit: int | None = None, order: str = "ord") -> DataFrame:
    """Extension: dead letters of a reason, the first `limit` in order."""
    rows = dead.where(F.col("reason") == reason) if reason is not None else dead
    return rows.orderBy(order).limit(limit) if limit is not None else rows.orderBy(order)
