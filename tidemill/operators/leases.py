"""Claims with deadlines: relational operators over snapshots of claims, and over delivery attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.config import Visibility


def with_deadline(claims: DataFrame, visibility: Visibility) -> DataFrame:
    """Claims (claimed_at_ms) with the deadline that they have until they are extended."""
    return claims.withColumn("deadline_ms", F.col("claimed_at_ms") + int(visibility.timeout_ms))


def expired(claims: DataFrame, now_ms: int) -> DataFrame:
    """Releases of the claims whose deadline has come, in the order in which they were made (`ins_ord`, if there)."""
    out = claims.where(F.col("deadline_ms") <= now_ms).withColumn("reason", F.lit("expired"))
    out = out.withColumn("held_for_ms", F.lit(now_ms) - F.col("claimed_at_ms")).withColumn("presumed_dead", F.lit(True))
    return out.orderBy("ins_ord") if "ins_ord" in claims.columns else out


def live(claims: DataFrame, now_ms: int) -> DataFrame:
    return claims.where(F.col("deadline_ms") > now_ms)


def of_consumer(claims: DataFrame, consumer_id) -> DataFrame:
    """All claims of a consumer, expired ones too."""
    return claims.where(F.col("consumer_id") == consumer_id)


def statistics(claims: DataFrame, now_ms: int, visibility: Visibility) -> DataFrame:
    """One row: in_flight, nearing_expiry (a tenth of the timeout or less is left, expired ones too), at_extension_cap."""
    near = F.col("deadline_ms") - now_ms <= 0.1 * visibility.timeout_ms
    return claims.agg(F.count("*").alias("in_flight"), F.count_if(near).alias("nearing_expiry"), F.count_if(F.col("extensions") >= visibility.max_extensions).alias("at_extension_cap"))


def by_lane_and_consumer(claims: DataFrame) -> DataFrame:
    """lane, consumer_id, claims: counts of each lane, of each consumer and of all, in one pass (null: any)."""
    grouped = claims.groupingSets([[], ["lane"], ["consumer_id"]], "lane", "consumer_id")
    return grouped.agg(F.count("*").alias("claims"))


def ledger(attempts: DataFrame, visibility: Visibility) -> DataFrame:
    """Releases of delivery attempts (id, attempt, consumer_id, claimed_at_ms, outcome): an expired one is held to its
    deadline, the others for half of it."""
    timeout = int(visibility.timeout_ms)
    gone = F.col("outcome") == "expired"
    held = F.when(gone, F.lit(timeout)).otherwise(F.lit(timeout // 2)).cast("long")
    return attempts.select("id", "attempt", "consumer_id", F.col("outcome").alias("reason"), held.alias("held_for_ms"), gone.alias("presumed_dead"), (F.col("claimed_at_ms") + held).alias("released_at_ms"))


def owned(commands: DataFrame, claims: DataFrame) -> DataFrame:
    """Commands (id, consumer_id) whose consumer holds the claim."""
    return commands.join(claims, ["id", "consumer_id"], "left_semi")


def rejected(commands: DataFrame, claims: DataFrame) -> DataFrame:
    """Commands whose consumer doesn't hold the claim."""
    return commands.join(claims, ["id", "consumer_id"], "left_anti")


def overlaps(claims: DataFrame) -> DataFrame:
    """Pairs of claims on one id that are live at once: (id, seq, later_seq); there have to be none. Claims: id, seq,
    claimed_at_ms, end_ms.

    If any two overlap, some claim overlaps with the running greatest end before it, so one sorted pass finds the later
    claim and the one it runs into; no self-join of an id's claims is made.
    """
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    worst = F.max(F.struct("end_ms", "seq")).over(before)
    hit = claims.withColumn("_w", worst).where(F.col("claimed_at_ms") < F.col("_w.end_ms"))
    return hit.select("id", F.col("_w.seq").alias("seq"), F.col("seq").alias("later_seq"))


def gauge(claims: DataFrame, bucket_ms: int) -> DataFrame:
    """bucket_ms, change, in_flight: claims in flight after each bucket of time; claims: claimed_at_ms, end_ms."""
    bucket = lambda c: (F.floor(F.col(c) / bucket_ms) * bucket_ms).cast("long")
    ups = claims.select(bucket("claimed_at_ms").alias("bucket_ms"), F.lit(1).alias("d"))
    downs = claims.select(bucket("end_ms").alias("bucket_ms"), F.lit(-1).alias("d"))
    summed = ups.unionByName(downs).groupBy("bucket_ms").agg(F.sum("d").cast("long").alias("change"))
    # one row a bucket: the only thing that has to be in one order
    return summed.withColumn("in_flight", F.sum("change").over(Window.orderBy("bucket_ms").rowsBetween(Window.unboundedPreceding, 0)))
