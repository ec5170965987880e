"""Lane relations: depth, heads, states, shares, starvation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def age(now_ms: Column, oldest_ms: Column) -> Column:
    """How long a lane's head has waited; 0 without one, and never negative."""
    return F.greatest(F.lit(0).cast("long"), now_ms - F.coalesce(oldest_ms, now_ms))


def unknown_lanes(messages: DataFrame, lanes: DataFrame) -> DataFrame:
    """Messages for lanes that aren't declared."""
    return messages.join(F.broadcast(lanes.select("lane")), "lane", "left_anti")


def states(messages: DataFrame, lanes: DataFrame, position: list[str]) -> DataFrame:
    """lane, weight, lane_ord, depth, oldest_enqueued_at_ms (the head's, not the least) for every declared lane."""
    head = F.min_by("enqueued_at_ms", F.struct(*position))
    waiting = messages.groupBy("lane").agg(F.count("*").alias("depth"), head.alias("oldest_enqueued_at_ms"))
    # lanes are a few declared rows and stand on the left: every lane shows up
    return lanes.join(waiting, "lane", "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))


def heads(messages: DataFrame, position: list[str], k: int = 1) -> DataFrame:
    """The first k messages of every lane with their rank; only k a lane and task go through the shuffle."""
    rank = F.row_number().over(Window.partitionBy("lane").orderBy(*position))
    return messages.withColumn("rank", rank).where(F.col("rank") <= k)


def violations(lane_states: DataFrame, now_ms: int, max_starvation_ms: int) -> DataFrame:
    """lane, waited_ms, over_by of waiting lanes over the bound, worst first."""
    waited = lane_states.where("depth > 0").withColumn("waited_ms", age(F.lit(now_ms), F.col("oldest_enqueued_at_ms")))
    over = waited.where(F.col("waited_ms") > max_starvation_ms).withColumn("over_by", F.col("waited_ms") - max_starvation_ms)
    return over.orderBy(F.desc("over_by"), "lane_ord").select("lane", "waited_ms", "over_by")


def starving_pick(lane_states: DataFrame, now_ms: int, max_starvation_ms: int) -> DataFrame:
    """The lane that starvation puts first, if two lanes wait at least (a lone lane is never an override)."""
    several = lane_states.where("depth > 0").agg((F.count("*") > 1).alias("_several"))
    return violations(lane_states, now_ms, max_starvation_ms).limit(1).join(F.broadcast(several)).where("_several").select("lane", "waited_ms")


def expected_share(lanes: DataFrame) -> DataFrame:
    """lane, expected_share: each weight's part of all weights."""
    return lanes.select("lane", (F.col("weight") / F.sum("weight").over(Window.partitionBy())).alias("expected_share"))


def observed_share(selections: DataFrame, lanes: DataFrame) -> DataFrame:
    """lane, selections, overrides, observed_share over declared lanes; selections: lane, reason."""
    counted = selections.groupBy("lane").agg(F.count("*").alias("selections"), F.count_if(F.col("reason") == "starvation_override").alias("overrides"))
    zero = F.lit(0).cast("long")
    every = lanes.select("lane").join(counted, "lane", "left").select("lane", F.coalesce("selections", zero).alias("selections"), F.coalesce("overrides", zero).alias("overrides"))
    total = F.sum("selections").over(Window.partitionBy())
    return every.withColumn("observed_share", F.coalesce(F.try_divide(F.col("selections").cast("double"), total), F.lit(0.0)))


def distortion(selections: DataFrame, lanes: DataFrame) -> DataFrame:
    """lane, observed_share, expected_share and their difference."""
    both = observed_share(selections, lanes).join(expected_share(lanes), "lane")
    return both.select("lane", "observed_share", "expected_share", (F.col("observed_share") - F.col("expected_share")).alias("distortion"))


def since_reset(selections: DataFrame, resets: DataFrame) -> DataFrame:
    """The selections after the last reset of statistics (both have seq); credit isn't touched by a reset."""
    last = resets.agg(F.max("seq").alias("_reset"))
    return selections.join(F.broadcast(last)).where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))).drop("_reset")


def running_depth(changes: DataFrame, bucket_ms: int) -> DataFrame:
    """lane, bucket_ms, change, depth: the depth after each bucket of time; changes: lane, now_ms, delta. Changes are
    summed into buckets before the window, so a lane's window holds buckets, not messages."""
    start = (F.floor(F.col("now_ms") / bucket_ms) * bucket_ms).cast("long")
    summed = changes.groupBy("lane", start.alias("bucket_ms")).agg(F.sum("delta").cast("long").alias("change"))
    window = Window.partitionBy("lane").orderBy("bucket_ms").rowsBetween(Window.unboundedPreceding, 0)
    return summed.withColumn("depth", F.sum("change").over(window))
