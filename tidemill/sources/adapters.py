"""Views of the star-schema tables as the engine's relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.config import Scheduling
from tidemill.session import read_table

EVENT_LANES = Scheduling({"critical": 8, "high": 4, "normal": 2, "low": 1}, 64_800_000)
ORDER_LANES = Scheduling({"1-URGENT": 8, "2-HIGH": 4, "3-MEDIUM": 2, "4-NOT SPECIFIED": 1, "5-LOW": 1}, 30 * 86_400_000)


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without zone, rounded down, whatever the session's time zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1000).cast("long")


def enqueue_log(spark: SparkSession, sf_dir: str, key: str = "user") -> DataFrame:
    """seq, now_ms, id, lane, dedupe_key, payload of events, one enqueue each."""
    e = read_table(spark, sf_dir, "events")
    kind = F.col("event_type")
    lane = F.when(kind == "error", "critical").when(kind == "purchase", "high").when(kind.isin("signup", "click"), "normal").otherwise("low")
    user = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("seq"),
        millis(F.col("ts")).alias("now_ms"),
        F.col("event_id").cast("string").alias("id"),
        lane.alias("lane"),
        (user if key == "user" else F.concat(user, F.lit(":"), kind)).alias("dedupe_key"),
        F.col("props").alias("payload"),
    )


def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lane, enqueued_at_ms of orders that wait; (enqueued_at_ms, id) is their position."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("lane"), millis(F.col("o_orderdate")).alias("enqueued_at_ms"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, attempt, consumer_id, claimed_at_ms, outcome (ack, nack or expired) of line items, one delivery attempt each."""
    li = read_table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    outcome = F.when(F.col("l_returnflag") == "N", "ack").when(F.col("l_returnflag") == "R", "nack").otherwise("expired")
    return li.select(
        F.col("l_orderkey").alias("id"),
        F.row_number().over(order).alias("attempt"),
        F.col("l_suppkey").alias("consumer_id"),
        millis(F.col("l_shipdate")).alias("claimed_at_ms"),
        outcome.alias("outcome"),
    )


def delivery_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lane, consumer_id, claimed_at_ms, extensions of line items as claims that never ended; no rank is needed."""
    li = read_table(spark, sf_dir, "lineitem")
    lane = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "normal").otherwise("low")
    return li.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        lane.alias("lane"),
        F.col("l_suppkey").alias("consumer_id"),
        millis(F.col("l_shipdate")).alias("claimed_at_ms"),
        F.pmod(F.col("l_partkey"), F.lit(4)).cast("int").alias("extensions"),
    )
