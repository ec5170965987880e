"""The folds as stateful processors of Structured Streaming.

Rows of a key come in any order within a micro-batch and are sorted by seq there; across batches seq must not fall.
Stored times are compared in the fold, so nothing depends on the clock of the machine, and late rows aren't dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.config import QueueConfig, Visibility
from tidemill.operators.dedupe import RESULT
from tidemill.operators.journal import numbered, padded
from tidemill.operators.machine import LeaseMachine, QueueMachine
from tidemill.session import ship
from tidemill.sources.schemas import JOURNAL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEDUPE_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
JOURNAL_COLUMNS = [c.split()[0] for c in JOURNAL.split(", ")]


class DedupeProcessor(StatefulProcessor):
    """One anchor (message, time) for each dedupe key."""

    def __init__(self, window_ms: int):
        self.window = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "id string, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.anchor.get() if self.anchor.exists() else None
        out = []
        for r in pd.concat(rows).sort_values("seq", kind="stable").itertuples(index=False):
            dup = held is not None and r.now_ms < held[1] + self.window
            if not dup:
                held = (r.id, int(r.now_ms))
            out.append((r.seq, r.now_ms, key[0], r.id, dup, held[0] if dup else None, r.now_ms - held[1] if dup else None, held[1]))
        self.anchor.update(held)
        yield pd.DataFrame(out, columns=DEDUPE_COLUMNS).astype({"original_age_ms": "Int64"})

    def close(self) -> None:
        pass


class MachineProcessor(StatefulProcessor):
    """A machine of `operators.machine` for each key, kept as bytes."""

    def __init__(self, kind: type, config):
        self.kind, self.config = kind, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "state binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else self.kind(self.config)
        every = pd.concat(rows).sort_values("seq", kind="stable")
        events = []
        for r in every.to_dict("records"):
            row = {k: None if v is None or v is pd.NaT or (not hasattr(v, "__len__") and pd.isna(v)) else v for k, v in r.items()}
            events += numbered(machine, row | {"seq": int(row["seq"]), "now_ms": int(row["now_ms"])})
        self.state.update((pickle.dumps(machine),))
        # plain objects with None: pandas would make nullable integers and booleans floats
        out = pd.DataFrame(events, columns=JOURNAL_COLUMNS, dtype=object)
        yield out.where(out.notna(), None)

    def close(self) -> None:
        pass


def _stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ship(df.sparkSession)
    return df.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="None")


def dedupe_stream(log: DataFrame, window_ms: int) -> DataFrame:
    """`operators.dedupe.windowed` of a stream (seq, now_ms, dedupe_key, id); rows without a key have to go elsewhere."""
    rows = log.where(F.col("dedupe_key").isNotNull()).select("seq", "now_ms", "dedupe_key", F.col("id").cast("string").alias("id"))
    return _stateful(rows, "dedupe_key", DedupeProcessor(window_ms), RESULT)


def lease_stream(commands: DataFrame, config: Visibility) -> DataFrame:
    """`operators.journal.leased` of a stream."""
    return _stateful(padded(commands), "id", MachineProcessor(LeaseMachine, config), JOURNAL)


def queue_stream(commands: DataFrame, config: QueueConfig) -> DataFrame:
    """`operators.journal.replayed` of a stream, one state for each queue."""
    return _stateful(padded(commands), "queue", MachineProcessor(QueueMachine, config), JOURNAL)


def arrivals_stream(log: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Monitoring only: messages of each lane in event-time windows; here rows later than the watermark are dropped."""
    timed = log.withColumn("at", F.timestamp_millis("now_ms")).withWatermark("at", watermark)
    return timed.groupBy(F.window("at", window), "lane").agg(F.count("*").alias("n"))


def write_idempotent(df: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Start writing a stream to folders by batch: a batch that runs again overwrites its own folder only."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
