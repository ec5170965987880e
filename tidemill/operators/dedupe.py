"""Windowed dedupe, anchored at the first message of a key that is accepted.

A message is a duplicate if its key's anchor is less than a window before it; else it is accepted and becomes the anchor.
The recurrence runs along each key in order of seq. Two plans give it: `windowed` streams each key's sorted rows
through a fold with one anchor as its state, whatever the key's size; `windowed_native` stays in the JVM for keys of
bounded size. Both need a clock that never falls along seq, as each message's time evicts the anchors of all keys; `windowed_any`
checks that and, where the clock falls, folds the whole log in one order, which is the only one that then tells what
was evicted when.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.config import Dedupe
from tidemill.operators.folds import fold_sorted
from tidemill.operators.machine import Seen
from tidemill.session import ship

RESULT = "seq long, now_ms long, dedupe_key string, id string, duplicate boolean, original_id string, original_age_ms long, anchor_ms long"


class Anchors:
    """The accepted messages of a key's rows, vectorised over runs of monotone times."""

    def __init__(self, window: int):
        self.window, self.key, self.anchor, self.original, self.begun = window, None, 0, None, False

    def run(self, key, ms: np.ndarray, ids: list) -> tuple[np.ndarray, list, np.ndarray]:
        """For rows of one key in order: duplicate, original id, anchor."""
        n = len(ms)
        duplicate, anchors = np.zeros(n, bool), np.zeros(n, np.int64)
        originals: list = [None] * n
        if not self.begun or key != self.key:
            self.key, self.begun, self.original = key, True, None
        monotone = n < 2 or bool((ms[1:] >= ms[:-1]).all())
        i = 0
        while i < n:
            if self.original is not None and ms[i] < self.anchor + self.window:
                j = int(np.searchsorted(ms, self.anchor + self.window, "left")) if monotone else i + 1
                duplicate[i:j], anchors[i:j] = True, self.anchor
                originals[i:j] = [self.original[0]] * (j - i)
                i = j
            else:
                self.anchor, self.original = int(ms[i]), (ids[i],)
                anchors[i] = self.anchor
                i += 1
        return duplicate, originals, anchors


def windowed(log: DataFrame, window_ms: int) -> DataFrame:
    """seq, now_ms, dedupe_key, id, duplicate, original_id, original_age_ms, anchor_ms for every row of `log` (seq, now_ms,
    dedupe_key, id). A row without a key is accepted and is no anchor."""
    ship(log.sparkSession)
    rows = log.select("seq", "now_ms", "dedupe_key", F.col("id").cast("string").alias("id"))
    keyed = rows.where(F.col("dedupe_key").isNotNull()).repartition("dedupe_key").sortWithinPartitions("dedupe_key", "seq")

    def run(batches):
        fold = Anchors(window_ms)
        for batch in batches:
            if not len(batch):
                continue
            codes = batch.column("dedupe_key").dictionary_encode()
            code = np.asarray(codes.indices)
            names = codes.dictionary.to_pylist()
            ms, ids = np.asarray(batch.column("now_ms")), batch.column("id").to_pylist()
            cuts = np.r_[0, np.flatnonzero(np.diff(code)) + 1, len(batch)]
            parts = [fold.run(names[code[a]], ms[a:b], ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            duplicate = np.concatenate([p[0] for p in parts])
            originals = [x for p in parts for x in p[1]]
            anchor = np.concatenate([p[2] for p in parts])
            age = pa.array(ms - anchor, pa.int64(), mask=~duplicate)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("seq", "now_ms", "dedupe_key", "id")], pa.array(duplicate), pa.array(originals, pa.string()), age, pa.array(anchor)], [c.split()[0] for c in RESULT.split(", ")])

    free = rows.where(F.col("dedupe_key").isNull())
    free = free.select("*", F.lit(False).alias("duplicate"), F.lit(None).cast("string").alias("original_id"), F.lit(None).cast("long").alias("original_age_ms"), F.lit(None).cast("long").alias("anchor_ms"))
    return keyed.mapInArrow(run, RESULT).unionByName(free)


def clock_falls(log: DataFrame) -> bool:
    """Whether now_ms is ever less than at an earlier seq, by (least seq, first, last, whether it falls) of each sorted part."""
    ship(log.sparkSession)

    def run(batches):
        first = last = least = None
        falls = False
        for batch in batches:
            ms = np.asarray(batch.column("now_ms"))
            if len(ms):
                falls |= bool((ms[1:] < ms[:-1]).any()) or (last is not None and ms[0] < last)
                least, first, last = (batch.column("seq")[0].as_py(), int(ms[0]), int(ms[-1])) if first is None else (least, first, int(ms[-1]))
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"seq": least, "first": first, "last": last, "falls": falls}])

    spread = log.select("seq", "now_ms").repartitionByRange("seq").sortWithinPartitions("seq")
    parts = sorted(spread.mapInArrow(run, "seq long, first long, last long, falls boolean").collect())
    return any(p["falls"] for p in parts) or any(b["first"] < a["last"] for a, b in zip(parts, parts[1:], strict=False))


def windowed_any(log: DataFrame, window_ms: int) -> DataFrame:
    """`windowed`, whatever the clock does: a log whose clock falls is folded in one task, with only the anchors as its state."""
    if not clock_falls(log):
        return windowed(log, window_ms)
    rows = log.select("seq", "now_ms", "dedupe_key", F.col("id").cast("string").alias("id"), F.lit(0).alias("all"))

    def step(seen: Seen, row: dict):
        out = {c: row[c] for c in ("seq", "now_ms", "dedupe_key", "id")}
        if row["dedupe_key"] is None:
            yield out | {"duplicate": False, "original_id": None, "original_age_ms": None, "anchor_ms": None}
            return
        duplicate, original, age, _ = seen.check(row["dedupe_key"], row["id"], row["now_ms"])
        yield out | {"duplicate": duplicate, "original_id": original, "original_age_ms": age, "anchor_ms": row["now_ms"] - (age or 0)}

    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RESULT.split(", ")])
    return fold_sorted(rows, "all", ["seq"], lambda _: Seen(Dedupe(window_ms)), step, RESULT, lambda out: pa.RecordBatch.from_pylist(out, arrow))


def windowed_native(log: DataFrame, window_ms: int) -> DataFrame:
    """The same in one JVM expression a key: sort, fold, explode. For keys of at most some thousand rows, as appending to
    the fold's array is quadratic in a key's rows."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "now_ms", F.col("id").cast("string").alias("id"))))
    item = "struct<seq:bigint,now_ms:bigint,id:string,anchor:bigint,original:string,duplicate:boolean>"

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        again = F.coalesce(x["now_ms"] < last["anchor"] + window_ms, F.lit(False))
        one = F.struct(
            x["seq"].alias("seq"), x["now_ms"].alias("now_ms"), x["id"].alias("id"), F.when(again, last["anchor"]).otherwise(x["now_ms"]).alias("anchor"),
            F.when(again, last["original"]).otherwise(x["id"]).alias("original"), again.alias("duplicate"),
        )
        return F.concat(acc, F.array(one).cast(f"array<{item}>"))

    folded = log.where(F.col("dedupe_key").isNotNull()).groupBy("dedupe_key").agg(F.aggregate(rows, F.array().cast(f"array<{item}>"), step).alias("xs"))
    x = folded.select("dedupe_key", F.explode("xs").alias("x")).select("dedupe_key", "x.*")
    dup = F.col("duplicate")
    return x.select(
        "seq", "now_ms", "dedupe_key", "id", "duplicate", F.when(dup, F.col("original")).alias("original_id"),
        F.when(dup, F.col("now_ms") - F.col("anchor")).alias("original_age_ms"), F.col("anchor").alias("anchor_ms"),
    )


def original_by_range(log: DataFrame, accepted: DataFrame, window_ms: int) -> DataFrame:
    """The accepted message in whose window each message of `log` lies: a range join (anchor <= time < anchor + window).

    Time is cut into buckets of a window's length, so an anchor concerns two buckets and the join is by (key, bucket): a
    hot key is spread over its buckets, and nothing is compared beyond a window.
    """
    bucket = lambda c: F.floor(c / window_ms).cast("long")
    anchors = accepted.select("dedupe_key", F.col("now_ms").alias("anchor_ms"), F.col("seq").alias("anchor_seq"), F.col("id").alias("original_id"))
    first = bucket(F.col("anchor_ms"))
    anchors = anchors.withColumn("bucket", F.explode(F.array(first, first + 1)))
    rows = log.select("seq", "now_ms", "dedupe_key", F.col("id").cast("string").alias("id")).withColumn("bucket", bucket(F.col("now_ms")))
    met = rows.join(anchors, ["dedupe_key", "bucket"]).where((F.col("anchor_ms") <= F.col("now_ms")) & (F.col("now_ms") < F.col("anchor_ms") + window_ms) & (F.col("anchor_seq") <= F.col("seq")))
    return met.select("seq", "id", "dedupe_key", "original_id", (F.col("now_ms") - F.col("anchor_ms")).alias("original_age_ms"))


DIAGNOSTICS = (
    "queue string, checked long, duplicates long, duplicate_rate double, tracked_keys long, evicted long, configured_rate double, "
    "skip_rate double, false_positives long, observed_rate double, bloom_bytes long, oversaturated boolean"
)


def diagnostics(log: DataFrame, config: Dedupe, queue: str | None = None) -> DataFrame:
    """One row a queue: the counters of dedupe with its bloom filter, which never changes what is a duplicate. The filter's
    history runs over all keys, so a queue's checks are folded in one order."""
    ship(log.sparkSession)
    names = [c.split()[0] for c in DIAGNOSTICS.split(", ")]
    key = F.col(queue) if queue else F.lit("all")
    rows = log.where(F.col("dedupe_key").isNotNull()).select(key.cast("string").alias("queue"), "seq", "now_ms", "dedupe_key", F.col("id").cast("string").alias("id"))

    def run(batches):
        current, seen, out = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if seen is None or r["queue"] != current:
                    if seen is not None:
                        out.append({"queue": current} | seen.report())
                    current, seen = r["queue"], Seen(config, diagnostics=True)
                seen.check(r["dedupe_key"], r["id"], r["now_ms"])
        if seen is not None:
            out.append({"queue": current} | seen.report())
        yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out], schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in DIAGNOSTICS.split(", "))])
    return rows.repartition("queue").sortWithinPartitions("queue", "seq").mapInArrow(run, DIAGNOSTICS)


def evictions(results: DataFrame, window_ms: int) -> DataFrame:
    """One row: accepted, evicted, tracked keys after the last check, for times that never fall and no forgotten keys."""
    keyed = results.where(F.col("dedupe_key").isNotNull())
    last = keyed.agg(F.max("now_ms").alias("last_ms"))
    accepted = keyed.where(~F.col("duplicate")).select("anchor_ms")
    gone = F.count_if(F.col("anchor_ms") + window_ms <= F.col("last_ms"))
    return accepted.join(F.broadcast(last)).agg(F.count("*").alias("accepted"), gone.alias("evicted")).withColumn("tracked_keys", F.col("accepted") - F.col("evicted"))


def statistics(results: DataFrame) -> DataFrame:
    """One row: checked, duplicates, duplicate_rate."""
    counts = results.where(F.col("dedupe_key").isNotNull()).agg(F.count("*").alias("checked"), F.count_if("duplicate").alias("duplicates"))
    return counts.withColumn("duplicate_rate", F.coalesce(F.try_divide(F.col("duplicates").cast("double"), F.col("checked")), F.lit(0.0)))


def key_report(results: DataFrame) -> DataFrame:
    """For each key: messages, accepted, duplicates, the greatest age of a duplicate."""
    return results.groupBy("dedupe_key").agg(F.count("*").alias("messages"), F.count_if(~F.col("duplicate")).alias("accepted"), F.count_if("duplicate").alias("duplicates"), F.max("original_age_ms").alias("max_age_ms"))
