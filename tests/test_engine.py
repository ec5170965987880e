"""DataFrame operators against the plain transition functions, and batch against stream."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.config import Dedupe, QueueConfig, Scheduling, Visibility
from tidemill.functions import hashing
from tidemill.operators import dedupe, journal, lanes, leases, retries
from tidemill.operators.machine import Seen
from tidemill.sources import readers
from tidemill.sources.schemas import COMMANDS
from tidemill.streaming import processors

CONFIG = QueueConfig(Scheduling({"a": 2, "b": 1}, 500), Visibility(60, 1), Dedupe(100), 2)


def random_log(n=400, keys=6, back=True):
    rnd, now, rows = random.Random(3), 0, []
    for seq in range(n):
        now += rnd.randint(-5 if back else 0, 30)
        rows.append((seq, now, f"m{seq}", f"k{rnd.randrange(keys)}" if rnd.random() < 0.95 else None))
    return rows


def random_commands(n=500, queues=2):
    rnd, now, rows = random.Random(5), 0, []
    for seq in range(n):
        now += rnd.randint(0, 20)
        op = rnd.choice(["enqueue", "enqueue", "claim", "claim", "ack", "nack", "heartbeat", "reap", "replay", "dead_letter", "forget", "bogus"])
        i = f"m{rnd.randrange(seq // 4 + 1)}"
        rows.append((f"q{rnd.randrange(queues)}", seq, now, op, f"m{seq // 4}" if op == "enqueue" else i, rnd.choice("abz") if op == "enqueue" else None, f"c{rnd.randrange(2)}", f"k{rnd.randrange(9)}" if rnd.random() < 0.7 else None, f"p{seq}", "why", [i]))
    return rows


@pytest.mark.parametrize("back", [False, True])
def test_dedupe_plans_agree_with_the_plain_fold(spark, back):
    rows = random_log(back=back)
    log = spark.createDataFrame(rows, "seq long, now_ms long, id string, dedupe_key string").repartition(3)
    seen, want, held = {}, {}, {}
    for seq, now, i, key in rows:
        if key is None:
            want[seq] = (False, None, None)
            continue
        if key in held and now < held[key][1] + 100:
            want[seq] = (True, held[key][0], now - held[key][1])
        else:
            held[key] = (i, now)
            want[seq] = (False, None, None)
    got = {r["seq"]: (r["duplicate"], r["original_id"], r["original_age_ms"]) for r in dedupe.windowed(log, 100).collect()}
    assert got == want
    native = {r["seq"]: (r["duplicate"], r["original_id"], r["original_age_ms"]) for r in dedupe.windowed_native(log, 100).collect()}
    assert native == {s: w for s, w in want.items() if rows[s][3] is not None}
    if not back:  # global eviction and per-key anchors agree when time doesn't fall
        s = Seen(Dedupe(100))
        assert {seq: s.check(key, i, now)[:3] for seq, now, i, key in rows if key is not None} == native
        ev = dedupe.evictions(dedupe.windowed(log, 100), 100).first()
        assert (ev["evicted"], ev["tracked_keys"]) == (s.totals["evicted"], len(s.anchors))
    assert not seen


def test_dedupe_of_nothing(spark):
    log = spark.createDataFrame([], "seq long, now_ms long, id string, dedupe_key string")
    assert dedupe.windowed(log, 100).count() == 0
    assert dedupe.statistics(dedupe.windowed(log, 100)).first()["duplicate_rate"] == 0.0


def test_dedupe_needs_little_memory_for_a_hot_key(spark):
    log = spark.range(200_000).select(F.col("id").alias("seq"), F.floor(F.col("id") / 3).alias("now_ms"), F.col("id").cast("string").alias("id"), F.lit("hot").alias("dedupe_key"))
    assert dedupe.windowed(log, 1000).where("not duplicate").count() == 67


def test_bloom_diagnostics_golden(spark):
    rows = [("a", "m1", 0), ("a", "m2", 999), ("a", "m3", 1000), ("a", "m4", 1999), ("b", "m5", 1999), ("a", "m6", 2000)]
    log = spark.createDataFrame([(i, t, m, k) for i, (k, m, t) in enumerate(rows)], "seq long, now_ms long, id string, dedupe_key string")
    r = dedupe.diagnostics(log, Dedupe(1000)).first()
    assert (r["checked"], r["duplicates"], r["evicted"], r["tracked_keys"], r["false_positives"], r["observed_rate"], r["bloom_bytes"]) == (6, 2, 2, 2, 1, 0.25, 119_814)
    assert dedupe.diagnostics(log.limit(0), Dedupe(1000)).count() == 0


def test_hash_vectors(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "s string").select("s", hashing.fnv1a(F.col("s")).alias("f"), hashing.djb2(F.col("s")).alias("d")).collect()
    assert [(r["f"], r["d"]) for r in rows[:3]] == [(2166136261, 5381), (0xE40C292C, 177670), (0xBF9CF968, 4259602622)]
    one = spark.range(1).select(hashing.estimated_rate(F.lit(100), F.lit(3), F.lit(0)).alias("r")).first()
    assert one["r"] == 0.0


def test_journal_is_the_machines_log(spark):
    from tidemill.operators.machine import QueueMachine

    rows = random_commands()
    names = [c.split()[0] for c in COMMANDS.split(", ")]
    machines, want = {}, []
    for r in rows:
        row = dict(zip(names, r, strict=True))
        machine = machines.setdefault(row["queue"], QueueMachine(CONFIG))
        want += [(e["queue"], e["seq"], e["n"], e["event"], e["id"], e.get("reason")) for e in journal.numbered(machine, row)]
    log = journal.replayed(spark.createDataFrame(rows, COMMANDS).repartition(5), CONFIG).cache()
    got = [tuple(r) for r in log.orderBy("queue", "seq", "n").select("queue", "seq", "n", "event", "id", "reason").collect()]
    assert got == sorted(want, key=lambda x: x[:3])
    waiting = {(r["queue"], r["lane"]): r["waiting"] for r in journal.lane_balance(log).collect() if r["lane"] in ("a", "b")}
    stats = {r["queue"]: r for r in journal.queue_stats(log, CONFIG.lanes).collect()}
    for q, m in machines.items():
        assert stats[q]["depth_by_lane"] == {x: m.depth(x) for x in m.lanes}
        at = m.conservation()
        assert (stats[q]["total_depth"], stats[q]["in_flight"], stats[q]["dead_letters"]) == (at["waiting"], at["in_flight"], at["dead"])
    assert waiting == {(q, x): m.depth(x) for q, m in machines.items() for x in m.lanes}
    assert journal.dead_letters(log).count() == log.where("event = 'dead'").count() > 0
    assert journal.outcomes(log).count() == len({(w[0], w[1]) for w in want})
    # an id's claims and releases alternate, so two claims are never open at once
    open_ = F.sum(F.when(F.col("event") == "claimed", 1).otherwise(-1)).over(Window.partitionBy("queue", "id").orderBy("seq", "n"))
    assert log.where("event in ('claimed', 'released')").withColumn("open", open_).where("open not in (0, 1)").count() == 0
    assert journal.claims(log).count() - journal.releases(log).count() == sum(m.conservation()["in_flight"] for m in machines.values())
    log.unpersist()


def run_stream(spark, tmp_path, rows, schema, make, chunk=120):
    src = tmp_path / "in"
    for i in range(0, len(rows), chunk):
        spark.createDataFrame(rows[i : i + chunk], schema).coalesce(1).write.mode("append").parquet(str(src / f"part={i:06d}"))
    out = []
    for i in range(0, len(rows), chunk):  # one micro-batch after the other, in order
        import shutil

        shutil.copytree(src / f"part={i:06d}", tmp_path / "live", dirs_exist_ok=True)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "live"))
        processors.write_idempotent(make(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    return out


def test_dedupe_stream_equals_batch(spark, tmp_path):
    rows = [r for r in random_log(240) if r[3] is not None]
    schema = "seq long, now_ms long, id string, dedupe_key string"
    out = run_stream(spark, tmp_path, rows, schema, lambda s: processors.dedupe_stream(s, 100))
    batch = dedupe.windowed(spark.createDataFrame(rows, schema), 100)
    assert sorted(map(str, out.select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_queue_stream_equals_batch(spark, tmp_path):
    rows = random_commands(240)
    out = run_stream(spark, tmp_path, rows, COMMANDS, lambda s: processors.queue_stream(s, CONFIG))
    batch = journal.replayed(spark.createDataFrame(rows, COMMANDS), CONFIG)
    assert sorted(map(str, out.select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_snapshots(spark):
    claims = spark.createDataFrame([("m1", "hi", "c1", 100, 1, 0, 0, 0), ("m2", "hi", "c2", 150, 1, 2, 50, 1), ("m3", "lo", "c1", 90, 2, 1, 1, 2)], "id string, lane string, consumer_id string, deadline_ms long, attempt int, extensions int, claimed_at_ms long, ins_ord long")
    v = Visibility(100, 2)
    assert [(r["id"], r["held_for_ms"]) for r in leases.expired(claims, 100).collect()] == [("m1", 100), ("m3", 99)]
    assert leases.live(claims, 100).count() == 1
    assert tuple(leases.statistics(claims, 90, v).first()) == (3, 2, 1)
    assert tuple(leases.statistics(claims, 90, Visibility(100, 0)).first()) == (3, 2, 3)
    got = {(r["lane"], r["consumer_id"]): r["claims"] for r in leases.by_lane_and_consumer(claims).collect()}
    assert got == {(None, None): 3, ("hi", None): 2, ("lo", None): 1, (None, "c1"): 2, (None, "c2"): 1}


def test_lane_states_show_empty_lanes_and_heads(spark):
    s = Scheduling({"a": 2, "b": 1, "c": 1}, 60)
    frame = readers.lanes_frame(spark, s)
    messages = spark.createDataFrame([("a", 1, 90), ("a", 2, 10), ("b", 1, 39)], "lane string, pos int, enqueued_at_ms long")
    states = lanes.states(messages, frame, ["pos"])
    assert {r["lane"]: (r["depth"], r["oldest_enqueued_at_ms"]) for r in states.collect()} == {"a": (2, 90), "b": (1, 39), "c": (0, None)}
    assert [tuple(r) for r in lanes.violations(states, 100, 60).collect()] == [("b", 61, 1)]
    assert [tuple(r) for r in lanes.starving_pick(states, 100, 60).collect()] == [("b", 61)]
    alone = lanes.states(messages.where("lane = 'b'"), frame, ["pos"])
    assert lanes.starving_pick(alone, 100, 60).count() == 0 and lanes.violations(alone, 100, 60).count() == 1
    none = spark.createDataFrame([], "lane string, reason string")
    assert {r["observed_share"] for r in lanes.observed_share(none, frame).collect()} == {0.0}


def test_replay_takes_the_nth(spark):
    dead = spark.createDataFrame([("x", 1), ("x", 5), ("y", 2)], "id string, ord int")
    asked = spark.createDataFrame([(1, "x"), (2, "z"), (3, "x"), (4, "x")], "place int, id string")
    taken, left = retries.replayed(dead, asked)
    assert sorted((r["id"], r["ord"]) for r in taken.collect()) == [("x", 1), ("x", 5)]
    assert [(r["id"], r["ord"]) for r in left.collect()] == [("y", 2)]


def test_assignment_moves_only_what_it_must(spark):
    members = lambda *m: spark.createDataFrame([(x,) for x in m], "member string")
    parts = spark.range(10).withColumnRenamed("id", "partition")
    none = spark.createDataFrame([], "partition long, member string")
    old = retries.assigned(members("a", "b", "c"), parts, none)
    assert sorted(r["count"] for r in old.groupBy("member").count().collect()) == [3, 3, 4]
    new = retries.assigned(members("a", "b", "c", "d"), parts, old)
    assert new.count() == 10 and new.join(old, ["partition", "member"]).count() == 8
    gone = retries.assigned(members("a", "b"), parts, old)
    kept = old.where("member in ('a', 'b')").count()
    assert gone.join(old, ["partition", "member"]).count() == kept
    diff = {r["member"]: (len(r["assigned"]), len(r["revoked"])) for r in retries.moves(old, new).collect()}
    assert diff["d"] == (2, 0) and sum(x for x, _ in diff.values()) == sum(y for _, y in diff.values()) == 2


def test_readers(spark, tmp_path):
    rows = random_commands(20)
    df = spark.createDataFrame(rows, COMMANDS)
    for fmt in ("parquet", "json", "orc"):
        readers.write_relation(df, str(tmp_path / fmt), fmt)
        assert readers.read_commands(spark, str(tmp_path / fmt), fmt).count() == 20
    df.withColumn("ids", F.concat_ws(" ", "ids")).write.csv(str(tmp_path / "csv"), header=True)
    assert sorted(map(str, readers.read_commands(spark, str(tmp_path / "csv"), "csv").collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError, match="unknown format"):
        readers.read_commands(spark, "x", "xml")


def test_dedupe_with_a_falling_clock(spark):
    """Each message's time evicts the anchors of all keys, so a clock that falls can let a repeat through."""
    from tidemill.operators import dedupe

    rnd = random.Random(5)
    log = [(1, 0, "A", "m1"), (2, 20, "B", "m2"), (3, 5, "A", "m3"), (4, 6, None, "m4")]
    log += [(5 + i, rnd.randint(0, 60), rnd.choice("ABCDE"), f"n{i}") for i in range(300)]
    anchors, want = {}, []
    for seq, now, key, id_ in log:
        if key is None:
            want.append((seq, False, None))
            continue
        anchors = {k: v for k, v in anchors.items() if now - v[1] < 10}
        want.append((seq, key in anchors, anchors[key][0] if key in anchors else None))
        anchors.setdefault(key, (id_, now))
    df = spark.createDataFrame(log, "seq long, now_ms long, dedupe_key string, id string").repartition(4)
    assert dedupe.clock_falls(df) and not dedupe.clock_falls(df.where("seq < 3"))
    got = sorted((r["seq"], r["duplicate"], r["original_id"]) for r in dedupe.windowed_any(df, 10).collect())
    assert got == want and got[2] == (3, False, None)
    rising = df.withColumn("now_ms", F.col("seq"))
    assert not dedupe.clock_falls(rising)
    assert sorted(map(tuple, dedupe.windowed_any(rising, 10).collect())) == sorted(map(tuple, dedupe.windowed(rising, 10).collect()))
