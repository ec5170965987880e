"""Golden scenarios and properties of the transition functions, without Spark."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.config import Dedupe, QueueConfig, Scheduling, Visibility
from tidemill.operators.machine import Bloom, Leases, QueueMachine, Seen
from tidemill.operators.scheduling import Credits, period

WEIGHTS = Scheduling({"critical": 8, "high": 4, "normal": 2, "low": 1}, 60)


def cmd(op, now, **more):
    return {"queue": "q", "seq": 0, "now_ms": now, "op": op, "id": None, "lane": None, "consumer_id": None, "dedupe_key": None, "payload": None, "reason": None, "ids": None} | more


def test_dedupe_golden():
    seen = Seen(Dedupe(1000), diagnostics=True)
    got = [seen.check(k, m, t) for k, m, t in [("a", "m1", 0), ("a", "m2", 999), ("a", "m3", 1000), ("a", "m4", 1999), ("b", "m5", 1999), ("a", "m6", 2000)]]
    new = (False, None, None, False)
    assert got == [new, (True, "m1", 999, False), new, (True, "m3", 999, False), new, (False, None, None, True)]
    r = seen.report()
    assert (r["checked"], r["duplicates"], r["evicted"], r["tracked_keys"], r["false_positives"], r["observed_rate"]) == (6, 2, 2, 2, 1, 0.25)


def test_dedupe_forget_and_disabled():
    seen = Seen(Dedupe(1000))
    seen.check("a", "m1", 0)
    assert seen.forget("a") and not seen.forget("a")
    assert not seen.check("a", "m2", 1)[0]
    off = Seen(Dedupe(1000, enabled=False))
    assert off.check("a", "x", 0) == off.check("a", "x", 0) == (False, None, None, False)
    assert off.report()["checked"] == 0


def test_bloom_sizes():
    for n, p, bits, k, size in [(100_000, 0.01, 958_506, 7, 119_814), (1000, 0.01, 9586, 7, 1199), (10, 0.5, 15, 1, 2), (100_000, 1e-9, 2_875_518, 20, 359_440)]:
        b = Bloom(Dedupe(1, expected_keys=n, false_positive_rate=p))
        assert (b.size, b.hashes, len(b.bits)) == (bits, k, size)
    assert b.estimate() == 0.0


def test_lease_ladder():
    x = Leases(Visibility(100, 2))
    assert x.claim("m1", "l", "c1", 1, 0)["deadline"] == 100
    assert x.extend("m2", "c1", 0)[0] == "NOT_CLAIMED"
    assert x.extend("m1", "c2", 50)[0] == "WRONG_CONSUMER"
    assert x.extend("m1", "c1", 50)[1]["deadline"] == 150
    assert x.extend("m1", "c1", 149)[1]["deadline"] == 249
    assert x.extend("m1", "c1", 200)[0] == "EXTENSION_CAP_REACHED"
    assert x.claim("m1", "l", "c2", 1, 248) is None
    again = x.claim("m1", "l", "c2", 1, 249)
    assert (again["deadline"], again["attempt"], again["extensions"]) == (349, 2, 0)
    assert x.extend("m1", "c2", 349)[0] == "ALREADY_EXPIRED"
    assert x.release("m1", "c2")["since"] == 249  # late, but not reaped
    assert x.release("m1", "c2") is None


def test_reap_is_in_order_of_first_claim():
    x = Leases(Visibility(100, 1))
    for i, now in (("a", 0), ("b", 1), ("c", 2)):
        x.claim(i, "l", "w", 1, now)
    x.extend("a", "w", 50)
    assert [h["id"] for h in x.reap(102)] == ["b", "c"]
    assert [h["id"] for h in x.reap(150)] == ["a"]


def test_period():
    assert [x[0] for x in period(WEIGHTS)] == list("chcnchclchcnchc")


def test_subset_shares_and_debt():
    c = Credits(WEIGHTS)
    got = Counter(c.pick(["high", "low"]) for _ in range(300))
    assert got == {"high": 180, "low": 120}
    assert (c.credit["high"], c.credit["low"]) == (-1500, -1500)
    run = [c.pick(WEIGHTS.weights) for _ in range(800)]
    assert (run.index("high") + 1, run.index("low") + 1) == (234, 758)


def test_override_takes_the_oldest_and_is_strict():
    c = Credits(WEIGHTS)
    assert c.select({"critical": 90, "normal": 39, "low": 40}, 100) == ("normal", "starvation_override", 61)
    assert c.select({"low": 0}, 100) == ("low", "only_nonempty", 100)
    assert c.select({}, 100) is None
    assert c.select({"high": 200, "low": 300}, 100)[1:] == ("weighted", 0)
    assert c.select({"high": 0, "low": 0}, 100) == ("high", "starvation_override", 100)


def test_queue_golden():
    q = QueueMachine(QueueConfig(Scheduling({"hi": 2, "lo": 1}, 10_000), Visibility(100, 0), None, 2))
    do = lambda op, now, **more: [(e["event"], e["id"], e.get("attempt"), e.get("reason")) for e in q.step(cmd(op, now, **more))]
    do("enqueue", 0, id="A", lane="hi", payload="pa")
    do("enqueue", 0, id="B", lane="lo")
    assert do("claim", 10, consumer_id="c1") == [("selected", None, None, "weighted"), ("claimed", "A", 1, None)]
    assert q.credits.credit == {"hi": -1, "lo": 1}
    assert do("claim", 20, consumer_id="c2")[0][3] == "only_nonempty"
    assert do("ack", 50, id="B", consumer_id="c2")[0][:2] == ("released", "B")
    assert do("nack", 60, id="A", consumer_id="c2", reason="x")[0][0] == "refused"
    assert [e[0] for e in do("claim", 110, consumer_id="c1")] == ["released", "requeued", "selected", "claimed"]
    assert do("heartbeat", 150, id="A", consumer_id="c1")[0][3] == "EXTENSION_CAP_REACHED"
    last = list(q.step(cmd("claim", 210, consumer_id="c2")))
    assert [e["event"] for e in last] == ["released", "dead", "empty"]
    assert last[1]["unknown"] and last[1]["payload"] == "pa" and last[1]["attempt"] == 2
    assert do("replay", 220, ids=["A", "A"]) == [("replayed", "A", 1, None)]
    assert q.conservation() == {"waiting": 1, "in_flight": 0, "dead": 0}


def test_contended_message_stays_at_the_head():
    q = QueueMachine(QueueConfig(Scheduling({"a": 1, "b": 1}, 10_000), Visibility(100, 0)))
    for i in ("x", "x", "y"):
        list(q.step(cmd("enqueue", 0, id=i, lane="a")))
    assert [e["event"] for e in q.step(cmd("claim", 1, consumer_id="c"))] == ["selected", "claimed"]
    second = list(q.step(cmd("claim", 2, consumer_id="d")))
    assert [e["event"] for e in second] == ["selected", "contended"] and second[1]["amount_ms"] == 99
    assert q.depth("a") == 2


def test_unknown_lanes():
    for compat, event, left in ((False, "rejected", 1), (True, "dropped", 0)):
        q = QueueMachine(QueueConfig(Scheduling({"a": 1}, 10), Visibility(100, 0), None, 1, compat))
        assert [e["event"] for e in q.step(cmd("enqueue", 0, id="x", lane="zz"))] == ["rejected"]
        list(q.step(cmd("enqueue", 0, id="x", lane="a")))
        list(q.step(cmd("claim", 0, consumer_id="c")))
        assert [e["event"] for e in q.step(cmd("nack", 1, id="x", consumer_id="c", reason="no"))] == ["released", "dead"]
        assert [e["event"] for e in q.step(cmd("replay", 2, ids=["x"], lane="zz"))] == [event]
        assert q.conservation()["dead"] == left


def test_replay_forgets_the_key_unless_compat():
    for compat in (False, True):
        q = QueueMachine(QueueConfig(Scheduling({"a": 1}, 10), Visibility(100, 0), Dedupe(10**9), 1, compat))
        list(q.step(cmd("enqueue", 0, id="x", lane="a", dedupe_key="k")))
        list(q.step(cmd("claim", 0, consumer_id="c")))
        list(q.step(cmd("nack", 1, id="x", consumer_id="c", reason="no")))
        list(q.step(cmd("replay", 2, ids=["x"])))
        again = [e["event"] for e in q.step(cmd("enqueue", 3, id="y", lane="a", dedupe_key="k"))]
        assert again == (["duplicate"] if compat else ["enqueued"])


ops = st.lists(
    st.tuples(st.sampled_from(["enqueue", "claim", "ack", "nack", "heartbeat", "reap", "replay"]), st.integers(0, 40), st.integers(0, 12), st.sampled_from("abz"), st.integers(0, 2), st.integers(0, 3)),
    max_size=120,
)


@settings(max_examples=150, deadline=None)
@given(ops)
def test_conservation(steps):
    q = QueueMachine(QueueConfig(Scheduling({"a": 2, "b": 1}, 50), Visibility(20, 1), Dedupe(60), 2))
    now, serial = 0, 0
    count = Counter()
    for op, dt, i, lane, who, key in steps:
        now += dt
        serial += op == "enqueue"
        c = cmd(op, now, id=f"m{serial if op == 'enqueue' else i}", lane=lane if op == "enqueue" else None, consumer_id=f"c{who}", dedupe_key=f"k{key}" if op == "enqueue" and key else None, reason="r", ids=[f"m{i}"])
        for e in q.step(c):
            count[e["event"]] += 1
            if e["event"] == "released" and e["reason"] == "ack":
                count["acked"] += 1
            if e["event"] == "claimed":
                assert e["deadline_ms"] <= now + q.config.visibility.max_hold_ms
    at = q.conservation()
    assert count["enqueued"] == sum(at.values()) + count["acked"] + count["dropped"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30)), max_size=80))
def test_accepted_anchors_are_a_window_apart(rows):
    seen, now, anchors = Seen(Dedupe(50)), 0, {}
    for i, (key, dt) in enumerate(rows):
        now += dt
        dup, first, age, _ = seen.check(key, str(i), now)
        if dup:
            assert 0 <= age < 50 and anchors[key][0] == first
        else:
            assert key not in anchors or now >= anchors[key][1] + 50
            anchors[key] = (str(i), now)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200))
def test_credit_is_conserved_when_all_wait(n):
    c = Credits(WEIGHTS)
    for _ in range(n):
        c.pick(WEIGHTS.weights)
    assert sum(c.credit.values()) == 0
