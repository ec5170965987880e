"""The scheduler over whole tables: every message is selected once, as a fold written from the rule says."""

from collections import Counter, defaultdict

import pytest

from tidemill.plans import catalogue
from tidemill.sources import adapters

WEIGHTS = {"critical": 8, "high": 4, "normal": 2, "low": 1}


@pytest.fixture(scope="module")
def want(spark, sf):
    """(queue, seq, lane, reason, waited_ms) of all events, without the operator or its credits."""
    queues = defaultdict(list)
    for r in adapters.enqueue_log(spark, sf).collect():
        queues[r["dedupe_key"]].append((r["seq"], r["lane"], r["now_ms"]))
    out = []
    for user, rows in queues.items():
        waiting = {x: [t for _, lane, t in sorted(rows) if lane == x] for x in WEIGHTS}
        credit, now = dict.fromkeys(WEIGHTS, 0), max(t for *_, t in rows)
        for i in range(len(rows)):
            now += 60_000
            heads = {x: max(0, now - waiting[x][0]) for x in WEIGHTS if waiting[x]}
            worst = max(heads.values())
            if len(heads) == 1:
                reason, lane = "only_nonempty", next(iter(heads))
            elif worst > 64_800_000:
                reason, lane = "starvation_override", next(x for x in heads if heads[x] == worst)
            else:
                reason = "weighted"
                for x in heads:
                    credit[x] += WEIGHTS[x]
                lane = max(heads, key=lambda x: (credit[x], WEIGHTS[x]))
                credit[lane] -= 15
            waiting[lane].pop(0)
            out.append((user, i + 1, lane, reason, heads[lane]))
    return out


def test_all_events_are_selected(spark, sf, want):
    rows = catalogue.QUERIES["scheduler_with_override_users"](spark, sf).collect()
    assert len(rows) == len(want) == spark.read.parquet(f"{sf}/events.parquet").count() > 300
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_shares_are_of_all_events(spark, sf, want):
    lane, over = Counter(x[2] for x in want), Counter(x[2] for x in want if x[3] == "starvation_override")
    got = {r["lane"]: r for r in catalogue.QUERIES["observed_share_users"](spark, sf).collect()}
    assert {x: (r["selections"], r["overrides"]) for x, r in got.items()} == {x: (lane[x], over[x]) for x in WEIGHTS}
    for r in catalogue.QUERIES["share_distortion_users"](spark, sf).collect():
        assert abs(r["observed_share"] - lane[r["lane"]] / len(want)) < 1e-12
        assert abs(r["distortion"] - (lane[r["lane"]] / len(want) - WEIGHTS[r["lane"]] / 15)) < 1e-12
    after = Counter(x[2] for x in want if x[1] > 5)
    assert {r["lane"]: r["selections"] for r in catalogue.QUERIES["selections_since_reset_users"](spark, sf).collect()} == dict(after)
