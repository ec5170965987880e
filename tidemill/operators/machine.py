"""The transition function of a queue: one command in, events out. Batch folds and streaming processors share it.

State is plain data (lists, dicts, numbers), so that it can be kept in a state store. Time comes with each command; it
may go backwards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count
from math import ceil, exp, floor, log

from tidemill.config import Dedupe, QueueConfig, Visibility
from tidemill.operators.scheduling import Credits


class Bloom:
    """The diagnostic filter with the exact hashes, over UTF-16 code units."""

    def __init__(self, config: Dedupe, keys=()):
        n, p = max(1, config.expected_keys), min(max(config.false_positive_rate, 1e-6), 0.5)
        self.size = ceil(-n * log(p) / log(2) ** 2)
        self.hashes = max(1, floor(self.size / n * log(2) + 0.5))
        self.bits, self.added = bytearray(-(-self.size // 8)), 0
        for key in keys:
            self.add(key)

    def places(self, key: str) -> list[int]:
        raw = key.encode("utf-16-le", "surrogatepass")
        a, b = 2166136261, 5381
        for i in range(0, len(raw), 2):
            unit = raw[i] | raw[i + 1] << 8
            a = (a ^ unit) * 16777619 & 0xFFFFFFFF
            b = (b * 33 + unit) & 0xFFFFFFFF
        return [((a + i * (b | 1)) & 0xFFFFFFFF) % self.size for i in range(self.hashes)]

    def add(self, key: str) -> None:
        for x in self.places(key):
            self.bits[x >> 3] |= 1 << (x & 7)
        self.added += 1

    def has(self, key: str) -> bool:
        return all(self.bits[x >> 3] >> (x & 7) & 1 for x in self.places(key))

    def estimate(self) -> float:
        return (1 - exp(-self.hashes * self.added / self.size)) ** self.hashes if self.added else 0.0


class Seen:
    """Dedupe keys with their anchors. A heap by time finds the expired ones without a scan."""

    def __init__(self, config: Dedupe, diagnostics: bool = False):
        self.config = config
        self.anchors: dict[str, tuple[str, int]] = {}
        self.by_time: list[tuple[int, str]] = []
        self.bloom = Bloom(config) if diagnostics else None
        self.totals = dict.fromkeys(("checked", "duplicates", "evicted", "skips", "false_positives"), 0)

    def evict(self, now: int) -> None:
        before, limit = len(self.anchors), now - self.config.window_ms
        while self.by_time and self.by_time[0][0] <= limit:
            at, key = heapq.heappop(self.by_time)
            if self.anchors.get(key, (None, None))[1] == at:
                del self.anchors[key]
                self.totals["evicted"] += 1
        if self.bloom and before and 2 * len(self.anchors) < before:
            self.bloom = Bloom(self.config, self.anchors)

    def check(self, key: str, message: str, now: int) -> tuple[bool, str | None, int | None, bool]:
        """(duplicate, original id, its age, whether the filter was wrong)."""
        if not self.config.enabled:
            return False, None, None, False
        self.totals["checked"] += 1
        self.evict(now)
        maybe = self.bloom.has(key) if self.bloom else False
        if key in self.anchors:
            first, at = self.anchors[key]
            self.totals["duplicates"] += 1
            return True, first, now - at, False
        self.totals["false_positives" if maybe else "skips"] += 1
        self.anchors[key] = (message, now)
        heapq.heappush(self.by_time, (now, key))
        if self.bloom:
            self.bloom.add(key)
        return False, None, None, maybe

    def forget(self, key: str) -> bool:
        return self.anchors.pop(key, None) is not None

    def report(self) -> dict:
        t, ratio = self.totals, lambda a, b: a / b if b else 0.0
        out = {"checked": t["checked"], "duplicates": t["duplicates"], "duplicate_rate": ratio(t["duplicates"], t["checked"]), "tracked_keys": len(self.anchors), "evicted": t["evicted"], "configured_rate": self.config.false_positive_rate}
        if self.bloom:
            out |= {"skip_rate": ratio(t["skips"], t["checked"]), "false_positives": t["false_positives"], "observed_rate": ratio(t["false_positives"], t["skips"] + t["false_positives"])}
            out |= {"bloom_bytes": len(self.bloom.bits), "oversaturated": self.bloom.estimate() > 2 * self.config.false_positive_rate}
        return out


class Leases:
    """Claims in the order in which their ids were first claimed, with their deadlines."""

    def __init__(self, config: Visibility):
        self.config = config
        self.held: dict[str, dict] = {}
        self.by_deadline: list[tuple[float, str]] = []
        self.places = count()

    def claim(self, id_: str, lane: str, consumer: str, attempt: int, now: int) -> dict | None:
        """The new claim, or None if the id has a live one."""
        old = self.held.get(id_)
        if old and old["deadline"] > now:
            return None
        new = {"id": id_, "lane": lane, "consumer": consumer, "attempt": old["attempt"] + 1 if old else attempt, "deadline": now + self.config.timeout_ms, "extensions": 0, "since": now, "place": old["place"] if old else next(self.places)}
        self.held[id_] = new
        heapq.heappush(self.by_deadline, (new["deadline"], id_))
        return new

    def extend(self, id_: str, consumer: str, now: int) -> tuple[str, dict | None]:
        """A code (OK or the first that applies of the refusals) and the claim."""
        held = self.held.get(id_)
        if held is None:
            return "NOT_CLAIMED", None
        refusals = (("WRONG_CONSUMER", held["consumer"] != consumer), ("ALREADY_EXPIRED", held["deadline"] <= now), ("EXTENSION_CAP_REACHED", held["extensions"] >= self.config.max_extensions))
        for code, applies in refusals:
            if applies:
                return code, held
        held["extensions"] += 1
        held["deadline"] = now + self.config.timeout_ms
        heapq.heappush(self.by_deadline, (held["deadline"], id_))
        return "OK", held

    def release(self, id_: str, consumer: str) -> dict | None:
        """Take the claim off, if it is the consumer's, be it past its deadline or not."""
        held = self.held.get(id_)
        return self.held.pop(id_) if held and held["consumer"] == consumer else None

    def reap(self, now: int) -> list[dict]:
        """Take off all claims whose deadline has come, in the order of their places."""
        gone: dict[str, dict] = {}
        while self.by_deadline and self.by_deadline[0][0] <= now:
            _, id_ = heapq.heappop(self.by_deadline)
            held = self.held.get(id_)
            if held and held["deadline"] <= now:
                gone[id_] = self.held.pop(id_)
        return sorted(gone.values(), key=lambda x: x["place"])


EXPIRED = "visibility timeout expired"


class QueueMachine:
    """A whole queue. `step` takes a command (schema COMMANDS, as a dict) and yields events (schema JOURNAL, without
    queue, seq and n)."""

    def __init__(self, config: QueueConfig, diagnostics: bool = False):
        self.config = config
        self.lanes: dict[str, list[dict]] = {lane: [] for lane in config.lanes}
        self.first = dict.fromkeys(config.lanes, 0)  # place of each lane's head; taken messages are cut off now and then
        self.credits = Credits(config.scheduling, config.lanes)
        self.leases = Leases(config.visibility)
        self.seen = Seen(config.dedupe, diagnostics) if config.dedupe and config.dedupe.enabled else None
        self.dead: dict[str, list[dict]] = {}
        self.bodies: dict[str, dict] = {}  # payload and dedupe key of claimed messages

    def step(self, c: dict) -> Iterator[dict]:
        do = getattr(self, f"on_{c['op']}", None)
        if do is None:
            yield self.event("rejected", c, reason=f"unknown op {c['op']}", ok=False)
            return
        yield from do(c)

    @staticmethod
    def event(name: str, c: dict, **more) -> dict:
        return {"event": name, "now_ms": c["now_ms"], "id": c.get("id"), "lane": c.get("lane"), "consumer_id": c.get("consumer_id")} | more

    # waiting messages

    def depth(self, lane: str) -> int:
        return len(self.lanes[lane]) - self.first[lane]

    def oldest(self) -> dict[str, int]:
        return {x: q[self.first[x]]["enqueued"] for x, q in self.lanes.items() if self.depth(x)}

    def push(self, id_: str, lane: str, body: dict, attempt: int, now: int) -> None:
        self.lanes[lane].append({"id": id_, "body": body, "attempt": attempt, "enqueued": now})

    def take(self, lane: str) -> dict:
        q, i = self.lanes[lane], self.first[lane]
        message, self.first[lane] = q[i], i + 1
        if self.first[lane] > 64 and 2 * self.first[lane] > len(q):
            del q[: self.first[lane]]
            self.first[lane] = 0
        return message

    # commands

    def on_enqueue(self, c: dict) -> Iterator[dict]:
        if c["lane"] not in self.lanes:
            yield self.event("rejected", c, reason="unknown lane", ok=False)
            return
        wrong = None
        if self.seen and c["dedupe_key"] is not None:
            duplicate, original, age, wrong = self.seen.check(c["dedupe_key"], c["id"], c["now_ms"])
            if duplicate:
                yield self.event("duplicate", c, original_id=original, amount_ms=age, ok=False, dedupe_key=c["dedupe_key"])
                return
        self.push(c["id"], c["lane"], {"payload": c["payload"], "dedupe_key": c["dedupe_key"]}, 1, c["now_ms"])
        yield self.event("enqueued", c, attempt=1, ok=True, unknown=wrong, dedupe_key=c["dedupe_key"])

    def on_reap(self, c: dict) -> Iterator[dict]:
        for held in self.leases.reap(c["now_ms"]):
            yield from self.released(held, "expired", c, EXPIRED)

    def on_claim(self, c: dict) -> Iterator[dict]:
        yield from self.on_reap(c)
        choice = self.credits.select(self.oldest(), c["now_ms"])
        if choice is None:
            yield self.event("empty", c, ok=False)
            return
        lane, reason, waited = choice
        yield self.event("selected", c, lane=lane, reason=reason, amount_ms=waited)
        head = self.lanes[lane][self.first[lane]]
        held = self.leases.claim(head["id"], lane, c["consumer_id"], head["attempt"], c["now_ms"])
        if held is None:  # the id is claimed; its second message stays at the head
            other = self.leases.held[head["id"]]
            yield self.event("contended", c, id=head["id"], lane=lane, reason="ALREADY_CLAIMED", original_id=other["consumer"], amount_ms=int(other["deadline"] - c["now_ms"]), ok=False)
            return
        self.take(lane)
        self.bodies[head["id"]] = head["body"]
        yield self.event("claimed", c, id=head["id"], lane=lane, attempt=held["attempt"], deadline_ms=int(held["deadline"]), ok=True, payload=head["body"]["payload"], dedupe_key=head["body"]["dedupe_key"])

    def on_heartbeat(self, c: dict) -> Iterator[dict]:
        code, held = self.leases.extend(c["id"], c["consumer_id"], c["now_ms"])
        ok = code == "OK"
        left = self.config.visibility.max_extensions - held["extensions"] if ok else None
        yield self.event("extended" if ok else "refused", c, lane=held and held["lane"], reason=code, ok=ok, deadline_ms=int(held["deadline"]) if ok else None, attempt=left)

    def on_ack(self, c: dict) -> Iterator[dict]:
        held = self.leases.release(c["id"], c["consumer_id"])
        if held:
            self.bodies.pop(c["id"], None)
            yield self.release_event(held, "ack", c)
        else:
            yield self.event("refused", c, reason="NOT_OWNED", ok=False)

    def on_nack(self, c: dict) -> Iterator[dict]:
        held = self.leases.release(c["id"], c["consumer_id"])
        if held:
            yield from self.released(held, "nack", c, c["reason"])
        else:
            yield self.event("refused", c, reason="NOT_OWNED", ok=False)

    def on_dead_letter(self, c: dict) -> Iterator[dict]:
        """An extension: a permanent failure, whatever attempts are left."""
        held = self.leases.release(c["id"], c["consumer_id"])
        if held:
            yield from self.released(held, "nack", c, c["reason"], final=True)
        else:
            yield self.event("refused", c, reason="NOT_OWNED", ok=False)

    def on_forget(self, c: dict) -> Iterator[dict]:
        yield self.event("forgotten", c, ok=bool(self.seen and self.seen.forget(c["dedupe_key"])), dedupe_key=c["dedupe_key"])

    def on_reset_stats(self, c: dict) -> Iterator[dict]:
        yield self.event("reset", c, ok=True)

    def on_replay(self, c: dict) -> Iterator[dict]:
        for id_ in c["ids"] or ():
            entries = self.dead.get(id_)
            if not entries:
                continue
            lane = c["lane"] if c["lane"] is not None else entries[0]["lane"]
            known = lane in self.lanes
            if not known and not self.config.compat:
                yield self.event("rejected", c, id=id_, lane=lane, reason="unknown lane", ok=False)
                continue
            entry = entries.pop(0)
            key = entry["body"]["dedupe_key"]
            if self.seen and key is not None:
                self.seen.forget(key)
            if known:
                self.push(id_, lane, entry["body"], 1, c["now_ms"])
            yield self.event("replayed" if known else "dropped", c, id=id_, lane=lane, attempt=1, ok=known)

    # releases

    def release_event(self, held: dict, reason: str, c: dict) -> dict:
        return self.event("released", c, id=held["id"], lane=held["lane"], consumer_id=held["consumer"], attempt=held["attempt"], reason=reason, amount_ms=c["now_ms"] - held["since"], unknown=reason == "expired", ok=True)

    def released(self, held: dict, reason: str, c: dict, why: str | None, final: bool = False) -> Iterator[dict]:
        yield self.release_event(held, reason, c)
        body = self.bodies.pop(held["id"], None) or {"payload": None, "dedupe_key": None}
        if self.config.compat:
            body = {"payload": None, "dedupe_key": None}
        same = {"id": held["id"], "lane": held["lane"], "consumer_id": held["consumer"], "payload": body["payload"], "dedupe_key": body["dedupe_key"]}
        if final or held["attempt"] >= self.config.max_attempts:
            self.dead.setdefault(held["id"], []).append({"lane": held["lane"], "body": body})
            yield self.event("dead", c, **same, attempt=held["attempt"], reason=why, unknown=reason == "expired", ok=False)
        else:
            self.push(held["id"], held["lane"], body, held["attempt"] + 1, c["now_ms"])
            yield self.event("requeued", c, **same, attempt=held["attempt"] + 1, reason=why, ok=True)

    def conservation(self) -> dict[str, int]:
        """Messages by where they are."""
        return {"waiting": sum(map(self.depth, self.lanes)), "in_flight": len(self.leases.held), "dead": sum(map(len, self.dead.values()))}


class LeaseMachine:
    """Claims of one id on their own (no lanes): claim, heartbeat, ack, nack, reap."""

    def __init__(self, config: Visibility):
        self.leases = Leases(config)

    def step(self, c: dict) -> Iterator[dict]:
        id_, who, now, op = c["id"], c["consumer_id"], c["now_ms"], c["op"]
        say = QueueMachine.event
        if op == "claim":
            held = self.leases.claim(id_, c["lane"], who, 1, now)
            if held:
                yield say("claimed", c, attempt=held["attempt"], deadline_ms=int(held["deadline"]), ok=True)
            else:
                other = self.leases.held[id_]
                yield say("contended", c, reason="ALREADY_CLAIMED", original_id=other["consumer"], amount_ms=int(other["deadline"] - now), ok=False)
        elif op == "heartbeat":
            code, held = self.leases.extend(id_, who, now)
            ok = code == "OK"
            yield say("extended" if ok else "refused", c, reason=code, ok=ok, deadline_ms=int(held["deadline"]) if ok else None, attempt=self.leases.config.max_extensions - held["extensions"] if ok else None)
        elif op in ("ack", "nack"):
            held = self.leases.release(id_, who)
            if held:
                yield say("released", c, attempt=held["attempt"], reason=op, amount_ms=now - held["since"], unknown=False, ok=True)
            else:
                yield say("refused", c, reason="NOT_OWNED", ok=False)
        elif op == "reap":
            for held in self.leases.reap(now):
                yield say("released", c, consumer_id=held["consumer"], attempt=held["attempt"], reason="expired", amount_ms=now - held["since"], unknown=True, ok=True)
