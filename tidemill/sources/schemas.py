"""Schemas of the engine's relations. Times are epoch milliseconds."""

from __future__ import annotations

COMMANDS = "queue string, seq long, now_ms long, op string, id string, lane string, consumer_id string, dedupe_key string, payload string, reason string, ids array<string>"
OPS = ("enqueue", "claim", "heartbeat", "ack", "nack", "replay", "forget", "reap", "reset_stats", "dead_letter")

MESSAGES = "id string, pos long, lane string, payload string, enqueued_at_ms long, attempt int, dedupe_key string"
LANES = "lane string, weight double, lane_ord int"
CLAIMS = "id string, lane string, consumer_id string, deadline_ms long, attempt int, extensions int, claimed_at_ms long, ins_ord long"
DEAD_LETTERS = "ord long, message struct<id:string,lane:string,payload:string,enqueued_at_ms:long,attempt:int,dedupe_key:string>, reason string, attempts int, dead_lettered_at_ms long, outcome_unknown boolean"

#: What a fold emits: one row for everything that happened, in order of (seq, n) within a queue.
JOURNAL = (
    "queue string, seq long, n int, now_ms long, event string, id string, lane string, consumer_id string, attempt int, reason string, "
    "amount_ms long, deadline_ms long, original_id string, ok boolean, unknown boolean, payload string, dedupe_key string"
)
