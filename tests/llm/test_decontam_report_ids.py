"""Rows and items without an id are judged as all others, whatever the size of the benchmark."""

import pytest

from tidemill.llm import decontam

from .conftest import pairs
from .test_decontam import brute

WATCH = "the quick brown fox jumps over the lazy dog while seven wise owls keep watch"
CORN = "nine grey geese walk slowly past the old red barn to find some corn"


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_null_ids(spark, limit):
    items = spark.createDataFrame([(1, WATCH), (None, CORN), (None, "two words")], "item_id long, text string")
    rows = [(None, WATCH), (None, "nothing of that kind"), (None, None), (1, CORN), (1, "clean"), (2, WATCH + " " + CORN), (None, CORN), (None, CORN), (3, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, decontam.report(docs, items, broadcast_bytes=limit).collect()), key=str)
    assert got == brute(rows, pairs(items.withColumnRenamed("item_id", "doc_id")))
    assert sum(r[-1] for r in got) == 6
