"""clean judges each row by its own text, whatever its id and the size of the benchmark."""

import pytest

from tidemill.llm import decontam

WATCH = "the quick brown fox jumps over the lazy dog while seven wise owls keep watch"


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_repeated_and_null_ids(spark, limit):
    items = spark.createDataFrame([(1, WATCH)], "item_id long, text string")
    good = [(1, "clean", "a"), (None, "clean too", "b"), (None, None, "c"), (2, "clean", "d"), (1, "clean", "a")]
    bad = [(1, WATCH, "e"), (None, WATCH.upper(), "f"), (3, WATCH, "g"), (None, WATCH, "h")]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, key string")
    out = decontam.clean(docs, items, broadcast_bytes=limit)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(good, key=str)
