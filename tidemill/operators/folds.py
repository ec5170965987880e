"""Ordered folds over a sorted stream of rows.

Rows are partitioned by key and sorted by (key, order) by Spark (which spills); each Arrow batch is then folded with a
small carried state, so memory doesn't grow with a key, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.session import ship


def fold_sorted(df: DataFrame, key: str, order: list[str], start: Callable[[object], object], step: Callable[[object, dict], Iterator[dict]], schema: str, out: Callable[[list[dict]], pa.RecordBatch]) -> DataFrame:
    """`step(state, row)` yields output rows; `start(key)` makes a key's state. Null keys are a key of their own."""
    ship(df.sparkSession)
    spread = df.repartition(key).sortWithinPartitions(key, *order)

    def run(batches):
        state, current, begun = None, None, False
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if not begun or row[key] != current:
                    state, current, begun = start(row[key]), row[key], True
                rows.extend(step(state, row))
            yield out(rows)

    return spread.mapInArrow(run, schema)
