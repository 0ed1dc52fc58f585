"""Ordered folds whose state depends on what they did before.

Rows of a key arrive in order, a batch at a time, and the fold keeps only its
state: a very long history costs time, never memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

PIECE = 10000
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def ordered_fold(
    df: DataFrame, keys: list[str], order: list[str], new_state: Callable[[], object], schema: str
) -> DataFrame:
    """Run a state object over each key's rows in order.

    ``new_state()`` makes an object with ``step(row)`` and ``finish()``, both giving
    the tuples to emit (without the keys, which are put in front), as lists or generators.  Rows travel as
    Arrow, so a missing number stays missing and a large one stays exact.
    """
    fields = [tuple(part.split()) for part in schema.split(", ")]
    layout = pa.schema([(name, ARROW[kind]) for name, kind in fields])

    def framed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(column, type=field.type) for column, field in zip(columns, layout)], schema=layout
        )

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current:
                    if state is not None:
                        yield from (current + tuple(r) for r in state.finish())
                    current, state = key, new_state()
                yield from (key + tuple(r) for r in state.step(row))
        if state is not None:
            yield from (current + tuple(r) for r in state.finish())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a state tells at its end may be as long as its history, so it leaves in pieces.
        rows = told(batches)
        while out := list(islice(rows, PIECE)):
            yield framed(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
