"""Keyed state that steps through events as they come."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

STATE = StructType([StructField("body", StringType())])


def stateful_fold(
    events: DataFrame,
    keys: list[str],
    order: list[str],
    new_state: Callable[[], object],
    schema: str,
    idle_ms: int | None = None,
) -> DataFrame:
    """Step a state object through each key's events of every micro-batch.

    The object has ``step(row)``, ``finish()``, ``dump()`` and ``load(body)``.  Events of one
    micro-batch are put in ``order``; later batches come later.  A key leaves the state
    when its object says that it is ``over``, and with ``idle_ms`` also when nothing was
    heard of it for that long (processing time): a timer then finishes it, without any
    later event.  So state does not grow with every key ever seen.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = new_state()
        if state.exists:
            machine.load(json.loads(state.get[0]))
        if state.hasTimedOut:
            rows = list(machine.finish())
            state.remove()
        else:
            batch = pd.concat(list(frames)).sort_values(order, kind="stable")
            records = batch.astype(object).where(batch.notna(), None).to_dict("records")
            rows = [out for record in records for out in machine.step(record)]
            if getattr(machine, "over", False):
                if state.exists:
                    state.remove()
            else:
                state.update((json.dumps(machine.dump()),))
                if idle_ms is not None:
                    state.setTimeoutDuration(idle_ms)
        if rows:
            yield pd.DataFrame([tuple(key) + tuple(r) for r in rows], columns=names, dtype=object)

    return events.groupBy(*keys).applyInPandasWithState(run, schema, STATE, "append", timeout)
