"""Aggregates that a user writes in Python, combined before and after the shuffle.

``update`` turns a group's values of one Arrow batch into a state, a tuple of numbers; ``merge`` joins two states, in any order; ``finish`` makes the
result. Each task hands on one state per group and batch, never the values, so a group of any size is spread over all tasks that read it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

State = tuple[float, ...]


@dataclass(frozen=True)
class PythonAggregate:
    """``update(values, times)`` gets doubles and microseconds, nulls left out, perhaps none; a result of None is null."""

    update: Callable[[np.ndarray, np.ndarray], State]
    merge: Callable[[State, State], State]
    finish: Callable[[State], float | None]


def python_aggregate(m: DataFrame, keys: list[str], aggregate: PythonAggregate, name: str, value: str = "value", ts: str = "ts") -> DataFrame:
    """``keys`` and the result as ``name``, one row per group; null keys are groups too. An empty table gives an empty result."""
    keys = list(keys)
    rows = m.select(*keys, F.col(value).cast("double").alias("_value"), F.unix_micros(ts).alias("_time"))
    head = [rows.schema[k] for k in keys]
    states = StructType(list(head)).add("_state", ArrayType(DoubleType()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place = pa.Table.from_batches([batch.select(keys)]).append_column("_at", pa.array(np.arange(batch.num_rows)))
            first = place.group_by(keys, use_threads=False).aggregate([("_at", "min"), ("_at", "list")])
            x, t = batch.column("_value").to_numpy(zero_copy_only=False), batch.column("_time").to_numpy(zero_copy_only=False)
            there = ~(batch.column("_value").is_null().to_numpy(zero_copy_only=False) | batch.column("_time").is_null().to_numpy(zero_copy_only=False))
            found = []
            for at in first["_at_list"].to_pylist():
                mine = np.array(at)[there[at]]
                found.append([float(s) for s in aggregate.update(x[mine], t[mine].astype(np.int64))])
            chosen = batch.select(keys).take(first["_at_min"].combine_chunks())
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(found, pa.list_(pa.float64()))], names=[*keys, "_state"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the keys of the group at hand
        own, state = None, None

        def result(group: pa.RecordBatch, s: State) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*group.columns, pa.array([aggregate.finish(s)], pa.float64())], names=[*keys, name])

        for batch in batches:
            names = batch.select(keys).to_pylist()
            ready = []
            for k, now in enumerate(batch.column("_state").to_pylist()):
                group = tuple(pd.isna(v) or v for v in names[k].values())
                if state is not None and group == own:
                    state = aggregate.merge(state, tuple(now))
                    continue
                if state is not None:
                    ready.append(result(held, state))
                own, state, held = group, tuple(now), batch.select(keys).slice(k, 1)
            yield from ready
        if state is not None:
            yield result(held, state)

    parts = rows.mapInArrow(partial, states)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(finish, StructType(list(head)).add(name, DoubleType()))


def moments_update(values: np.ndarray, times: np.ndarray) -> State:
    """Count, mean and the sums of the second to fourth powers of what is left without the mean."""
    if not len(values):
        return 0.0, 0.0, 0.0, 0.0, 0.0
    rest = values - values.mean()
    return float(len(values)), float(values.mean()), *(float((rest ** k).sum()) for k in (2, 3, 4))


def moments_merge(a: State, b: State) -> State:
    if not a[0] or not b[0]:
        return a if a[0] else b
    (na, ma, a2, a3, a4), (nb, mb, b2, b3, b4) = a, b
    n, d = na + nb, mb - ma
    return (n, ma + d * nb / n, a2 + b2 + d * d * na * nb / n,
            a3 + b3 + d ** 3 * na * nb * (na - nb) / n ** 2 + 3 * d * (na * b2 - nb * a2) / n,
            a4 + b4 + d ** 4 * na * nb * (na * na - na * nb + nb * nb) / n ** 3 + 6 * d * d * (na * na * b2 + nb * nb * a2) / n ** 2 + 4 * d * (na * b3 - nb * a3) / n)


#: Excess kurtosis of the population; null for constant and empty groups.
KURTOSIS = PythonAggregate(moments_update, moments_merge, lambda s: s[0] * s[4] / s[2] ** 2 - 3 if s[2] > 0 else None)
