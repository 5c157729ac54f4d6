"""Jobs of the user's own: a map function over lines and a fold over values, in Python.

For what column expressions cannot say. Values are folded where they are
mapped, in a store of bounded size; folded states meet by key and are merged in
sorted order, one key at a time, so no key's values are held together.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from keyfold.session import ship

#: States held by a task before they are passed on.
HELD = 100_000


@dataclass(frozen=True)
class UserJob:
    """``map``: line to (key, value) pairs; ``fold``: state and value to state; ``merge``: two states to one;
    ``post``: state to result. Keys are strings; ``result`` names the DDL type of results."""

    map: Callable[[str], Iterable[tuple[str, Any]]]
    neutral: Callable[[], Any]
    fold: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    post: Callable[[Any], Any] = lambda state: state
    result: str = "bigint"


def run(job: UserJob, lines: DataFrame, column: str = "value") -> DataFrame:
    """``key, result`` over all lines; blank and null lines are left out."""
    ship(lines.sparkSession)

    def fold(source) -> Iterator[pa.RecordBatch]:
        held: dict[str, Any] = {}

        def flush():
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array([pickle.dumps(s) for s in held.values()], pa.binary())], names=["key", "state"])

        for b in source:
            for line in b.column(0).to_pylist():
                if line:
                    for k, v in job.map(line):
                        held[k] = job.fold(held[k] if k in held else job.neutral(), v)
            if len(held) >= HELD:
                yield flush()
                held = {}
        if held:
            yield flush()

    def merge(source) -> Iterator[pa.RecordBatch]:
        key, state, keys, results = None, None, [], []
        for b in source:
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = pickle.loads(s)
                if k == key:
                    state = job.merge(state, s)
                    continue
                if key is not None:
                    keys.append(key)
                    results.append(job.post(state))
                key, state = k, s
            if len(keys) >= HELD:
                yield pa.record_batch([pa.array(keys, pa.string()), pa.array(results)], names=["key", "result"])
                keys, results = [], []
        if key is not None:
            keys.append(key)
            results.append(job.post(state))
        if keys:
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(results)], names=["key", "result"])

    partial = lines.select(column).mapInArrow(fold, "key string, state binary")
    return partial.repartition("key").sortWithinPartitions("key").mapInArrow(merge, f"key string, result {job.result}")
