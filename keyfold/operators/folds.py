"""Folds: how the values of one key become one result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.session import ship


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def add_int(x) -> Column:
    """Whole-number sum (64 bits)."""
    return F.sum(_c(x).cast("bigint"))


def add_double(x, scale: int | None = None) -> Column:
    """Sum of doubles; with a scale it is exact, by decimals of that scale."""
    x = _c(x)
    return F.sum(x.cast("double")) if scale is None else F.sum(x.cast(f"decimal(18,{scale})")).cast("double")


def mean_double(x, places: int | None = None) -> Column:
    """Mean, optionally rounded."""
    mean = F.avg(_c(x).cast("double"))
    return mean if places is None else F.round(mean, places)


def mean_int(x) -> Column:
    """Sum divided by count in whole numbers, towards zero."""
    x = _c(x).cast("bigint")
    return F.call_function("div", F.sum(x), F.count(x))


def fold_sorted(df: DataFrame, keys: Sequence[str], value: str, zero, step: Callable, finish: Callable | None = None, result: str = "bigint", name: str = "result") -> DataFrame:
    """``keys, name``: any left fold over a key's values in their sorted order, for what no built-in aggregate expresses.

    ``step`` and ``finish`` are Python functions. Values are sorted by Spark,
    which spills, and stream through a worker that holds one state: a hot key
    takes time and no memory. Null values come first. Folds whose states can be
    merged go better through ``extend.run``.
    """
    ship(df.sparkSession)
    n = len(keys)

    def run(source):
        done, key, state = [], None, None

        def batch(kinds):
            columns = list(zip(*done))
            return pa.record_batch([*[pa.array(c, f.type) for c, f in zip(columns, kinds)], pa.array(columns[n])], names=[*keys, name])

        for b in source:
            kinds = list(b.schema)[:n]
            for *k, v in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if key is not None:
                        done.append((*key, finish(state) if finish else state))
                        if len(done) >= 10_000:
                            yield batch(kinds)
                            done.clear()
                    key, state = k, zero
                state = step(state, v)
        if key is not None:
            done.append((*key, finish(state) if finish else state))
            yield batch(kinds)

    slim = df.select(*keys, value)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:n]), f"`{name}` {result}"])
    return slim.repartition(*keys).sortWithinPartitions(*keys, value).mapInArrow(run, schema)


def fold_by(df: DataFrame, keys: Sequence[str], **folds: Column) -> DataFrame:
    """One row for each key with the named folds; Spark aggregates partially before its exchange."""
    return df.groupBy(*keys).agg(*[f.alias(n) for n, f in folds.items()])


def two_phase_mean_int(df: DataFrame, keys: Sequence[str], value: str, part: str) -> DataFrame:
    """Partial sums and counts by (key, part), merged by key: what partial aggregation does, spelled out.

    Also the way to fold a hot key whose aggregate does not combine by itself: ``part`` salts it.
    """
    partial = df.groupBy(*keys, part).agg(F.sum(F.col(value).cast("bigint")).alias("_s"), F.count(value).alias("_n"))
    return partial.groupBy(*keys).agg(F.call_function("div", F.sum("_s"), F.sum("_n")).alias("mean_int"), F.sum("_s").alias("total"), F.sum("_n").alias("n"))
