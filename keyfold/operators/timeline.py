"""Event archives on a grid of right-closed time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def millis(ts) -> Column:
    """Epoch milliseconds of a timestamp column (session zone UTC)."""
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def bucket(ts: Column, start, step: int) -> Column:
    """Bucket i holds (start + (i-1) * step, start + i * step]; bucket 0 everything up to the start."""
    return F.greatest(F.lit(0).cast("bigint"), F.ceil((ts - start) / F.lit(step)).cast("bigint"))


def bounds(archive: DataFrame, ts: str = "ts") -> tuple[int, int] | None:
    """First and last time: one row, at plan time."""
    lo, hi = archive.agg(F.min(ts), F.max(ts)).first()
    return None if lo is None else (lo, hi)


def grid(archive: DataFrame, start: int, last: int, step: int) -> DataFrame:
    """``bucket`` 0 to floor((last + step - start) / step): empty ones, and one after a last record on a boundary."""
    return archive.sparkSession.range(0, (last + step - start) // step + 1).select(F.col("id").alias("bucket"))


def tumble(archive: DataFrame, step: int, *aggs: Column, zero: tuple[str, ...] = ()) -> DataFrame:
    """``bucket`` and the aggregates on the dense grid, from ``ts`` (milliseconds); columns in ``zero`` become 0 where empty."""
    found = bounds(archive)
    if found is None:
        return archive.limit(0).groupBy(F.lit(0).cast("bigint").alias("bucket")).agg(*aggs)
    start, last = found
    counted = archive.groupBy(bucket(F.col("ts"), F.lit(start), step).alias("bucket")).agg(*aggs)
    out = grid(archive, start, last, step).join(counted, "bucket", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}) if zero else out


def _per_id(archive: DataFrame, step: int, *aggs: Column) -> DataFrame:
    """``id, bucket`` on the dense grid for every id, with aggregates of each cell (null where empty)."""
    start, last = bounds(archive) or (0, -step)
    cells = archive.groupBy("id", bucket(F.col("ts"), F.lit(start), step).alias("bucket")).agg(*aggs)
    n = (last + step - start) // step
    every = archive.select("id").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n).cast("bigint"))))
    return every.join(cells, ["id", "bucket"], "left")


def carried(archive: DataFrame, step: int, default=0.0) -> DataFrame:
    """``id, bucket, value``: the last value so far (by time, then ``seq``); a default before the first."""
    last = F.max_by("value", F.struct("ts", "seq")).alias("value")
    w = Window.partitionBy("id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return _per_id(archive, step, last).select("id", "bucket", F.coalesce(F.last("value", ignorenulls=True).over(w), F.lit(default)).alias("value"))


def running(archive: DataFrame, step: int) -> DataFrame:
    """``id, bucket, value``: the running total."""
    w = Window.partitionBy("id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return _per_id(archive, step, F.sum("value").alias("value")).select("id", "bucket", F.coalesce(F.sum("value").over(w), F.lit(0)).alias("value"))


def fairness(samples: DataFrame) -> DataFrame:
    """``bucket, fairness, lo, hi, mean`` over all ids; fairness is lo / hi, 0 if hi is 0."""
    lo, hi = F.min("value").cast("double"), F.max("value").cast("double")
    return samples.groupBy("bucket").agg(F.when(hi == 0, 0.0).otherwise(F.round(lo / hi, 6)).alias("fairness"), lo.alias("lo"), hi.alias("hi"), F.round(F.avg("value"), 6).alias("mean"))


def state_count(samples: DataFrame, is_on: Column) -> DataFrame:
    """``bucket, n``: ids whose carried state is on."""
    return samples.groupBy("bucket").agg(F.count_if(is_on).alias("n"))


def fuse(*archives: DataFrame) -> DataFrame:
    """All records of several archives, by time."""
    out = archives[0]
    for a in archives[1:]:
        out = out.unionByName(a)
    return out.orderBy("ts")


def latest(archive: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """``key, value``: the newest value of each key."""
    return archive.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def latest_every(archive: DataFrame, key: str, frequency: int, *order: str) -> DataFrame:
    """The messages that a mailbox passes on: of a key's messages in order, every ``frequency``-th, and the newest.

    The others are outdated by those behind them. With a frequency of 0 only the newest remains.
    """
    w = Window.partitionBy(key).orderBy(*order)
    held = archive.withColumns({"_i": F.row_number().over(w), "_next": F.lead(F.lit(1)).over(w)})
    passes = F.col("_next").isNull() | ((F.col("_i") % frequency == 0) if frequency else F.lit(False))
    return held.where(passes).drop("_i", "_next")
