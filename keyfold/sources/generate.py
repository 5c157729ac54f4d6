"""Test-data generators as ranges: every row follows from its number and a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _bits(seed: int, tag: int):
    """32 bits that hang on the row's id: the first of a digest, so other engines can draw alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.lit(tag), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def _draw(seed: int, tag: int, low: int, high: int):
    """A whole number in low .. high."""
    return (F.pmod(_bits(seed, tag), F.lit(high - low + 1)) + low).cast("int")


def uniform(spark: SparkSession, tasks: int, values: int) -> DataFrame:
    """``k, v``: every task with equally many values of 1."""
    return spark.range(tasks * values).select(F.call_function("div", F.col("id"), F.lit(values).cast("bigint")).cast("int").alias("k"), F.lit(1).alias("v"))


def leave_one_empty(spark: SparkSession, tasks: int, values: int, reducers: int) -> DataFrame:
    """``k, reducer, v``: tasks on all reducers but number 0."""
    t = uniform(spark, tasks, values)
    return t.select("k", (F.pmod(F.col("k"), F.lit(reducers - 1)) + 1).cast("int").alias("reducer"), "v")


def skewed(spark: SparkSession, rows: int, keys: int, reducers: int, mappers: int, seed: int = 10) -> DataFrame:
    """``key, reducer, val1, val2, val3, mapper``: keys by a squared draw, so low keys are large; owners follow the reducer."""
    u = F.pmod(_bits(seed, 0), F.lit(1 << 30)) / (1 << 30)
    base = spark.range(rows)
    near = _draw(seed, 4, 0, 9) < 6  # most of a key's rows lie where its reducer is
    return base.select(F.floor(u * u * keys).cast("int").alias("key"), F.lit(0).alias("_"), _draw(seed, 1, 1, 99998).alias("val1"), _draw(seed, 2, 1, 99998).alias("val2"), _draw(seed, 3, 1, 99998).alias("val3"), near.alias("near"), _draw(seed, 5, 0, mappers - 1).alias("far")).select("key", F.pmod("key", F.lit(reducers)).alias("reducer"), "val1", "val2", "val3", F.when(F.col("near"), F.pmod("key", F.lit(mappers))).otherwise(F.col("far")).cast("int").alias("mapper"))
