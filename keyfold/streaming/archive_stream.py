"""Streaming forms: right-closed timelines and the latest value of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.session import scratch_path


def right_closed_timeline(stream: DataFrame, ts: str, step: str, late: str, *aggs: Column) -> DataFrame:
    """``end`` and aggregates of windows (end - step, end].

    The time is shifted by a microsecond before the watermark, so windows that
    Spark closes on the left become closed on the right, and state is evicted.
    Works on batches as well.
    """
    shifted = stream.withColumn("_ts", F.col(ts).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND"))
    out = shifted.withWatermark("_ts", late).groupBy(F.window("_ts", step)).agg(*aggs)
    return out.withColumn("end", F.col("window.end")).drop("window")


def latest_per_key(stream: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """``key, value``: the newest value; in update mode a stream emits a key again when it changes."""
    return stream.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def run_once(df: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Runs a stream over what is there now and returns what it gave, from files in the shared folder.

    Every micro-batch is written by its number, so one that is run again
    replaces itself; nothing is gathered on the driver.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, f"stream-{name}")
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).write.parquet(f"{path}/out/batch=-1")  # for a stream without rows
    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(schema).parquet(f"{path}/out").select(*schema.names)
