"""Writers: result lines, archives, one-row metric records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_lines(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``value``: one line ``key value`` for each row."""
    return df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in (*keys, value)]).alias("value"))


def write_results(df: DataFrame, keys: Sequence[str], value: str, path: str) -> None:
    """Result lines as text files, one for each partition."""
    result_lines(df, keys, value).write.mode("overwrite").text(path)


def write_archive(df: DataFrame, path: str) -> None:
    """An archive or timeline as ``;`` separated files with a header."""
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_record(df: DataFrame, path: str) -> None:
    """A one-row record with its columns in sorted order."""
    df.select(*sorted(df.columns)).coalesce(1).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_chunks(df: DataFrame, path: str) -> None:
    """Chunk files from ``key, chunk_index, value``: a line with the key, then a line for each value, in sorted order.

    One file for each key and chunk; a chunk's values are as many as the chunk size allows.
    """
    lines = df.groupBy("key", "chunk_index").agg(F.sort_array(F.collect_list(F.col("value").cast("string"))).alias("values"))
    body = F.concat_ws("\n", F.col("key").cast("string"), F.array_join("values", "\n")).alias("value")
    lines.select(F.concat_ws("_", F.col("key").cast("string"), F.col("chunk_index").cast("string")).alias("chunk"), body).write.mode("overwrite").partitionBy("chunk").text(path)


def concatenate(df: DataFrame, path: str) -> None:
    """All result lines (``value``) as one text file, in sorted order: a sort by ranges, and one writer that streams them."""
    df.orderBy("value").coalesce(1).write.mode("overwrite").text(path)
