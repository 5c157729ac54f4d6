"""Readers: delimited text, pre-split files, archives, configurations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.functions.text import field
from keyfold.session import scratch_path

#: Field positions (from 0) and types of the data sets that the jobs read.
SCHEMAS: dict[str, tuple[str, dict[str, tuple[int, str]]]] = {
    "weather": (";", {"station": (0, "string"), "date": (1, "string"), "temp": (7, "string"), "precip": (40, "string")}),
    "ratings": (",", {"film": (0, "string"), "score": (2, "string"), "day": (3, "string")}),
    "songs": ("\t", {"song": (0, "int"), "grade": (2, "int")}),
    "keywords": ("\t", {"account": (1, "string"), "phrase": (3, "string")}),
    "sales": (";", {"shop": (1, "string"), "date": (2, "string"), "article": (4, "string"), "amount": (5, "string")}),
    "kv": (";", {"k": (0, "int"), "v": (1, "int")}),
    "skewed": (";", {"key": (0, "int"), "reducer": (1, "int"), "val1": (2, "int")}),
    "text": (" ", {}),
}


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``value``: non-blank lines."""
    return spark.read.text(paths).where("value <> ''")


def memory(spark: SparkSession, data: str | bytes) -> DataFrame:
    """``value``: the non-blank lines of a text held in memory; bytes are UTF-8."""
    text = data.decode() if isinstance(data, bytes) else data
    return spark.createDataFrame([(x,) for x in text.split("\n") if x], "value string")


def project(df: DataFrame, sep: str, fields: Mapping[str, tuple[int, str]], permissive: bool = False) -> DataFrame:
    """Typed columns from the positions of a delimited line.

    Strict by default: a number that does not parse is an error when read;
    permissive gives null. A field beyond the last is null.
    """
    cut = [(name, field("value", sep, i), kind) for name, (i, kind) in fields.items()]
    return df.select(*[(c.try_cast(kind) if permissive else c.cast(kind)).alias(name) for name, c, kind in cut])


def read_dataset(spark: SparkSession, kind: str, paths: str | list[str], permissive: bool = False) -> DataFrame:
    """A data set of a known layout; ``text`` gives ``line``."""
    sep, fields = SCHEMAS[kind]
    raw = lines(spark, paths)
    return raw.withColumnRenamed("value", "line") if kind == "text" else project(raw, sep, fields, permissive)


def numbered(df: DataFrame, *order) -> DataFrame:
    """Adds ``_place``: the row's number (from 0) in the given order, and ``_block``, the part of the order that it lies in.

    The rows are dealt by ranges of the order, sorted in their partitions and
    written once with the partition's number and the place in it, so that both
    are the same whenever they are read; the blocks' sizes are added up. No
    window goes over all rows.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "numbered")
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    held = spark.read.schema(ranged.schema).parquet(path)
    block, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    held = held.withColumns({"_block": block, "_in": place}).drop("_at")
    sizes = held.groupBy("_block").agg(F.count("*").alias("_n"))
    starts = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_start"))  # a row for each partition
    return held.join(F.broadcast(starts), "_block").withColumn("_place", F.col("_start") + F.col("_in")).drop("_start", "_in")


def round_robin(df: DataFrame, splits: int, *order) -> DataFrame:
    """Adds ``split``: the row's number in the given order modulo the number of splits."""
    return numbered(df, *order).withColumn("split", (F.col("_place") % splits).cast("int")).drop("_block", "_place")


def presplit(spark: SparkSession, directory: str) -> DataFrame:
    """``value, file`` of a directory of split files; Spark assigns files to tasks."""
    return spark.read.text(directory).select("value", F.col("_metadata.file_name").alias("file"))


def archive(spark: SparkSession, path: str, columns: str, header: bool = True) -> DataFrame:
    """A ``;`` separated archive with the given DDL schema."""
    return spark.read.schema(columns).option("sep", ";").option("header", header).csv(path)


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, key, value`` of chunk files: a line with the key, then a line for each value.

    A chunk's size is bounded by whoever wrote it, so a file is read as a whole.
    A file with a key alone gives no rows; so does an empty one.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    cut = files.select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", r"\n$", ""), "\n").alias("_lines"))
    return cut.select("file", F.get("_lines", F.lit(0)).alias("key"), F.explode(F.slice("_lines", 2, F.size("_lines"))).alias("value"))


def parse_config(text: Iterable[str]) -> dict[str, str]:
    """``field : value`` lines; lines without a colon and comments are left out, text after a second colon is cut."""
    out = {}
    for line in text:
        if ":" in line and not line.startswith("//"):
            name, value = line.split(":")[:2]
            out[name.strip()] = value.strip()
    return out


def parse_addresses(text: Iterable[str]) -> list[tuple[str, int]]:
    """``address count`` lines without comments."""
    return [(a, int(n)) for a, n in (line.split()[:2] for line in text if line.strip() and not line.startswith("//"))]
