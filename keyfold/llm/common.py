"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.session import shared_root, ship

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U64 = np.uint64
#: Bits of a key filter: 8 MB at most, whatever the number of keys.
FILTER_BITS = 1 << 26
#: Documents of an Arrow batch.
BATCH_ROWS = 2_500
#: Keys of very many rows that a join broadcasts, at most, and the fewest rows of such a key.
HOT_KEYS, HOT_ROWS = 50_000, 512

_STORES: dict[str, Callable[[], None]] = {}
_IN_USE = [""]


def store(name: str, clear: Callable[[], None]) -> None:
    """Names a worker's store of words or pieces, and how to empty it."""
    _STORES[name] = clear


def only(name: str) -> None:
    """Empties every other store: a worker that goes on to another operator keeps nothing of the last one."""
    if _IN_USE[0] != name:
        _IN_USE[0] = name
        for other, clear in _STORES.items():
            if other != name:
                clear()
        give_back()


def give_back() -> None:
    """Hands free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder through Hadoop's file system layer."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    with contextlib.suppress(Exception):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)


def ready(spark: SparkSession) -> None:
    """Gives the workers this package, and Arrow batches that suit documents.

    Spark's default of 10,000 rows a batch is for narrow rows; it is lowered to
    BATCH_ROWS unless the session has a setting of its own.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


_SCOPES: list[list[Scratch]] = []


class Scratch:
    """Tables written to the shared folder: a lost executor costs no recomputation beyond them."""

    def __init__(self, spark: SparkSession, name: str):
        ready(spark)
        self.spark, self.root = spark, f"{shared_root(spark)}/keyfold-{name}-{uuid.uuid4().hex}"
        self.n = 0
        for held in _SCOPES:
            held.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        """Writes a table once and reads it back, which cuts the lineage."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._keyfold_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Frees tables that nothing reads any more."""
        for t in tables:
            if getattr(t, "_keyfold_path", None):
                drop_path(self.spark, t._keyfold_path)


@contextlib.contextmanager
def scratch_scope():
    """Frees all tables that operators wrote inside, once what is read from them has been written."""
    held: list[Scratch] = []
    _SCOPES.append(held)
    try:
        yield
    finally:
        _SCOPES.remove(held)
        for s in held:
            drop_path(s.spark, s.root)


def free_name(columns: Iterable[str], name: str) -> str:
    """A column name that is not among ``columns``, upper and lower case alike."""
    taken = {c.lower() for c in columns}
    return next(n for k in range(len(taken) + 1) if (n := f"{name}{k or ''}").lower() not in taken)


def quoted(name: str) -> str:
    """A column's name for expressions and DDL."""
    return "`" + name.replace("`", "``") + "`"


def join_hot(rows: DataFrame, facts: DataFrame, on: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row for each ``on`` and its number ``n`` of rows.

    An exchange would put all rows of a key into one task. Keys of more than
    ``total`` / HOT_KEYS rows are broadcast, where ``total`` is no less than the
    sum of ``n``, so there are fewer than HOT_KEYS; the rest is joined as usual.
    ``facts`` is a written table, unless ``total`` is no more than HOT_ROWS.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = facts.where(F.col(n) > most)
    if total <= most or hot.isEmpty():
        return rows.join(facts, on)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(facts.where(F.col(n) <= most), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return data.translate(LOWER).split() if data else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (xor, shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Tuples to Arrow batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def utf8(column: str = "text"):
    """The UTF-8 bytes of a string column; null stays null."""
    return F.col(column).cast("binary")


def sift(df: DataFrame, value: Column, keys: DataFrame, column: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``value`` (a long) may be one of ``keys``, and those where it surely is none.

    A bitmap of FILTER_BITS, set in parts of 4 KB on the executors, written and
    then broadcast. It thins out the rows before an exact join and replaces
    none: the more keys, the more rows pass, and beyond one key for two bits all
    do. ``keys`` is a written table; columns of ``df`` may have any names.
    """
    if 2 * keys.count() > FILTER_BITS:
        return df, df.limit(0)
    place = lambda c: F.xxhash64(c.cast("long")).bitwiseAND(F.lit(FILTER_BITS - 1))
    placed = keys.select((place(F.col(column)) + 1).alias("at")).distinct()
    parts = placed.select(F.bitmap_bucket_number("at").alias("part"), F.bitmap_bit_position("at").alias("bit")).repartition("part")
    bits = scratch.save(parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")))  # FILTER_BITS at most
    marked = df.select(F.struct("*").alias("row"), place(value).alias("at")).withColumn("part", F.shiftright("at", 15) + 1)
    marked = marked.join(F.broadcast(bits), "part", "left")
    byte = F.substring("bits", (F.shiftright("at", 3).bitwiseAND(F.lit(4095)) + 1).cast("int"), F.lit(1))
    found = F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), F.col("at").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return marked.where(found).select("row.*"), marked.where(~found).select("row.*")
