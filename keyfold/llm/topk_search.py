"""Exact top-k search by pivot-table elimination.

A table, written once, has what a row's distances to many pivots tell: its
coordinates in the pivots' span and the length of what lies outside. For a query
q and a row x these give the maximum lower bound of d(q, x) that holds for all
vectors with those distances, |coordinates(q) - coordinates(x)|^2 + (outside(q) -
outside(x))^2, which is no less than |d(q,p) - d(x,p)| for any one pivot p. As
2 q.x = |q|^2 + |x|^2 - d(q,x)^2, it bounds the inner product from above. Rows are
evaluated in the order of their bounds until no bound left can reach the k-th
best score.

Rows are dealt to groups of bounded size, and queries go to every group as rows
of a table: none is gathered on the driver. Every group starts from the same
threshold, the k-th best score among a bounded sample of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Pivots of each dimension, and the bounded sample that they and the first thresholds come from.
PIVOTS, SAMPLE = 48, 2048
#: Bytes of rows and their table in a group; queries bounded at once, rows evaluated at once.
GROUP_BYTES, QUERY_BLOCK, STEP = 32_000_000, 64, 256
#: Rounding never hides a row: what the bound adds, as a share of the squared lengths.
SLACK, OUTSIDE = 1e-9, 1e-11


def quantise(vectors: DataFrame, scale: float = 1024.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` with v = floor(scale * x) as longs; rows with a null vector, a null or a non-finite component go."""
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


class PivotTable:
    """Coordinates in the span of pivots, and bounds of inner products by them."""

    def __init__(self, sample: np.ndarray, count: int = PIVOTS):
        """Each pivot is the row of the sample that lies farthest from the span of those before."""
        left, axes = np.array(sample, np.float64), []
        lengths = (left**2).sum(1)
        first = lengths.max(initial=0.0)
        while len(axes) < count and len(left) and lengths.max() > 1e-6 * first:
            axis = left[int(lengths.argmax())]
            axis = axis / np.sqrt((axis**2).sum())
            for a in axes:  # once more, against rounding
                axis = axis - (axis @ a) * a
            axes.append(axis / np.sqrt((axis**2).sum()))
            left = left - np.outer(left @ axes[-1], axes[-1])
            lengths = (left**2).sum(1)
        self.axes = np.array(axes).reshape(len(axes), left.shape[1])

    def entry(self, rows: np.ndarray) -> np.ndarray:
        """Each row's coordinates and, last, the length outside the span."""
        x = np.asarray(rows, np.float64)
        inside, length = x @ self.axes.T, (x**2).sum(1)
        outside = np.sqrt(np.maximum(length - (inside**2).sum(1), 0) + OUTSIDE * length)
        return np.column_stack([inside, outside])


def bounds(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of entries q with entries x."""
    return q @ x.T + 1 + SLACK * ((q**2).sum(1)[:, None] + (x**2).sum(1))


def _exact(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: by doubles where none can round, else by integers."""
    most = max(float(np.abs(rows).max(initial=0)), float(np.abs(q).max(initial=0)))
    if most * most * rows.shape[1] < 2**52:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return rows @ q


def _keep(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Search:
    """One group of rows, against blocks of queries."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, entries: np.ndarray, k: int):
        self.ids, self.rows, self.entries, self.k, self.evaluated = ids, rows, entries, k, 0

    def best(self, q_id: int, q: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of at most k rows that reach ``least``; ties go to the smaller id."""
        left = np.flatnonzero(high >= least)
        left = left[np.argsort(-high[left], kind="stable")]
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step = 0, STEP
        while at < len(left) and high[left[at]] >= least:  # exact stop: no bound left reaches the k-th score
            now = left[at : at + step]
            now = now[self.ids[now] != q_id]
            self.evaluated += len(now)
            ids, scores = _keep(np.concatenate([ids, self.ids[now]]), np.concatenate([scores, _exact(self.rows[now], q)]), self.k)
            if len(ids) == self.k:
                least = max(least, int(scores[-1]))
            at, step = at + step, step * 2
        ok = scores >= least
        return ids[ok], scores[ok]

    def answer(self, q_ids, queries, entries, least):
        """(query id, ids, scores) of every query."""
        for a in range(0, len(q_ids), QUERY_BLOCK):
            high = bounds(entries[a : a + QUERY_BLOCK], self.entries)
            for i, h in enumerate(high, a):
                yield q_ids[i], *self.best(q_ids[i], queries[i], h, least[i])


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_LOW = -(2**63)


def _numbers(column: pa.Array, kind, width: int) -> np.ndarray:
    """A column of packed numbers as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _enter(tables):
    """mapInArrow function over (vec_id, v, ..): (vec_id, dim, .., v and entry as bytes), by each dimension's pivots."""

    def run(source):
        for b in source:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                dims = np.asarray(part.column(1).value_lengths()).astype(np.int32)
                for dim in np.unique(dims):
                    rows = part.filter(pa.array(dims == dim))
                    x = np.asarray(rows.column(1).flatten()).astype(np.int64).reshape(rows.num_rows, dim)
                    entries = tables.value.get(int(dim), PivotTable(np.zeros((0, dim)))).entry(x)
                    yield pa.record_batch([rows.column(0), pa.array(np.full(len(x), dim, np.int32)), rows.column(2), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in entries], pa.binary())], names=["vec_id", "dim", "place", "v", "entry"])

    return run


def _seed(samples, k):
    """mapInArrow function over queries: adds the k-th best score among the sample's rows."""

    def run(source):
        for b in source:
            least = np.full(b.num_rows, _LOW, np.int64)
            for i, (q_id, dim, q) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3))):
                ids, rows = samples.value.get(dim, (np.empty(0, np.int64), None))
                if len(ids) > k:
                    scores = _exact(rows, np.frombuffer(q.as_buffer(), np.int64))[ids != q_id]
                    if len(scores) >= k:
                        least[i] = np.partition(scores, -k)[-k]
            yield pa.record_batch([*b.columns, pa.array(least)], names=[*b.schema.names, "least"])

    return run


def _scan(k):
    """mapInArrow function over rows sorted by (dim, group, is_query): each group's rows, then all queries."""

    def run(source):
        key, held, search = None, [], None
        for b in source:
            dims, groups, is_query = (np.asarray(b.column(i)) for i in (0, 1, 2))
            cut = np.flatnonzero(np.concatenate([[True], (dims[1:] != dims[:-1]) | (groups[1:] != groups[:-1]) | (is_query[1:] != is_query[:-1])]))
            for a, e in zip(cut, np.append(cut[1:], b.num_rows)):
                part, dim = b.slice(a, e - a), int(dims[a])
                if key != (dim, groups[a]):
                    key, held, search = (dim, groups[a]), [], None
                v = _numbers(part.column(4), np.int64, dim)
                entries = np.frombuffer(b"".join(part.column(5).to_pylist()), np.float64).reshape(len(v), -1)
                ids = np.asarray(part.column(3))
                if not is_query[a]:
                    held.append((ids, v, entries))
                    continue
                if search is None and held:
                    search = Search(*(np.concatenate(x) for x in zip(*held)), k)
                    held = []
                if search:
                    found = list(search.answer(ids, v, entries, np.asarray(part.column(6))))
                    sizes = [len(f[1]) for f in found]
                    if sum(sizes):
                        yield pa.record_batch([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], schema=_OUT)

    return run


_ENTRY = "vec_id long, dim int, place long, v binary, entry binary"


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each query, ties to the smaller id.

    Both inputs: ``vec_id, v`` (array of longs), from ``quantise``; other columns
    are ignored. A row never answers the query of its own id. Vectors whose
    dimension differs from a query's take no part in its answer. Fewer than k
    candidates give fewer rows; no queries, no rows. Repeated ids among the rows
    are separate candidates; a repeated query id is searched once. The driver
    holds the sample (SAMPLE rows); rows and queries stay in tables.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.save(rows.where(F.col("vec_id").isNotNull()).select("vec_id", "v", F.monotonically_increasing_id().alias("place")))
    total, widest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    # a bounded sample, by hash, for the pivots and the first thresholds
    share = max(1, total // SAMPLE)
    got = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).orderBy("vec_id", "place").limit(SAMPLE).select("vec_id", "v").collect()
    samples = {}
    for dim in {len(r["v"]) for r in got}:
        of_dim = [r for r in got if len(r["v"]) == dim]
        samples[dim] = np.array([r["vec_id"] for r in of_dim], np.int64), np.array([r["v"] for r in of_dim], np.int64).reshape(len(of_dim), dim)
    tables = spark.sparkContext.broadcast({dim: PivotTable(x[1]) for dim, x in samples.items()})  # PIVOTS vectors a dimension
    samples = spark.sparkContext.broadcast(samples)  # SAMPLE rows
    held = max(1, min(GROUP_BYTES // (8 * (widest + PIVOTS + 1)), -(-total // (2 * spark.sparkContext.defaultParallelism))))
    n_groups = -(-total // held)
    table = scratch.save(rows.mapInArrow(_enter(tables), _ENTRY))
    asked = queries.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.lit(0).cast("long").alias("place"))
    asked = scratch.save(asked.mapInArrow(_enter(tables), _ENTRY).mapInArrow(_seed(samples, k), _ENTRY + ", least long"))
    group = F.pmod(F.xxhash64("place"), F.lit(max(1, n_groups))).cast("int")
    rest = ("vec_id", "v", "entry")
    every = F.explode(F.sequence(F.lit(0), F.lit(max(1, n_groups) - 1))).alias("g")
    both = table.select("dim", group.alias("g"), F.lit(False).alias("is_query"), *rest, F.lit(0).cast("long").alias("least")).unionByName(asked.select("dim", every, F.lit(True).alias("is_query"), *rest, "least"))
    # one group to a partition, not by a hash that puts several into one
    dealt = both.repartitionById(max(1, n_groups), F.pmod(F.col("g") + F.col("dim"), F.lit(max(1, n_groups))).cast("int")).sortWithinPartitions("dim", "g", "is_query")
    found = dealt.mapInArrow(_scan(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
