"""Best-fit packing with swap-based local search.

Documents become pieces of at most ``capacity`` tokens (only longer documents
are cut). Groups of pieces, by hash, are packed on their own: best fit by
decreasing length, then a local search among all underfull bins that moves a
piece, exchanges one for one, or two for one whenever that increases the sum of
squared fills. Fill gathers in some bins until others are empty; the search ends
when nothing improves or no packing can have fewer bins.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches, ready
from .tokens import encoder, prove_whole, text_groups

#: Pieces of a packing group.
GROUP = 20_000


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, longest first: bins as lists of indexes."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # distinct free rooms, sorted
    by_room: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        bins[b].append(int(i))
        if left := room - n:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    return bins


class LocalSearch:
    """Moves between underfull bins that increase the sum of squared fills."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.n, self.bins, self.cap, self.moves = np.asarray(lengths, np.int64), [list(b) for b in bins], capacity, 0
        self.fill = np.array([self.n[b].sum() for b in bins], np.int64)
        self.of = np.zeros(len(self.n), np.int64)  # the bin of each piece
        for k, b in enumerate(bins):
            self.of[b] = k
        # of each piece: its bin's fill, and the most that could stand in its place
        self.held = self.fill[self.of]
        self.place = self.n + capacity - self.held

    def _apply(self, a: int, b: int, out: list[int], back: list[int]) -> None:
        self.moves += 1
        for one, other, go in ((a, b, out), (b, a, back)):
            self.bins[one] = [i for i in self.bins[one] if i not in go]
            self.bins[other] += go
            self.of[go] = other
        for k in (a, b):
            at = self.bins[k]
            self.fill[k] = self.n[at].sum()
            self.held[at] = self.fill[k]
            self.place[at] = self.n[at] + self.cap - self.fill[k]

    def _offers(self, a: int) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
        """Lengths that one piece of bin a has, and those of one or two, each with such pieces."""
        by_length: dict[int, list[int]] = {}
        for i in self.bins[a]:
            by_length.setdefault(int(self.n[i]), []).append(i)
        one = {n: same[:1] for n, same in by_length.items()}
        two, lengths = dict(one), list(by_length)
        for x, n in enumerate(lengths):
            if len(by_length[n]) > 1:
                two.setdefault(2 * n, by_length[n][:2])
            for m in lengths[x + 1 :]:
                two.setdefault(n + m, [one[n][0], one[m][0]])
        return one, two

    def _largest(self, offers: dict[int, list[int]]) -> np.ndarray:
        """The largest offer up to each length from 0 to the capacity; 0 where there is none."""
        t = np.zeros(self.cap + 1, np.int64)
        at = np.fromiter(offers, np.int64, len(offers))
        t[at] = at
        return np.maximum.accumulate(t)

    def improve(self, a: int) -> bool:
        """The best move, one-for-one or two-for-one exchange from bin a into any bin that is not emptier."""
        one, two = self._offers(a)
        fa = self.fill[a]
        best, what = 0, None
        # what goes to a bin that is at least as full always increases the sum of squares
        shift = self._largest(one)[self.cap - self.fill]
        gain = np.where(self.fill >= fa, shift * (self.fill - fa + shift), 0)
        gain[a] = 0
        if gain[b := int(gain.argmax())] > best:
            best, what = gain[b], (b, one[int(shift[b])], [])
        given = self._largest(two)[self.place]
        shift = given - self.n
        gain = np.where((shift > 0) & (self.held >= fa) & (self.of != a), shift * (self.held - fa + shift), 0)
        if gain[j := int(gain.argmax())] > best:
            what = (int(self.of[j]), two[int(given[j])], [j])
        if what:
            self._apply(a, *what)
        return bool(what)

    def least(self) -> bool:
        """Whether the room in all bins in use is less than one bin, so that no packing has fewer."""
        used = self.fill[self.fill > 0]
        return int((self.cap - used).sum()) < self.cap

    def run(self) -> list[list[int]]:
        """Rounds over all underfull bins, the emptiest first, until nothing improves."""
        changed = True
        while changed and not self.least():
            changed = False
            for a in np.argsort(self.fill, kind="stable").tolist():
                while 0 < self.fill[a] < self.cap and self.improve(a):
                    changed = True
                if changed and not self.fill[a] and self.least():
                    break
        return [b for b in self.bins if b]


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of indexes) of one group; no bin holds more than the capacity."""
    lengths = np.asarray(lengths, np.int64)
    return LocalSearch(lengths, best_fit(lengths, capacity), capacity).run()


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, capacity: int = 2048, text: str = "text", key: str = "doc_id", end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every row's ids followed by ``end_id``."""
    ready(docs.sparkSession)
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole(path))
    end = np.asarray([end_id], "<u4").tobytes()

    def rows(enc, b):
        encoded = (ids for group in text_groups(b.column(1).to_pylist()) for ids in enc.encode_many(group))
        for doc_id, buf in zip(b.column(0).to_pylist(), encoded):
            buf += end
            n, view = len(buf) // 4, memoryview(buf)
            for p, s in enumerate(range(0, n, capacity)):
                e = min(n, s + capacity)
                yield doc_id, p, s, e - s, zlib.crc32(view[4 * s : 4 * e])

    def run(source):
        enc = encoder(path, whole.value)
        for b in source:
            yield from batches(rows(enc, b), _PIECES, 20_000)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for all rows.

    Null and empty texts are one piece of the end id alone. Long texts are cut
    whole into pieces. Repeated rows and null keys are pieces like others; other
    columns are ignored; an empty table gives no rows. Pieces are written once
    to the shared folder, so a lost executor costs no second tokenisation; the
    groups' sizes are bounded, and their number grows with the pieces.
    """
    spark = docs.sparkSession
    made = Scratch(spark, "packing").save(pieces(docs, path, capacity, text, key))
    n_groups = max(1, -(-made.count() // GROUP))
    dealt = made.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_groups)))
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        # a fixed order first, so that a task run twice packs alike
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        g, lengths = group.column("_group")[0].as_py(), np.asarray(group.column("length"))
        seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for s, members in enumerate(pack(lengths, capacity)):
            at = 0
            for i in members:
                seq[i], off[i] = g * (1 << 32) + s, at
                at += int(lengths[i])
        out = group.drop_columns(["_group"])
        return pa.table([*out.columns, pa.array(seq), pa.array(off)], schema=schema)

    return dealt.groupBy("_group").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
