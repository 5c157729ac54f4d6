"""Benchmark decontamination by an FM-index over every training shard.

A shard is a bounded run of documents. Its words become symbols: the words of
the benchmark have numbers of their own, any other word and every document's end
is a terminator that no phrase holds. Suffixes are sorted, the
Burrows-Wheeler transform goes into a wavelet matrix, and backward search narrows
all phrases at once by ranks. Occurrences are located by walking back to the
next sampled suffix position; the spans found are merged.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, batches, free_name, only, quoted, ready, sift, utf8

#: Words of a shard (one longer document is a shard of its own), and every how many positions are sampled.
SHARD_WORDS, SAMPLE = 1_500_000, 8
#: Bytes of benchmark text that one pass over the documents searches for; its windows are bounded by it.
BENCH_BYTES = 8_000_000

#: Bytes 0-9, a-z and all outside ASCII make words; A-Z is lowered before.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_KEEP = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def split_words(data: bytes | None) -> list[bytes]:
    """Words of lower-cased text."""
    return data.translate(_KEEP).split() if data else []


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit vector for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(seq), bits, []
        for level in range(bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = self.n - int(bit.sum())
            self.levels.append((packed, ones, zeros, level))
            seq = np.concatenate([seq[~bit], seq[bit]])

    @staticmethod
    def _ones(packed, ones, i):
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return ones[word] + np.bitwise_count(packed[word] & mask).astype(np.int64)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before place i (arrays)."""
        low, high = np.zeros_like(i), i.copy()
        for packed, ones, zeros, level in self.levels:
            one = ((c >> level) & 1).astype(bool)
            a, b = self._ones(packed, ones, low), self._ones(packed, ones, high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at places i."""
        out = np.zeros_like(i)
        for packed, ones, zeros, level in self.levels:
            a = self._ones(packed, ones, i)
            one = ((packed[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            out |= one.astype(np.int64) << level
            i = np.where(one, zeros + a, i - a)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order; every 0 is a terminator of its own, in the order of places. The last symbol must be 0.

    Prefix doubling that sorts only suffixes still tied.
    """
    n = len(seq)
    sa = np.argsort(seq.astype(np.uint16) if seq.max(initial=0) < 65536 else seq, kind="stable")
    s = seq[sa]
    start = np.concatenate([[True], s[1:] != s[:-1]])
    start |= s == 0
    first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    tied = ~start | np.concatenate([~start[1:], [False]])
    at, k = np.flatnonzero(tied), 1  # places of sa that are not settled
    while len(at):
        pos = sa[at]
        group = rank[pos]
        key = rank[np.minimum(pos + k, n - 1)]
        order = np.lexsort((key, group))
        pos, group, key = pos[order], group[order], key[order]
        sa[at] = pos
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[pos] = first
        at = at[~new | np.concatenate([~new[1:], [False]])]
        k *= 2
    return sa


class FMIndex:
    """Backward search and location over one sequence (0: terminators, last one 0)."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.sigma = len(seq), sigma
        sa = suffix_array(seq)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.bwt = WaveletMatrix(seq[sa - 1], max(1, int(sigma - 1).bit_length()))
        # sampled: every SAMPLE-th place, and the first after a terminator, where walks end
        after = np.concatenate([[True], seq[:-1] == 0])
        sampled = (after | (np.arange(self.n) % SAMPLE == 0))[sa]
        self.sampled, self.rank_of = sampled, np.cumsum(sampled) - sampled
        self.samples = sa[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases are right-aligned in a matrix of symbols."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - step].astype(np.int64)
            low[live] = self.starts[c] + self.bwt.rank(c, low[live])
            high[live] = self.starts[c] + self.bwt.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in the given rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            r = rows[walking]
            c = self.bwt.access(r)
            rows[walking] = self.starts[c] + self.bwt.rank(c, r)
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.samples[self.rank_of[rows]] + steps


class Phrases:
    """All windows of the benchmark items: distinct phrases of symbols and the items that each belongs to.

    Held as flat arrays: the items' symbols, each phrase's first place among
    them and its length, and the numbers of its items. For a block of
    BENCH_BYTES these are some tens of MB at most; the matrix of phrases (40
    bytes each) is made where it is searched with.
    """

    def __init__(self, items: list[tuple[int | None, bytes | None]], width: int):
        self.vocab: dict[bytes, int] = {}
        vocab, cut = self.vocab, []
        for _, data in items:
            w = split_words(data)
            cut.append(np.fromiter((vocab.setdefault(x, len(vocab) + 1) for x in w), np.int32, len(w)))
        self.sigma, self.width = len(vocab) + 1, width
        sizes = np.array([len(c) for c in cut], np.int64)
        self.symbols = np.concatenate([*cut, np.zeros(0, np.int32)])
        windows = np.where(sizes > 0, np.maximum(1, sizes - width + 1), 0)
        item = np.repeat(np.arange(len(items)), windows)
        at = (np.cumsum(sizes) - sizes)[item] + np.arange(len(item)) - (np.cumsum(windows) - windows)[item]
        lengths = np.minimum(sizes, width)[item]
        m = self._matrix(at, lengths)
        order = np.lexsort(m.T)
        new = np.ones(len(order), bool)
        new[1:] = (m[order[1:]] != m[order[:-1]]).any(1)
        self.starts, self.lengths = at[order[new]].astype(np.int32), lengths[order[new]].astype(np.int32)
        # items without an id are searched for and not listed
        ids = {x: k for k, x in enumerate(sorted({i for i, _ in items if i is not None}))}
        self.ids = np.array(list(ids), np.int64)
        number = np.array([ids.get(i, -1) for i, _ in items], np.int64)[item[order]] if len(order) else np.zeros(0, np.int64)
        pairs = np.unique(((np.cumsum(new) - 1) * max(1, len(ids)) + number)[number >= 0])
        self.owner = (pairs % max(1, len(ids))).astype(np.int32)
        self.owner_at = np.searchsorted(pairs, np.arange(len(self.starts) + 1) * max(1, len(ids))).astype(np.int64)
        self._made = None

    def _matrix(self, starts, lengths) -> np.ndarray:
        """Symbols of phrases, right-aligned."""
        out = np.zeros((len(starts), self.width), np.int32)
        for k in range(1, self.width + 1):  # the k-th symbol from the end
            has = lengths >= k
            out[has, self.width - k] = self.symbols[(starts + lengths - k)[has]]
        return out

    @property
    def matrix(self) -> np.ndarray:
        if self._made is None:
            self._made = self._matrix(self.starts.astype(np.int64), self.lengths)
        return self._made

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def items_of(self, phrase: int) -> list[int]:
        """The ids of a phrase's items, sorted."""
        return self.ids[self.owner[self.owner_at[phrase] : self.owner_at[phrase + 1]]].tolist()

    def nbytes(self) -> int:
        """Bytes of the arrays, and about those of the words."""
        return sum(x.nbytes for x in (self.symbols, self.starts, self.lengths, self.owner, self.owner_at, self.ids)) + sum(150 + len(w) for w in self.vocab)


def find_in_shard(docs: list[tuple[int, list[bytes] | np.ndarray]], phrases: Phrases) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set]]:
    """Merged word spans [from, to) and items, by document number, of one shard."""
    only("fm_index")
    parts, places, owner = [], [], []
    for d, sym in docs:
        # runs of terminators shrink to one; places lead back to the words
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
        at = np.flatnonzero(keep)
        parts += [sym[at], [0]]
        places += [at, [len(sym)]]
        owner.append((d, len(at) + 1))
    seq = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(seq) or not seq.any():
        return {}, {}
    place = np.concatenate(places).astype(np.int64)
    index = FMIndex(seq, phrases.sigma)
    low, high = index.search(phrases.matrix, phrases.lengths)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return {}, {}
    counts = (high - low)[hit]
    rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    which = np.repeat(hit, counts)
    at = index.locate(rows)
    ends = np.cumsum([n for _, n in owner])
    doc = np.searchsorted(ends, at, side="right")
    spans, items = defaultdict(list), defaultdict(set)
    starts, lengths = place[at], phrases.lengths[which].astype(np.int64)
    order = np.lexsort((starts, doc))
    for i in order:
        d = owner[doc[i]][0]
        a, b = int(starts[i]), int(starts[i] + lengths[i])
        held = spans[d]
        if held and a <= held[-1][1]:
            held[-1] = (held[-1][0], max(b, held[-1][1]))
        else:
            held.append((a, b))
    for d, w in set(zip(doc.tolist(), which.tolist())):
        items[owner[d][0]].update(phrases.items_of(w))
    return spans, items


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64()))])
_DDL = "doc_id long, n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<long>"


def _searcher(phrases: Phrases):
    """mapInArrow function over (doc_id, text bytes): one row a document; spans in words."""

    def flush(held):
        spans, items = find_in_shard([(i, s) for i, (_, _, s) in enumerate(held) if len(s)], phrases)
        for i, (doc_id, n, _) in enumerate(held):
            s = spans.get(i, [])
            yield doc_id, n, sum(b - a for a, b in s), [{"start": a, "end": b} for a, b in s], sorted(items.get(i, ()))

    def rows(source):
        get, held, n = phrases.vocab.get, [], 0
        for b in source:
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1)):
                w = split_words(data.as_py())
                sym = np.fromiter((get(x, 0) for x in w), np.int32, len(w))
                held.append((doc_id, len(w), sym))
                n += len(w)
                if n >= SHARD_WORDS:
                    yield from flush(held)
                    held, n = [], 0
        yield from flush(held)

    def run(source):
        yield from batches(rows(source), _OUT, 10_000)

    return run


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[list[tuple]]:
    """The benchmark in blocks of bounded bytes (one block, unless it is large)."""
    slim = benchmark.select(F.col(item).cast("long").alias("item"), utf8(text).alias("data"))
    total = slim.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    n = max(1, -(-total // BENCH_BYTES))
    if n == 1:
        return [[tuple(r) for r in slim.collect()]]
    return [slim.where(F.pmod(F.xxhash64("item", "data"), F.lit(n)) == b) for b in range(n)]


def _found_by_row(slim: DataFrame, blocks: list[DataFrame], width: int) -> DataFrame:
    """``row, n_words, spans, items`` of a written table of ``row, data``: spans of all blocks in the same text, merged."""
    found = None
    for block in blocks:
        phrases = slim.sparkSession.sparkContext.broadcast(Phrases([tuple(r) for r in block.collect()], width))
        part = slim.select(F.col("row").alias("doc_id"), "data").mapInArrow(lambda source, p=phrases: _searcher(p.value)(source), _DDL)
        found = part if found is None else found.unionByName(part)
    # spans of the blocks are merged by a fold over the sorted spans
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    all_items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    return found.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), merged.alias("spans"), all_items.alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items``: merged word spans inside occurrences of the items' windows.

    A window is ``width`` consecutive words of an item; an item of fewer words,
    but not none, is one window. Null texts have no words and no hits; so have
    empty ones. Repeated rows and null keys give rows of their own; windows of
    an item without an id are searched but listed under no item. An empty
    benchmark hits nothing; an empty table gives no rows. Whole texts of any
    length are read; a shard holds SHARD_WORDS words or one document. A
    benchmark beyond BENCH_BYTES is searched block after block, each in a pass
    over the documents, and the spans are merged.
    """
    ready(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("data"))
    blocks = _blocks(benchmark, "item_id", "text")
    if len(blocks) == 1:
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(blocks[0], width))  # bounded by BENCH_BYTES
        return slim.mapInArrow(lambda source: _searcher(phrases.value)(source), _DDL)
    slim = slim.withColumn("row", F.monotonically_increasing_id())
    slim = Scratch(docs.sparkSession, "decontamination").save(slim)
    by_row = _found_by_row(slim.select("row", "data"), blocks, width)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return by_row.join(slim.select("row", "doc_id"), "row").select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def remove_word_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; what stands between other words stays."""
    marks = [m.span() for m in _WORD.finditer(data.translate(LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : marks[a][0]])
        at = marks[b - 1][1]
    out.append(data[at:])
    return b"".join(out)


def digest_items(items: list[int]) -> str:
    """The contract's digest of an item list."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def clean_texts(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text") -> DataFrame:
    """All columns of docs, with the words of every occurrence cut out of ``text``.

    One pass over the documents: the shards are searched and the spans removed
    where the texts are. Rows without a hit, null texts included, are unchanged.
    A benchmark beyond BENCH_BYTES is searched block after block, each in a pass
    over the documents as they came; the spans are merged and cut out at once.
    Repeated rows and null keys are rows like others, other columns may have any
    names, and an empty table or benchmark changes nothing.
    """
    spark = docs.sparkSession
    ready(spark)
    columns, schema = docs.columns, docs.schema
    at = columns.index(text)
    plain = lambda df: df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])  # noqa: E731  names that any function takes

    def put(b, new):
        """A batch's columns with other texts."""
        return pa.record_batch([pa.array(new, b.column(at).type) if i == at else b.column(i) for i in range(len(columns))], names=columns)

    blocks = _blocks(benchmark, "item_id", "text")
    if len(blocks) > 1:
        row, spans = free_name(columns, "row"), free_name(columns, "spans")
        scratch = Scratch(spark, "decontamination")
        docs = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()))
        found = _found_by_row(docs.select(F.col(row).alias("row"), utf8(text).alias("data")), blocks, width)
        found = scratch.save(found.where(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(spans)))
        held, clear = sift(docs, F.col(row), found, row, scratch)

        def cut(source):
            for b in source:
                old, marks = b.column(at).to_pylist(), b.column(len(columns)).to_pylist()
                new = [remove_word_spans(x.encode(), [(m["start"], m["end"]) for m in s]).decode() for x, s in zip(old, marks)]
                yield put(b, new)

        # whole texts are shuffled only where the row may have a span
        names = [quoted(c) for c in columns]
        hit = plain(held.join(found, row).select(*names, spans)).mapInArrow(cut, schema)
        return clear.select(*names).unionByName(held.join(found, row, "left_anti").select(*names)).unionByName(hit)
    held = spark.sparkContext.broadcast(Phrases(blocks[0], width))  # bounded by BENCH_BYTES

    def run(source):
        phrases = held.value
        get = phrases.vocab.get
        for b in source:
            texts = [x.encode() if x else b"" for x in b.column(at).to_pylist()]
            start = 0
            while start < len(texts):
                shard, n, end = [], 0, start
                while end < len(texts) and n < SHARD_WORDS:
                    w = split_words(texts[end])
                    shard.append((end, np.fromiter((get(x, 0) for x in w), np.int32, len(w))))
                    n += len(w)
                    end += 1
                spans, _ = find_in_shard([d for d in shard if len(d[1])], phrases)
                new = b.column(at).slice(start, end - start).to_pylist()
                for i, s in spans.items():
                    new[i - start] = remove_word_spans(texts[i], s).decode()
                yield put(b.slice(start, end - start), new)
                start = end

    return plain(docs).mapInArrow(run, schema)
