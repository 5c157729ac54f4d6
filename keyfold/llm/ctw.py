"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; every node of that decision tree has a context
tree over the bytes before it. A context keeps how often a 0 and a 1 followed
and estimates by Krichevsky-Trofimov; its weighted probability mixes its own
estimate with the product of its longer contexts, half and half, at every depth.
The share that mixing leaves to a context's own estimate is what the trained
tree predicts with; all shares along the path give the probability of a bit.

Counts come from all training texts: distinct (context, byte) strings are
counted where the texts are, gathered by segments of contexts and weighted there
bottom-up. Each distinct string, held-out ones included, is scored once, in its
segment, by all nodes of the tree. The most frequent strings' scores are sent to
the workers that add them up by document; the rest are joined.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, Scratch, batches, mix, utf8

#: Context bytes; fewest and most segments of contexts, and bytes of input for each; of SEGMENTS segments, the
#: strings of each whose scores are sent to the workers (with more segments, so many fewer of each).
DEPTH, SEGMENTS, MOST_SEGMENTS, SEGMENT_BYTES, SENT = 5, 256, 65_536, 16_000_000, 16_384
#: Words whose counts are sent to the workers; the rest are joined.
HEAVY, HEAVY_BYTES = 65_536, 256
_CHUNK = 4_000_000
_CACHE_BITS = 20


def _grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Every (context, byte) as one number, text after text, and each text's number of bytes.

    The byte is the lowest eight bits, the byte before it the next ones. Texts
    begin after zero bytes and end with one zero byte, which counts.
    """
    pad = bytes(depth)
    a = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    g = np.zeros(len(a) - depth, U64)
    for k in range(depth + 1):
        g |= a[depth - k : len(a) - k].astype(U64) << U64(8 * k)
    if len(texts) > 1:
        keep = np.ones(len(g), bool)
        ends = np.cumsum(sizes + depth)[:-1] - depth
        keep[(ends[:, None] + np.arange(depth)).ravel()] = False
        g = g[keep]
    return g, sizes


def _add_up(keys: list[np.ndarray], *counts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    return _sum_nodes(np.concatenate(keys), *(np.concatenate(c) for c in counts))


def _segment(g: np.ndarray, segments: int) -> np.ndarray:
    return (mix((g >> U64(8)) & U64(0xFFFFFF)) % U64(segments)).astype(np.int32)


def _segments(texts: DataFrame) -> int:
    """How many segments; by the planner's estimate of the input's size, which no result hangs on."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_SEGMENTS, max(SEGMENTS, size // SEGMENT_BYTES))


def _text_groups(column, size: int):
    """Lower-cased texts in lists of about ``size`` bytes (a longer text is a list of its own)."""
    held, n = [], 0
    for x in column:
        t = (x.as_py() or b"").translate(LOWER)
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _count_grams(source, segments: int):
    """Rows (held_out, data): distinct strings by segment, how often in training texts and in all."""
    keys, train, every, n = [], [], [], 0
    for b in source:
        at, outs = 0, np.array(b.column(0).to_pylist(), bool)
        for texts in _text_groups(b.column(1), _CHUNK):
            g, sizes = _grams(texts)
            held = np.repeat(outs[at : at + len(texts)], sizes)
            at += len(texts)
            g, c = np.unique(g << U64(1) | held.astype(U64), return_counts=True)
            k, t, e = _sum_nodes(g >> U64(1), np.where(g & U64(1), 0, c), c)
            keys.append(k)
            train.append(t)
            every.append(e)
            n += len(k)
            if n > 2 * _CHUNK:
                k, t, e = _add_up(keys, train, every)
                keys, train, every, n = [k], [t], [e], len(k)
                if n > _CHUNK:
                    yield from _by_segment(segments, k, t, e)
                    keys, train, every, n = [], [], [], 0
    if keys:
        yield from _by_segment(segments, *_add_up(keys, train, every))


def _by_segment(segments, k, *counts):
    seg = _segment(k, segments)
    order = np.argsort(seg, kind="stable")
    seg, columns = seg[order], [x[order] for x in (k, *counts)]
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    last = np.append(first[1:], len(seg))
    for at in range(0, len(first), 64):
        part = list(zip(first[at : at + 64], last[at : at + 64]))
        yield pa.record_batch([pa.array(seg[[a for a, _ in part]]), *[pa.array([x[a:b].tobytes() for a, b in part], pa.binary()) for x in columns]], names=["seg", "grams", "train", "every"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0 (Stirling's series after a shift by 8)."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class _Level:
    """Nodes of one depth: key, counts, and the weighted log probability of their longer contexts."""

    def __init__(self, key, n0, n1, below=None):
        self.key, self.n0, self.n1, self.below = key, n0, n1, below
        own = log_kt(n0, n1)
        if below is None:
            self.log_w, self.share = own, np.ones(len(key))
        else:
            self.log_w = np.log(0.5) + np.logaddexp(own, below)
            self.share = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
        self.p1 = (n1 + 0.5) / (n0 + n1 + 1.0)

    def shorter(self, depth: int) -> _Level:
        """The level of contexts without their oldest byte; ``depth`` is the new level's."""
        parent = ((self.key >> U64(8)) & U64((1 << (8 * depth)) - 1)) << U64(8) | (self.key & U64(255))
        return _Level(*_sum_nodes(parent, self.n0, self.n1, self.log_w))


def _sum_nodes(key, *columns):
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[first], *(np.add.reduceat(c[order], first) if len(key) else c for c in columns))


def leaf_level(g: np.ndarray, c: np.ndarray) -> _Level:
    """The deepest nodes: key = context, then the bits of the byte decided so far (with a leading 1)."""
    keys, n0, n1 = [], [], []
    ctx, byte = (g >> U64(8)) << U64(8), g & U64(255)
    c = c.astype(np.float64)
    for j in range(8):
        bit = ((byte >> U64(7 - j)) & U64(1)).astype(bool)
        keys.append(ctx | (byte >> U64(8 - j)) | U64(1 << j))
        n0.append(np.where(bit, 0.0, c))
        n1.append(np.where(bit, c, 0.0))
    return _Level(*_sum_nodes(np.concatenate(keys), np.concatenate(n0), np.concatenate(n1)))


def _levels(grams, train) -> list[_Level]:
    """Depths DEPTH to 2 of one segment's strings; depth 2 still lacks what other segments add to it."""
    seen = train > 0
    levels = [leaf_level(grams[seen], train[seen])]
    for d in range(DEPTH - 1, 1, -1):
        levels.append(levels[-1].shorter(d))
    return levels


_SEGMENT_DDL = "key long, n0 double, n1 double, below double, grams binary, train binary, every binary"


def _weigh_segments(source):
    """Rows of _by_segment, sorted by segment: a row of all strings of each, and rows of what depth 2 needs."""
    names = ["key", "n0", "n1", "below", "grams", "train", "every"]

    def done(parts):
        columns = _add_up(*parts)
        yield pa.record_batch([pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.float64())] * 3, *[pa.array([x.tobytes()], pa.binary()) for x in columns]], names=names)
        level = _levels(*columns[:2])[-1]
        n = len(level.key)
        if n:
            yield pa.record_batch([pa.array(level.key.astype(np.int64)), pa.array(level.n0), pa.array(level.n1), pa.array(level.below), *[pa.nulls(n, pa.binary())] * 3], names=names)

    seg, parts, n = None, ([], [], []), 0
    for b in source:
        for s, *blobs in zip(b.column(0).to_pylist(), *(b.column(i) for i in (1, 2, 3))):
            if s != seg and n:
                yield from done(parts)
                parts, n = ([], [], []), 0
            seg = s
            for held, x, kind in zip(parts, blobs, (U64, np.int64, np.int64)):
                held.append(np.frombuffer(x.as_py(), kind))
            n += len(parts[0][-1])
            if n > 2 * _CHUNK:  # what many parts have in common is added up on the way
                parts = tuple([x] for x in _add_up(*parts))
                n = len(parts[0][0])
    if n:
        yield from done(parts)


class _Table:
    """The nodes of one depth, by key."""

    def __init__(self, level: _Level):
        """The keys of a level are sorted; the last place stands for no node."""
        self.key = np.append(level.key, np.iinfo(U64).max)
        self.p1, self.share = np.append(level.p1, 0.5), np.append(level.share, 1.0)

    def find(self, key):
        """Places, and whether the node is there."""
        at = np.searchsorted(self.key, key)
        return at, self.key[at] == key


class ContextTree:
    """The trained tree, or the part of it that one segment's strings need."""

    def __init__(self, tables: list[_Table]):
        self.tables = tables  # by depth, from 0

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte after its context.

        A context that training never saw leaves the prediction to the next
        shorter one; with no training at all every bit has probability one half.
        """
        out = np.zeros(len(g))
        byte = g & U64(255)
        for j in range(8):
            prefix = (byte >> U64(8 - j)) | U64(1 << j)
            p, seen = np.full(len(g), 0.5), np.zeros(len(g), bool)
            for d in range(len(self.tables) - 1, -1, -1):
                t = self.tables[d]
                at, there = t.find((((g >> U64(8)) & U64((1 << (8 * d)) - 1)) << U64(8)) | prefix)
                share = np.where(seen, t.share[at], 1.0)  # nothing longer is known: the context acts as a leaf
                p = np.where(there, share * t.p1[at] + (1 - share) * p, p)
                seen |= there
            bit = ((byte >> U64(7 - j)) & U64(1)).astype(bool)
            out += np.log10(np.where(bit, p, 1 - p))
        return out


def _deep(grams, train) -> list[_Table]:
    """Depths 3 to DEPTH of one segment's strings."""
    return [_Table(x) for x in reversed(_levels(grams, train)[:-1])]


def grow(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[_Table]]:
    """From rows of ``held_out, data``: all strings, a row for each segment, and the tables of depths 0 to 2."""
    segments = _segments(texts)
    counted = texts.select("held_out", "data").mapInArrow(lambda source: _count_grams(source, segments), "seg int, grams binary, train binary, every binary")
    made = scratch.save(counted.repartition("seg").sortWithinPartitions("seg").mapInArrow(_weigh_segments, _SEGMENT_DDL))
    # depth 2 has 65,536 contexts of 255 nodes at most
    two = made.where("grams is null").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).orderBy("key").toArrow()
    col = lambda n: two.column(n).combine_chunks().to_numpy(zero_copy_only=False)
    levels = [_Level(col("key").astype(U64), col("n0"), col("n1"), col("below"))]
    levels.append(levels[-1].shorter(1))
    levels.append(levels[-1].shorter(0))
    return made.where("grams is not null").select("grams", "train", "every"), [_Table(x) for x in reversed(levels)]


def train(texts: DataFrame, scratch: Scratch) -> ContextTree:
    """The whole tree from all rows of ``data`` (bytes), on the driver: for tables that fit there."""
    strings, shallow = grow(texts.select(F.lit(False).alias("held_out"), "data"), scratch)
    parts = strings.toArrow()
    grams, counts = (np.frombuffer(b"".join(parts.column(n).to_pylist()), kind) for n, kind in (("grams", U64), ("train", np.int64)))
    return ContextTree([*shallow, *_deep(grams, counts)])


def _score_strings(shallow, most: int):
    """mapInArrow function over segments: every string's log10 probability, the ``most`` frequent strings apart."""

    def run(source):
        for b in source:
            for blobs in zip(*(b.column(i) for i in range(3))):
                g, t, e = (np.frombuffer(x.as_py(), kind) for x, kind in zip(blobs, (U64, np.int64, np.int64)))
                tree = ContextTree([*shallow.value, *_deep(g, t)])
                sent = np.zeros(len(g), bool)
                sent[np.argsort(-e, kind="stable")[:most]] = True
                for at in range(0, len(g), 262_144):
                    k, s = g[at : at + 262_144], sent[at : at + 262_144]
                    v = tree.log10(k)
                    yield pa.record_batch([pa.array([True, False]), *[pa.array([x[s].tobytes(), x[~s].tobytes()], pa.binary()) for x in (k, v)]], names=["sent", "grams", "scores"])

    return run


def _spread(kind, names):
    """mapInArrow function: rows (.., keys, values) of packed arrays to a row for each key."""

    def flush(held):
        *ids, k, v = zip(*held)
        sizes = [len(x) // 8 for x in k]
        return pa.record_batch([*[pa.array(np.repeat(np.array(x, np.int64), sizes)) for x in ids], pa.array(np.frombuffer(b"".join(k), np.int64)), pa.array(np.frombuffer(b"".join(v), kind))], names=names)

    def run(source):
        for b in source:
            held, n = [], 0
            for row in zip(*b.columns):
                held.append(tuple(x.as_py() for x in row))
                n += len(held[-1][-1]) // 8
                if n >= 262_144:
                    yield flush(held)
                    held, n = [], 0
            if held:
                yield flush(held)

    return run


class _Scorer:
    """Adds up scores of strings; a direct-mapped cache of fixed size stands before the sent ones."""

    def __init__(self, sent: tuple[np.ndarray, np.ndarray]):
        self.sent, self.score = np.append(sent[0], np.iinfo(U64).max), np.append(sent[1], np.nan)
        self.keys, self.values = np.full(1 << _CACHE_BITS, np.iinfo(U64).max, U64), np.zeros(1 << _CACHE_BITS)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[bytes, bytes]]]:
        """Of each text, the log10 probability by the strings that were sent, and the others with their counts."""
        g, sizes = _grams(texts)
        slot = ((g * U64(0x9E3779B97F4A7C15)) >> U64(64 - _CACHE_BITS)).astype(np.int64)
        out = self.values[slot]
        missing = np.flatnonzero(self.keys[slot] != g)
        if len(missing):
            new, back = np.unique(g[missing], return_inverse=True)
            at = np.searchsorted(self.sent, new)
            value = np.where(self.sent[at] == new, self.score[at], np.nan)
            out[missing] = value[back]
            at = ((new * U64(0x9E3779B97F4A7C15)) >> U64(64 - _CACHE_BITS)).astype(np.int64)
            self.keys[at] = new
            self.values[at] = 0
            mine = self.keys[at] == new
            self.values[at[mine]] = value[mine]
        ends = np.cumsum(sizes)
        others = np.flatnonzero(np.isnan(out))
        out[others] = 0
        cuts = np.searchsorted(others, np.append(0, ends))
        rest = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            k, tf = np.unique(g[others[a:b]], return_counts=True)
            rest.append((k.tobytes(), tf.astype(np.int64).tobytes()))
        return np.add.reduceat(out, np.append(0, ends[:-1])), rest


def held_out(key, parts: int = 10):
    """Whether crc32 of the key's text is divisible by ``parts``; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)) == 0, F.lit(False))


_WORDS = pa.schema([("word", pa.string()), ("c", pa.int64()), ("everywhere", pa.int64())])


def _count_words(source):
    def rows(held, train):
        for w, n in held.items():
            yield w.decode(), train.get(w, 0), n

    held, train_only = Counter(), Counter()
    for b in source:
        for out, x in zip(b.column(0).to_pylist(), b.column(1)):
            w = (x.as_py() or b"").translate(LOWER).split()
            held.update(w)
            held[b""] += 1
            if not out:
                train_only.update(w)
                train_only[b""] += 1
            if len(held) > 400_000:
                yield from batches(rows(held, train_only), _WORDS, 50_000)
                held, train_only = Counter(), Counter()
    yield from batches(rows(held, train_only), _WORDS, 50_000)


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte`` for every row.

    Learns from the rows that are not held out. Null and empty texts have the
    end token alone and are scored for it. ``score`` is log10 of the tree's
    probability of the lower-cased (A-Z) UTF-8 bytes and an end;
    ``bits_per_byte`` is the code length for each of the ``n_bytes`` bytes, null
    where there are none. Repeated rows and
    null keys are rows like others; an empty table gives no rows. Whole texts
    are read; the smoothing of ``base_score`` is the contract's.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctw")
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), utf8(text).alias("data"))
    # a null text teaches the tree nothing, but its end is scored like any other
    strings, shallow = grow(slim.select((F.col("held_out") | F.col("data").isNull()).alias("held_out"), "data"), scratch)
    shallow = spark.sparkContext.broadcast(shallow)  # depths 0 to 2
    most = -(-SENT * SEGMENTS // _segments(slim))
    valued = scratch.save(strings.mapInArrow(_score_strings(shallow, most), "sent boolean, grams binary, scores binary"))
    got = valued.where("sent").select("grams", "scores").toArrow()  # SEGMENTS * SENT at most
    k, v = (np.frombuffer(b"".join(got.column(n).to_pylist()), kind) for n, kind in (("grams", U64), ("scores", np.float64)))
    order = np.argsort(k)
    sent = spark.sparkContext.broadcast((k[order], v[order]))
    del got, k, v, order
    counts = scratch.save(slim.select("held_out", "data").mapInArrow(_count_words, "word string, c long, everywhere long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("everywhere").alias("everywhere")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    below = total + 0.1 * (distinct + 1)
    heavy = {r[0].encode(): r[1] for r in counts.where(F.octet_length("word") <= HEAVY_BYTES).orderBy(F.desc("everywhere"), "word").limit(HEAVY).select("word", "c").collect()}
    known = spark.sparkContext.broadcast(heavy)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rest", pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())]))), ("grams", pa.binary()), ("gram_tf", pa.binary())])

    def run(source):
        scorer = _Scorer(sent.value)
        logs = {w: float(np.log10((c + 0.1) / below)) for w, c in known.value.items()}
        sure = {w for w, c in known.value.items() if c}

        def words_of(x):
            w = Counter(x.split())
            w[b""] += 1
            n = n_known = 0
            base, rest = 0.0, []
            for t, f in w.items():
                n += f
                if t in logs:
                    base += f * logs[t]
                    n_known += f if t in sure else 0
                else:
                    rest.append({"word": t.decode(), "tf": f})
            return n, n_known, base, rest

        def rows(b):
            at = 0
            ids, outs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for texts in _text_groups(b.column(2), _CHUNK // 2):
                for t, s, more in zip(texts, *scorer(texts)):
                    n, n_known, base, rest = words_of(t)
                    yield ids[at], outs[at], n, len(t), n_known, base, float(s), rest, *more
                    at += 1

        for b in source:
            yield from batches(rows(b), schema, 2_000)

    scored = scratch.save(slim.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, score double, rest array<struct<word: string, tf: long>>, grams binary, gram_tf binary").withColumn("rid", F.monotonically_increasing_id()))
    rest = scored.select("rid", F.explode("rest").alias("r")).select("rid", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    rest = rest.join(counts.select("word", "c"), "word").select("rid", (F.col("tf") * F.log10((F.col("c") + 0.1) / F.lit(below))).alias("more"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("more_known"), F.lit(0.0).alias("more_score"))
    others = scored.where(F.octet_length("grams") > 0).select("rid", "grams", "gram_tf").mapInArrow(_spread(np.int64, ["rid", "gram", "tf"]), "rid long, gram long, tf long")
    scores = valued.where("not sent").select("grams", "scores").mapInArrow(_spread(np.float64, ["gram", "s"]), "gram long, s double")
    others = others.join(scores, "gram").select("rid", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("more_known"), (F.col("tf") * F.col("s")).alias("more_score"))
    rest = rest.unionByName(others).groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("more", "more_known", "more_score")])
    out = scored.drop("rest", "grams", "gram_tf").join(rest, "rid", "left")
    score, n_known = F.col("score") + F.coalesce("more_score", F.lit(0.0)), F.col("known") + F.coalesce("more_known", F.lit(0))
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes"))
    return out.select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), score.alias("score"), "n_bytes").withColumn("bits_per_byte", bits)
