"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its words: what
they look like (kinds of bytes, marks, shape), and which they are, by hashed
tables of words and of their beginnings and ends whose rows are learned. A gated
attention layer, learned from document labels alone, weighs the passages, and
the weighted representation is scored by a logistic unit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, U64, give_back, mix, only, quoted, ready, store, utf8

#: Words of a passage, hashed shape features, rows of the learned tables of words and of their ends.
PASSAGE, SHAPES, WORD_ROWS, END_ROWS = 48, 16, 256, 128
#: Bounds of training: labelled documents, and passages of each, evenly spaced where it has more.
TRAIN_ROWS, TRAIN_PASSAGES = 4096, 24
#: Punctuation counted on its own; plain, in natural order.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]_{|}~"
_N_WORD = 10 + len(MARKS) + SHAPES
_N_PLAIN = _N_WORD + 4
N_FEATURES = _N_PLAIN + WORD_ROWS + END_ROWS
_WORDS_KEPT = 60_000


#: Kinds of bytes: upper, lower, digit, outside ASCII, other mark, then MARKS.
_KINDS = 5 + len(MARKS)
_KIND = np.full(256, 4, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[np.frombuffer(MARKS, np.uint8)] = np.arange(5, _KINDS)
#: Multipliers of a shape's places, and of a word's bytes.
_PLACES = mix(np.arange(1, 13, dtype=U64)) | U64(1)
_BYTE_PLACES = mix(np.arange(101, 165, dtype=U64)) | U64(1)


def word_rows(words: list[bytes]) -> np.ndarray:
    """Three rows of the learned tables for each word: the word's (A-Z lowered), its first and its last three bytes'.

    A word is told by its first 64 bytes and its length.
    """
    n = len(words)
    data = np.frombuffer(b"".join(words).translate(LOWER), np.uint8).astype(U64) + U64(1)
    size = np.fromiter(map(len, words), np.int64, n)
    start = np.cumsum(size) - size
    place = np.arange(len(data)) - np.repeat(start, size)
    back = np.repeat(size, size) - 1 - place
    out = np.empty((n, 3), np.int16)
    for k, (use, at, rows, base) in enumerate(((place < 64, np.minimum(place, 63), WORD_ROWS, 0), (place < 3, np.minimum(place, 63), END_ROWS // 2, WORD_ROWS), (back < 3, np.minimum(back, 63), END_ROWS // 2, WORD_ROWS + END_ROWS // 2))):
        h = np.add.reduceat(np.where(use, data * _BYTE_PLACES[at], U64(0)), start) + size.astype(U64) * (k == 0)
        out[:, k] = base + (mix(h) % U64(rows)).astype(np.int64)
    return out


def word_features(words: list[bytes]) -> np.ndarray:
    """One row for each word: letters by kind, marks, and a signed hash of its shape (runs of kinds)."""
    n = len(words)
    out = np.zeros((n, _N_WORD), np.float32)
    kind = _KIND[np.frombuffer(b"".join(words), np.uint8)]
    size = np.fromiter(map(len, words), np.int64, n)
    start, who = np.cumsum(size) - size, np.repeat(np.arange(n), size)
    counts = np.bincount(who * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float32)
    marks = counts[:, 4:].sum(1)
    out[:, 0] = np.minimum(size, 40) / 8
    out[:, 1:5] = counts[:, :4] / size[:, None]
    out[:, 5] = marks / size
    out[:, 6] = (counts[:, 0] > 1) & (counts[:, 1] == 0)
    out[:, 7] = kind[start] == 0
    out[:, 8] = marks == size
    out[:, 9] = kind[start + size - 1] >= 4
    out[:, 10 : 10 + len(MARKS)] = np.minimum(counts[:, 5:], 3) / 3
    coarse = np.where(kind == 3, 1, kind).astype(U64)
    first = np.ones(len(coarse), bool)
    first[1:] = coarse[1:] != coarse[:-1]
    first[start] = True
    place = np.cumsum(first)
    place -= np.repeat(place[start], size)
    h = mix(np.add.reduceat(np.where(first & (place < 12), (coarse + U64(1)) * _PLACES[np.minimum(place, 11)], U64(0)), start))
    out[np.arange(n), 10 + len(MARKS) + (h % U64(SHAPES)).astype(np.int64)] = np.where((h >> U64(32)) & U64(1), 1.0, -1.0)
    return out


class _WordTable:
    """Features and table rows of words seen; starts again when full."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.rows, self.places = np.empty((16_384, _N_WORD), np.float32), np.empty((16_384, 3), np.int16)

    def learn(self, texts: list[list[bytes]]) -> None:
        """Makes sure that all words of these texts are there."""
        if len(self.at) > _WORDS_KEPT:
            self.__init__()
        new = list(set().union(*texts).difference(self.at))
        n = len(self.at)
        while n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.places = np.concatenate([self.places, np.empty_like(self.places)])
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.rows[n + i : n + i + len(part)] = word_features(part)
            self.places[n + i : n + i + len(part)] = word_rows(part)
        self.at.update(zip(new, range(n, n + len(new))))


_TABLE = _WordTable()
store("quality", _TABLE.__init__)


def encode_many(texts: list[bytes | None]) -> list[np.ndarray]:
    """Each text's passages: one row of features for each; a text without words is one passage of zeros."""
    only("quality")
    cut = [t.split() if t else [] for t in texts]
    _TABLE.learn(cut)
    return [_encode(w) for w in cut]


def encode_passages(data: bytes | None) -> np.ndarray:
    """The passages of one text."""
    return encode_many([data])[0]


def _encode(w: list[bytes]) -> np.ndarray:
    if not w:
        return np.zeros((1, N_FEATURES), np.float32)
    idx = np.fromiter(map(_TABLE.at.__getitem__, w), np.int64, len(w))
    starts = np.arange(0, len(w), PASSAGE)
    n = np.diff(np.append(starts, len(w))).astype(np.float32)
    out = np.empty((len(starts), N_FEATURES), np.float32)
    for at in range(0, len(starts), 512):  # long texts in parts
        lo, hi = starts[at], min(len(w), (at + 512) * PASSAGE)
        out[at : at + 512, :_N_WORD] = np.add.reduceat(_TABLE.rows[idx[lo:hi]], starts[at : at + 512] - lo, axis=0)
        many = len(starts[at : at + 512])
        passage = np.arange(hi - lo) // PASSAGE * (WORD_ROWS + END_ROWS)
        held = np.bincount((_TABLE.places[idx[lo:hi]] + passage[:, None]).ravel(), minlength=many * (WORD_ROWS + END_ROWS))
        out[at : at + 512, _N_PLAIN:] = held.reshape(many, -1)
    out[:, :_N_WORD] /= n[:, None]
    out[:, _N_PLAIN:] /= n[:, None]
    same1 = np.zeros(len(w), np.float32)
    same1[1:] = idx[1:] == idx[:-1]
    same2 = np.zeros(len(w), np.float32)
    same2[2:] = idx[2:] == idx[:-2]
    out[:, _N_WORD] = np.add.reduceat(same1, starts) / n
    out[:, _N_WORD + 1] = np.add.reduceat(same2, starts) / n
    out[:, _N_WORD + 2] = np.log1p(n)
    out[:, _N_WORD + 3] = 1.0
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionMIL:
    """Encoder tanh(Wx), gated attention softmax(w . (tanh(Vh) * sigmoid(Uh))), logistic head.

    ``W`` has a row for each feature, those of the hashed tables included: these are the learned vectors of words.
    """

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": init(N_FEATURES, hidden), "b": np.zeros(hidden, np.float32), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate, 1)[:, 0], "c": init(hidden, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.p["W"][:_N_PLAIN] = init(_N_PLAIN, hidden)
        self.p["W"][_N_PLAIN:] *= 0.1  # words speak up only as far as labels teach it
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)

    def _forward(self, x, starts, p):
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(np.clip(e - np.repeat(np.maximum.reduceat(e, starts), sizes), -60, 0))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, t, g, a, z, z @ p["c"] + p["d"][0], sizes

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of bags: rows of ``x`` from each start to the next."""
        return _sigmoid(self._forward((x - self.mean) / self.scale, starts, self.p)[5])

    def attention(self, x: np.ndarray) -> np.ndarray:
        """The weights of one document's passages."""
        return self._forward((x - self.mean) / self.scale, np.array([0]), self.p)[3]

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Derivatives of the mean log loss of bags (rows standardised already) by every parameter."""
        p = self.p
        h, t, g, a, z, logit, sizes = self._forward(x, starts, p)
        dl = ((_sigmoid(logit) - y) / len(y)).astype(x.dtype)
        dz = np.repeat(dl, sizes)[:, None] * p["c"]
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (dz * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": ((t * g) * de[:, None]).sum(0), "c": z.T @ dl, "d": np.array([dl.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> AttentionMIL:
        """Adam on the log loss; document labels only."""
        if not len(bags):
            return self
        n = sum(map(len, bags))
        self.mean = sum(b.sum(0, dtype=np.float64) for b in bags) / n
        self.scale = np.sqrt(sum(((b - self.mean) ** 2).sum(0) for b in bags) / n) + 1e-2
        self.mean, self.scale = self.mean.astype(np.float32), self.scale.astype(np.float32)
        rng, p = np.random.default_rng(seed), self.p
        m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        p["d"][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        for epoch in range(epochs):
            lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                x = (np.concatenate([bags[i] for i in pick]).astype(np.float32) - self.mean) / self.scale
                starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])[:-1]]).astype(np.int64)
                grad = self.gradients(x, starts, y[pick])
                step += 1
                for k in p:
                    gk = grad[k] + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.999 * v[k] + 0.001 * gk * gk
                    p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def is_held_out(key, parts: int = 4, part: int = 2):
    """crc32 of the key's text leaves ``part`` when divided by ``parts``."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def _spaced(bag: np.ndarray, most: int) -> np.ndarray:
    """At most so many passages, evenly spaced, the first and the last among them."""
    return bag if len(bag) <= most else bag[np.linspace(0, len(bag) - 1, most).astype(np.int64)]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, passages: int = TRAIN_PASSAGES, text: str = "text", key: str = "doc_id") -> AttentionMIL:
    """A model from at most ``rows`` labelled documents outside the held-out part, with ``passages`` passages of each.

    The bounded sample is taken by a hash of the key, so it does not hang on the
    order of rows; of rows that repeat a key the one with the smallest hash of
    its text counts. Labels that are null are left out; of contradicting labels
    of one key the lower counts. Only ``text`` is an input. Without any labelled
    document every score is one half.
    """
    ready(docs.sparkSession)
    chosen = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull() & ~is_held_out(F.col(key))).groupBy(F.col(key).alias("_k")).agg((F.min("quality") > 0).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("_k"), "_k").limit(rows)
    picked = docs.select(F.col(key).alias("_k"), utf8(text).alias("data")).join(F.broadcast(chosen), "_k")  # ``rows`` keys at most

    def run(source):
        for b in source:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                bags = [_spaced(bag, passages).astype(np.float16) for bag in encode_many(part.column(1).to_pylist())]
                yield pa.record_batch([part.column(0), part.column(2), part.column(3), pa.array([x.tobytes() for x in bags], pa.binary())], names=["k", "y", "h", "bag"])

    encoded = picked.select(F.col("_k").cast("long"), "data", "y", F.xxhash64("data").alias("h")).mapInArrow(run, "k long, y int, h long, bag binary")
    got = encoded.groupBy("k").agg(F.min_by(F.struct("y", "bag"), "h").alias("s")).select("k", "s.y", "s.bag").toArrow()  # ``rows`` rows of ``passages`` passages at most
    keys = np.asarray(got["k"])
    order = np.argsort(keys)
    bags = [np.frombuffer(got["bag"][int(i)].as_buffer(), np.float16).reshape(-1, N_FEATURES) for i in order]
    model = AttentionMIL().fit(bags, np.asarray(got["y"])[order].astype(np.float32))
    del got, bags
    give_back()
    return model


def score_documents(docs: DataFrame, model: AttentionMIL, text: str = "text", columns: tuple[str, ...] = ("doc_id",), score: str = "score") -> DataFrame:
    """``columns`` and ``score`` (a name that is not among them) for every row; whole texts, no shuffle.

    Null and empty texts are one passage of zeros and get a score, too. Repeated
    rows and null keys are scored like others; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers
    slim = docs.select(utf8(text).alias("c"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(columns, slim.schema.fields[1:])), T.StructField(score, T.DoubleType())])

    def run(source):
        for b in source:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                bags = encode_many(part.column(0).to_pylist())
                starts = np.concatenate([[0], np.cumsum([len(x) for x in bags])[:-1]]).astype(np.int64)
                out = held.value.score(np.concatenate(bags), starts).astype(np.float64)
                yield pa.record_batch([*part.columns[1:], pa.array(out)], names=[*columns, score])

    return slim.mapInArrow(run, schema)
