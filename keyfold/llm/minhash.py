"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Two permutations give all coordinates of a signature: the first scatters a
shingle over a universe of D places, the second, shifted circularly by k
places, ranks them for coordinate k. A shingle's values for all coordinates
are therefore one slice of the second permutation's table.

Documents with equal shingle sets form a class at once. Classes that share a
band are candidates. Each class is verified against one hub; components follow.
Where a band still joins several components, the members outside its largest
component are compared with all by their signatures, which tell what may be
linked, and that is verified exactly, in blocks. So a group of n copies costs
about n comparisons, not n squared, and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, join_hot, mix, only, sift, store, utf8, words
from .components import connected

#: Coordinates, bands (of COORDS / BANDS rows) and the universe of the permutations.
COORDS, BANDS, UNIVERSE_BITS = 128, 32, 20
#: Members verified against a copy of a hub's text; documents of a block in the later steps.
HUB_BLOCK, SIG_BLOCK, LEFT_BLOCK, RIGHT_BLOCK = 64, 512, 128, 256
_P = U64(0x9E3779B97F4A7C15)
_WORDS_KEPT = 200_000


class _WordHash(dict):
    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(w) <= 64:
            if len(self) >= _WORDS_KEPT:
                self.clear()
            self[w] = h
        return h


_HASHES = _WordHash()
store("minhash", _HASHES.clear)


def shingle_set(data: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer words than the width are one shingle, no words none."""
    w = words(data)
    if not w:
        return np.empty(0, U64)
    h = np.fromiter(map(_HASHES.__getitem__, w), U64, len(w))
    n = max(1, len(w) - width + 1)
    acc = np.zeros(n, U64)
    for k in range(min(width, len(w))):
        acc = acc * _P + h[k : k + n]
    return np.unique(mix(acc + U64(min(width, len(w)))))


class CirculantMinHash:
    """Signatures by two permutations, one circularly shifted."""

    def __init__(self, coords: int = COORDS, bands: int = BANDS, bits: int = UNIVERSE_BITS, seed: int = 1):
        self.coords, self.bands, self.shift = coords, bands, U64(64 - bits)
        self.seed = mix(np.array([seed], U64))[0]
        table = np.random.default_rng(seed).permutation(1 << bits).astype(np.uint32)
        wrapped = np.concatenate([table, table[:coords]])
        self.slices = np.lib.stride_tricks.sliding_window_view(wrapped, coords)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of coordinates for each non-empty set."""
        out = np.empty((len(sets), self.coords), np.uint32)
        i = 0
        while i < len(sets):
            j, n = i, 0
            while j < len(sets) and (j == i or n + len(sets[j]) <= 8192):
                n += len(sets[j])
                j += 1
            if j == i + 1 and n > 8192:
                out[i] = np.min([self.slices[self._places(sets[i][k : k + 8192])].min(0) for k in range(0, n, 8192)], axis=0)
            else:
                starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]], dtype=np.int64)]).astype(np.int64)
                out[i:j] = np.minimum.reduceat(self.slices[self._places(np.concatenate(sets[i:j]))], starts, axis=0)
            i = j
        return out

    def _places(self, h: np.ndarray) -> np.ndarray:
        return (mix(h ^ self.seed) >> self.shift).astype(np.int64)

    def band_keys(self, sig: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band; the band's number is part of it."""
        rows = sig.reshape(len(sig), self.bands, -1).astype(U64)
        key = np.tile(np.arange(1, self.bands + 1, dtype=U64), (len(sig), 1))
        for r in range(rows.shape[2]):
            key = mix(key * _P + rows[:, :, r])
        return key.astype(np.int64)


_MINHASH: dict[tuple, CirculantMinHash] = {}


def _minhash(*key) -> CirculantMinHash:
    if key not in _MINHASH:
        _MINHASH[key] = CirculantMinHash(*key)
    return _MINHASH[key]


def _signer(width: int):
    def run(source):
        only("minhash")
        mh = _minhash(COORDS, BANDS, UNIVERSE_BITS, 1)
        for b in source:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sets = [shingle_set(x.as_py(), width) for x in part.column(1)]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = mh.signatures([sets[i] for i in full])
                keys = np.zeros((len(sets), BANDS), np.int64)
                low = np.zeros((len(sets), COORDS), np.uint8)
                if full:
                    keys[full], low[full] = mh.band_keys(sig), sig.astype(np.uint8)
                digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                h1 = np.array([d & (2**64 - 1) for d in digests], U64).astype(np.int64)
                h2 = np.array([d >> 64 for d in digests], U64).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sets) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.record_batch([part.column(0), part.column(2), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(h1), pa.array(h2), lists, pa.array([r.tobytes() for r in low], pa.binary())], names=["doc_id", "th", "n_shingles", "h1", "h2", "bands", "sig"])

    return run


def _units(source, key_columns: int) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of sorted rows: the key and the columns after it."""
    key, held = None, None
    for b in source:
        columns = [c.to_pylist() for c in b.columns]
        for row in zip(*columns):
            if row[:key_columns] != key:
                if held:
                    yield key, held
                key, held = row[:key_columns], []
            held.append(row[key_columns:])
    if held:
        yield key, held


def _linked(a: int, b: np.ndarray, inter: np.ndarray, percent: int) -> np.ndarray:
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * inter >= percent * (a + b - inter)


def _intersections(sets: list[np.ndarray], left: list[int], right: list[int]):
    """For each of ``left``: the sizes of its intersections with ``right``."""
    sizes = np.array([len(s) for s in sets])
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    places = [dense[bounds[i] : bounds[i + 1]] for i in range(len(sets))]
    flat = np.concatenate([places[j] for j in right])
    starts = np.concatenate([[0], np.cumsum(sizes[right])[:-1]])
    mark = np.zeros(int(dense.max()) + 1, bool)
    for i in left:
        mark[places[i]] = True
        yield i, np.add.reduceat(mark[flat].astype(np.int64), starts), sizes[right]
        mark[places[i]] = False


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=_EDGE)


def _verify_hub(width: int, percent: int):
    """Rows (hub, block, c, data): links of each c to its hub."""

    def run(source):
        only("minhash")
        for (hub, _), rows in _units(source, 2):
            by = dict(rows)
            ids = list(by)
            if hub not in by or len(ids) < 2:
                continue
            sets = [shingle_set(by[i], width) for i in ids]
            h = ids.index(hub)
            others = [i for i in range(len(ids)) if i != h]
            for _, inter, sizes in _intersections(sets, [h], others):
                ok = _linked(len(sets[h]), sizes, inter, percent)
                if ok.any():
                    yield _edge_batch([(ids[others[k]], hub) for k in np.flatnonzero(ok)])

    return run


class _Union:
    """Components of a unit; tells which links join two of them."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _compare_signatures(least: int):
    """Rows (bucket, i, j, is_left, c, comp, sig): pairs of components that may be linked, by members of the left side."""

    def run(source):
        for _, rows in _units(source, 3):
            rows = list({c: (left, c, comp, sig) for left, c, comp, sig in sorted(rows, key=lambda r: r[0])}.values())  # a member of both sides: left
            comps = np.array([r[2] for r in rows])
            if (comps == comps[0]).all():
                continue
            sigs = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
            union, found = _Union(), []
            for i in (k for k, r in enumerate(rows) if r[0]):
                near = np.flatnonzero(comps != comps[i])
                near = near[(sigs[near] == sigs[i]).sum(1) >= least]
                found += [(int(comps[i]), c) for c in np.unique(comps[near]).tolist() if union.join(int(comps[i]), c)]
            if found:
                yield _edge_batch(found)

    return run


def _verify_blocks(width: int, percent: int):
    """Rows (cluster, i, j, left, c, comp, data): links between components of a cluster."""

    def run(source):
        only("minhash")
        for _, rows in _units(source, 3):
            sides: dict[int, list] = {}
            for left, c, comp, data in rows:
                held = sides.setdefault(c, [False, comp, data])
                held[0] |= left
            ids = list(sides)
            if len(ids) < 2:
                continue
            comps = np.array([sides[c][1] for c in ids])
            if (comps == comps[0]).all():
                continue
            sets = [shingle_set(sides[c][2], width) for c in ids]
            union, found = _Union(), []
            for i, inter, sizes in _intersections(sets, [k for k, c in enumerate(ids) if sides[c][0]], list(range(len(ids)))):
                ok = _linked(len(sets[i]), sizes, inter, percent) & (comps != comps[i])
                found += [(int(comps[i]), c) for c in np.unique(comps[ok]).tolist() if union.join(int(comps[i]), c)]
            if found:
                yield _edge_batch(found)

    return run


def _blocks(n, size: int):
    return F.ceil(n / F.lit(size)).cast("int")


def _block_of(n):
    return F.pmod(F.xxhash64("c"), n).cast("int")


def _against_main(placed: DataFrame, group: str, left_block: int, right_block: int) -> DataFrame:
    """``group, i, j, is_left, c, comp`` and what else ``placed`` has: the blocks in which members meet.

    ``placed`` has each group's members with ``m`` (their number), ``main`` (its
    largest component) and ``most`` (that one's members). Members outside the
    main component are the left side, all members the right one: rows grow with
    the members outside times all, over the block, and not with their square. A
    group of up to ``right_block`` members is one block.
    """
    one = F.col("m") <= right_block
    placed = placed.withColumns({"nl": F.when(one, 1).otherwise(_blocks(F.col("m") - F.col("most"), left_block)), "nr": F.when(one, 1).otherwise(_blocks(F.col("m"), right_block)), "outside": F.col("comp") != F.col("main")})
    rest = [c for c in placed.columns if c not in (group, "m", "main", "most", "nl", "nr", "outside", "n")]
    alone = F.col("nr") == 1
    right = placed.select(group, F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"), _block_of(F.col("nr")).alias("j"), (alone & F.col("outside")).alias("is_left"), *rest)
    left = placed.where(F.col("outside") & ~alone).select(group, _block_of(F.col("nl")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"), F.lit(True).alias("is_left"), *rest)
    return left.unionByName(right)


def _shape(sizes: DataFrame, group: str) -> DataFrame:
    """``group, m, main, most`` of groups with several components, from ``group, comp, n``."""
    return sizes.groupBy(group).agg(F.sum("n").alias("m"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most")).where("most < m")


def _decide(docs: DataFrame, width: int, percent: int, text: str, key: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written tables: each row's ``doc_id, th, n_shingles, h1, h2``; each class of equal sets' ``h1, h2, label, top``.

    ``th`` is the text's hash, ``label`` the class's smallest key, ``top`` its component.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("data"))
    th = F.xxhash64("data")
    signed = slim.withColumn("th", th).mapInArrow(_signer(width), "doc_id long, th long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary")
    rows = scratch.save(signed.withColumn("rid", F.monotonically_increasing_id()))
    # classes of equal sets
    classes = scratch.save(rows.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("rid").alias("c"), F.min("doc_id").alias("label")))
    reps = scratch.save(rows.join(classes.select(F.col("c").alias("rid")), "rid").select(F.col("rid").alias("c"), "doc_id", "th", "bands", "sig"))
    total = BANDS * classes.count()
    banded = reps.select("c", F.explode("bands").alias("bucket"))
    hubs = scratch.save(banded.groupBy("bucket").agg(F.min("c").alias("hub"), F.count("*").alias("m")).where("m > 1"))
    members = scratch.save(join_hot(banded, hubs, "bucket", "m", total).select("bucket", "c", "hub"))
    candidates = members.select("c").distinct()
    # the texts of the candidates, read once more: a class is found by key and text;
    # texts that are surely no candidate's stay where they are
    wanted = scratch.save(reps.join(candidates, "c").select("c", F.col("doc_id").alias("k"), F.col("th").alias("t"), "sig"))
    scratch.drop(reps, hubs)
    sigs, keys = wanted.select("c", "sig"), wanted.select("c", "k", "t")
    again, _ = sift(slim.where("data is not null").withColumn("th", th), F.col("th"), wanted, "t", scratch)
    texts = scratch.save(again.join(keys, again["doc_id"].eqNullSafe(keys["k"]) & (again["th"] == keys["t"])).select("c", "data"))
    if not texts.groupBy("c").count().where("count > 1").isEmpty():  # rows that repeat key and text
        texts = scratch.save(texts.dropDuplicates(["c"]))

    # 1: each class against the hub that it shares most bands with
    shared = members.where("c <> hub").groupBy("c", "hub").count()
    best = scratch.save(shared.groupBy("c").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub")))
    deg = scratch.save(best.groupBy("hub").agg(F.count("*").alias("m"), _blocks(F.count("*"), HUB_BLOCK).alias("n")))
    placed = join_hot(best, deg, "hub", "m", total).select("hub", _block_of(F.col("n")).alias("block"), "c")
    with_hub = placed.unionByName(deg.select("hub", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.col("hub").alias("c")))
    pairs = with_hub.join(texts, "c").select("hub", "block", "c", "data").repartition("hub", "block").sortWithinPartitions("hub", "block")
    links = scratch.save(pairs.mapInArrow(_verify_hub(width, percent), "a long, b long"))
    comps = scratch.save(connected(links, scratch))

    # 2: bands that still join several components; signatures tell which may be linked
    comp_of = members.select("bucket", "c").join(comps.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    comp_of = scratch.save(comp_of)
    scratch.drop(members, best, deg, links)
    open_ = scratch.save(_shape(comp_of.groupBy("bucket", "comp").agg(F.count("*").alias("n")), "bucket"))
    merged = None if open_.isEmpty() else _between(comp_of, open_, sigs, texts, width, percent, total, scratch)

    final = classes.join(comps.withColumnRenamed("node", "c"), "c", "left").withColumn("top", F.coalesce("comp", "c"))
    if merged is not None:
        final = final.join(merged.select(F.col("node").alias("top"), F.col("comp").alias("higher")), "top", "left").withColumn("top", F.coalesce("higher", "top"))
    final = scratch.save(final.select("h1", "h2", "label", "top"))
    scratch.drop(classes, comps, comp_of, open_, texts, wanted)
    return rows, final


def _between(comp_of: DataFrame, open_: DataFrame, sigs: DataFrame, texts: DataFrame, width: int, percent: int, total: int, scratch: Scratch) -> DataFrame | None:
    """``node, comp``: components that are one by links between members of the same band; None if there are none."""
    tied = join_hot(comp_of, open_, "bucket", "m", total).join(sigs, "c")
    least = math.floor(COORDS * percent / 100 - 6.5 * math.sqrt(COORDS * percent / 100 * (1 - percent / 100)))
    units = _against_main(tied, "bucket", SIG_BLOCK, SIG_BLOCK).select("bucket", "i", "j", "is_left", "c", "comp", "sig")
    maybe = scratch.save(units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_compare_signatures(least), "a long, b long"))
    if maybe.isEmpty():
        return None

    # 3: exact verification between the components of each cluster, in blocks
    clusters = scratch.save(connected(maybe, scratch).select(F.col("node").alias("comp"), F.col("comp").alias("cluster")))
    inside = scratch.save(comp_of.select("c", "comp").distinct().join(clusters, "comp"))
    shape = scratch.save(_shape(inside.groupBy("cluster", "comp").agg(F.count("*").alias("n")), "cluster"))
    blocks = _against_main(join_hot(inside, shape, "cluster", "m", total), "cluster", LEFT_BLOCK, RIGHT_BLOCK)
    blocks = blocks.join(texts, "c").select("cluster", "i", "j", "is_left", "c", "comp", "data").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    more = scratch.save(blocks.mapInArrow(_verify_blocks(width, percent), "a long, b long"))
    scratch.drop(maybe, clusters, inside, shape)
    return connected(more, scratch)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of docs.

    Documents are linked when 100 * intersection >= percent * union of their
    sets of ``width``-word shingles. ``component_id`` is the smallest key that
    links reach. Null and empty texts have no shingles and are linked with
    nothing. Equal texts have equal sets and share a component; repeated rows
    stay, and both are kept if both carry the smallest key; a null key takes
    part in links but never is the component's id while another key is there.
    Other columns are ignored; an empty table gives no rows.

    With 32 bands of 4 coordinates a pair at similarity 0.85 (0.8) shares no
    band with probability 6e-11 (5e-8).
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    rows, final = _decide(docs, width, percent, text, key, scratch)
    # the smallest key of each component, back to every row
    smallest = scratch.save(final.groupBy("top").agg(F.min("label").alias("component_id"), F.count("*").alias("n")))
    by_set = scratch.save(join_hot(final, smallest, "top", "n", final.count()).select("h1", "h2", "component_id"))
    out = rows.select("doc_id", "n_shingles", "h1", "h2").join(by_set, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all columns: one row of each component of ``near_duplicates``.

    It is the row with the smallest key (a null key only where the component has
    no other), then the smallest hash of the text; of rows that repeat key and
    text one stays, and which of them, if other columns differ, is left open.
    The decision is a row's own, so repeated and null keys hide no copy. Texts
    that are null or without words are in no component, and all those rows stay.
    Columns may have any names; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    rows, final = _decide(docs, width, percent, text, key, scratch)
    tops = final.select("h1", "h2", "top")
    placed = scratch.save(rows.where("n_shingles > 0").select("doc_id", "th", "h1", "h2").join(tops, ["h1", "h2"]).select("doc_id", "th", "top"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("keyless"), "doc_id", "th")).alias("first")
    groups = scratch.save(placed.groupBy("top").agg(first, F.count("*").alias("n")).where("n > 1"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    several = join_hot(placed, groups, "top", "n", placed.count()).withColumn("stays", stays)
    # rows that go, and those that stay once of several
    decided = scratch.save(several.groupBy(F.col("doc_id").alias("k"), F.col("th").alias("t")).agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("n > 1 or not stays"))
    scratch.drop(rows, final, placed, groups)
    packed = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("k"), F.xxhash64(utf8(text)).alias("t"))
    suspect, clear = sift(packed, F.col("t"), decided, "t", scratch)
    # whole texts are shuffled only where the text may be one of those
    held = suspect.join(decided.select(F.col("k").alias("dk"), F.col("t").alias("dt"), "stays"), F.col("k").eqNullSafe(F.col("dk")) & (F.col("t") == F.col("dt")), "left")
    rest = held.where(F.coalesce("stays", F.lit(True))).dropDuplicates(["k", "t"])
    return clear.select("row.*").unionByName(rest.select("row.*"))
