"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import math
import os
import pickle
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyfold.llm import chat, common, ctw, fm_index, minhash, packing, quality, registry, sharding, tokens, topk_search, url_filters
from keyfold.session import table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: nulls in any column, empty and blank texts, ties, repeated rows, a long text, marks and special strings
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "  \n\t ", "en", "s", 5),
    (4, "One two Three four five six seven eight nine ten eleven twelve", "en", "s", 1),
    (4, "One two Three four five six seven eight nine ten eleven twelve", "en", "s", 1),
    (None, "one two three four five six seven eight nine ten eleven twelve", "en", None, 1),
    (5, "<|endoftext|>it's <|startoftext|> x\x00y\x1c \u00c9t\u00e9 e\u0301 \u4f60\u597d 12345 !!!??? don't\u2028a\u00a0b", "en", "s", 9),
    (6, "long word " * 30000, "en", "s", 300000),
    (7, "x" * 20000, "en", "s", 20000),
    (8, "a", None, "s", None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    # clashing names: columns that operators use inside
    rows = [(*r, i, 7, "clash", "rid") for i, r in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, DOC + ", row long, size long, data string, _part string")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def empty(spark):
    return spark.createDataFrame([], DOC)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---- 1: URL filters ----


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM/en/7/x?y#z", "x://example.com?/en/", "a://b://c/d", "http://Ünï.Example.net#f", "https://sub.example.net/de/81", "https://com/en/", "https://notexample.com/en/7", "http://h/p\nq?r"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filters.judge(pages, spark.createDataFrame([], "host string, good_page boolean")).collect()}

    def brute(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        rule = None
        for h, p, v in url_filters.RULES:
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (rule is None or len(h + p) > len(rule[0])):
                rule = (h + p, v)
        return host, path, rule

    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule = brute(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (rule[0] if rule else None)
        if rule:
            assert got[i]["verdict"] == rule[1]


def test_reputation_is_shrunk(spark):
    good, bad = [("good.a.com", True)] * 40, [("bad.b.com", False)] * 40
    once = [("once.a.com", False), ("x.b.com", True), ("n.c.org", None)]
    labelled = spark.createDataFrame(good + bad + once, "host string, good_page boolean")
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["good.a.com", "bad.b.com", "once.a.com", "new.a.com", "new.b.com", "new.c.org"])], "page_id long, url string")
    got = {r["host"]: r for r in url_filters.judge(pages, labelled).collect()}
    assert got["good.a.com"]["verdict"] == "allow" and got["bad.b.com"]["verdict"] == "block"
    assert got["bad.b.com"]["posterior_mean"] < got["once.a.com"]["posterior_mean"] < got["good.a.com"]["posterior_mean"]
    assert got["new.b.com"]["posterior_mean"] < got["new.a.com"]["posterior_mean"]
    assert url_filters.judge(pages.limit(0), labelled.limit(0)).count() == 0


def test_priors_by_level(spark):
    """Posterior means, strengths and bounds against plain Python."""
    rng, rows = random.Random(8), []
    for d in range(6):
        for h in range(5):
            rate = rng.random()
            rows += [(f"h{h}.d{d}.{'com' if d < 3 else 'co.uk'}", rng.random() < rate) for _ in range(rng.randrange(1, 30))]
    counts = defaultdict(lambda: [0, 0])
    for h, ok in rows:
        counts[h][0] += 1
        counts[h][1] += ok
    suffix = lambda h: "co.uk" if h.endswith("co.uk") else "com"
    domain = lambda h: h.split(".", 1)[1]

    def total(of):
        out = defaultdict(lambda: [0, 0])
        for h, (n, good) in counts.items():
            out[of(h)][0] += n
            out[of(h)][1] += good
        return out

    def level(groups, above):
        spread = sum((g - n * above[k]) ** 2 / n - above[k] * (1 - above[k]) for k, (n, g) in groups.items())
        room = sum(above[k] * (1 - above[k]) * (n - 1) for k, (n, _) in groups.items())
        t = min(50.0, max(1.0, room / spread - 1)) if spread > 0 and room > 0 else 50.0
        return t, {k: (g + t * above[k]) / (n + t) for k, (n, g) in groups.items()}

    n, good = len(rows), sum(ok for _, ok in rows)
    by_suffix, by_domain = total(suffix), total(domain)
    _, s_mean = level(by_suffix, {k: (good + 1) / (n + 2) for k in by_suffix})
    _, d_mean = level(by_domain, {k: s_mean[suffix(k)] for k in by_domain})
    t, h_mean = level(counts, {k: d_mean[domain(k)] for k in counts})
    pages = spark.createDataFrame([(i, f"http://{h}/", 1, 2.0, "x") for i, h in enumerate([*counts, *counts])], "page_id long, url string, n int, above double, suffix string")
    got = url_filters.judge(pages, spark.createDataFrame(rows, "host string, good_page boolean")).collect()
    assert len(got) == 2 * len(counts)
    for r in got:
        assert r["posterior_mean"] == pytest.approx(h_mean[r["host"]])
        n, g = counts[r["host"]]
        above = d_mean[domain(r["host"])]
        draws = np.random.default_rng(1).beta(g + t * above, n - g + t * (1 - above), 40_000)
        assert (draws < r["bound"] - 0.0025).mean() <= 0.055 and (draws < r["bound"] + 0.0025).mean() >= 0.045


def test_suffixes(spark):
    hosts = ["a.b.gov.uk", "x.y.github.io", "github.io", "one", "", "q.w.e.r.k12.ca.us", "a.b.example"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    by_rule = {r["host"]: (r["domain"], r["suffix"]) for r in url_filters.with_domains(df).collect()}
    assert by_rule["a.b.gov.uk"] == ("b.gov.uk", "gov.uk") and by_rule["x.y.github.io"] == ("github.io", "io") and by_rule["one"] == ("one", "one")
    listed = spark.createDataFrame([("github.io",), ("io",), ("uk",), ("k12.ca.us",), ("io",)], "suffix string")
    got = {r["host"]: (r["domain"], r["suffix"]) for r in url_filters.with_domains(df, listed).collect()}
    assert len(got) == len(hosts)
    assert got["x.y.github.io"] == ("y.github.io", "github.io") and got["github.io"] == ("github.io", "github.io")
    assert got["q.w.e.r.k12.ca.us"] == ("r.k12.ca.us", "k12.ca.us") and got["a.b.example"] == ("b.example", "example")


def test_urls_awkward(spark):
    """Repeated rows, very long urls and clashing columns."""
    rows = [(1, "http://a.com/" + "x" * 100_000, "a.com", 1), (1, "http://a.com/" + "x" * 100_000, "a.com", 1), (None, None, None, None), (2, "http://" + "h" * 50_000, "b", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path int")
    got = url_filters.judge(pages, spark.createDataFrame([("a.com", True), (None, None)], "host string, good_page boolean")).collect()
    assert sorted(len(r["path"]) for r in got) == [0, 0, 100_001, 100_001] and Counter(r["page_id"] for r in got) == Counter([1, 1, None, 2])


# ---- 2: exact top-k ----


def test_top_k_is_exact(spark):
    rows = table(spark, SF, "embeddings")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in registry.QUERIES["op2_topk_search"](spark, SF).collect()}
    data = {r["vec_id"]: np.floor(1024 * np.array(r["embedding"], np.float64)).astype(np.int64) for r in rows.collect()}
    for q in (i for i in data if i % 100 == 0):
        best = sorted(((-int(data[q] @ v), i) for i, v in data.items() if i != q))[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in best]


def test_top_k_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [-1.5, 0.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0])]
    v = topk_search.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(map(tuple, topk_search.top_k(v, v.where("vec_id % 100 = 0"), 3).collect()))
    assert [g for g in got if g[0] == 0] == [(0, 1, 1, 5 * 1024**2), (0, 2, 2, 5 * 1024**2), (0, 3, 100, 0)]
    assert [g[2] for g in got if g[0] == 100] == [0, 1, 2]
    assert topk_search.top_k(v.limit(0), v.limit(0), 3).count() == 0


def test_pivots_eliminate(spark):
    """Of the embeddings of sf0.1 less than half is evaluated, and the answers are exact."""
    rows = topk_search.quantise(table(spark, "/root/testdata/sf0.1", "embeddings")).orderBy("vec_id").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])
    pivots = topk_search.PivotTable(v[:500])
    entries = pivots.entry(v)
    assert pivots.axes.shape[0] == topk_search.PIVOTS < v.shape[1]
    assert (topk_search.bounds(entries[:50], entries) >= v[:50] @ v.T).all()
    # the joint bound is no looser than that of any single pivot
    x, p = v[:200].astype(float), v[:500].astype(float)[:5]
    single = topk_search.PivotTable(p)
    far = lambda a, b: np.sqrt(((a[:, None] - b) ** 2).sum(2))
    low = np.abs(far(x, p)[:, None] - far(x, p)).max(2)
    high = ((x**2).sum(1)[:, None] + (x**2).sum(1) - low**2) / 2
    entry = single.entry(x)
    assert (topk_search.bounds(entry, entry) <= high + 2 + 1e-5 * high.max()).all()
    search, asked = topk_search.Search(ids, v, entries, 10), np.flatnonzero(ids % 100 == 0)
    for q, best, scores in search.answer(ids[asked], v[asked], entries[asked], np.full(len(asked), -(2**63))):
        want = sorted((-int(v[ids == q][0] @ r), i) for i, r in zip(ids, v) if i != q)[:10]
        assert [(-s, i) for i, s in zip(best, scores)] == want
    assert search.evaluated < 0.5 * len(asked) * len(ids)


def test_top_k_in_groups(spark, monkeypatch):
    """Several groups, dimensions and repeated ids; other columns are ignored."""
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 5 if i % 3 else 3)], "q", 1) for i in rng.integers(0, 400, 600)]
    rows += [(0, [1.0] * 5, "q", 1), (100, [1.0] * 5, "q", 1), (200, [], "q", 1), (7, [], "q", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, place string, dim int")
    v = topk_search.quantise(df)
    for group in (1_000, 32_000_000):
        monkeypatch.setattr(topk_search, "GROUP_BYTES", group)
        got = sorted(map(tuple, topk_search.top_k(v, v.where("vec_id % 100 = 0"), 4).collect()))
        want = []
        for q in {r[0] for r in rows if r[0] % 100 == 0}:
            x = min(([int(1024 * c) for c in r[1]] for r in rows if r[0] == q))
            best = sorted((-sum(int(1024 * c) * b for c, b in zip(r[1], x)), r[0]) for r in rows if r[0] != q and len(r[1]) == len(x))[:4]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert got == sorted(want)


# ---- 3 and 7: tokens and packing ----


def library_ids(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids if text else []


def test_tokens_as_the_library(spark, awkward, docs):
    tok = Tokenizer.from_file(PATH)
    for df in (awkward, docs):
        got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(df, PATH).collect())
        want = Counter()
        for i, t in texts(df):
            n = len(tok.encode(t, add_special_tokens=False).ids) if t else 0
            want[i, len((t or "").encode()), n, n > 2048] += 1
        assert got == want
    assert tokens.count_tokens(empty(spark), PATH).count() == 0


def test_encoder_on_random_text():
    enc = tokens.WholeTokenEncoder(PATH, tokens.prove_whole(PATH))
    rng, tok = random.Random(3), Tokenizer.from_file(PATH)
    alphabet = list("abcXYZ '\"0129.,!?-\n\t\r\x0b\x0c\x1c\x1f\x85\u00a0\u2003\u200b") + ["\u0301", "\u00e9", "\u03a3", "\u4f60", "\U0001f600", "'s", "'ll", "<|endoftext|>", "the ", "\ufdfa", "\u0130", " \u0301"]
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
        ids = tok.encode(t, add_special_tokens=False).ids
        assert enc.count(t) == len(ids) and enc.ids(t) == np.asarray(ids, "<u4").tobytes(), repr(t)


def test_other_pre_tokenizers_are_refused(tmp_path):
    tok = Tokenizer.from_file(PATH)
    from tokenizers.pre_tokenizers import Whitespace

    tok.pre_tokenizer = Whitespace()
    tok.save(str(tmp_path / "other.json"))
    with pytest.raises(ValueError, match="pre-tokenizer"):
        tokens.prove_whole(str(tmp_path / "other.json"))


def check_packing(rows, source, capacity=2048):
    tok, want = Tokenizer.from_file(PATH), Counter()
    for i, t in source:
        ids = (tok.encode(t, add_special_tokens=False).ids if t else []) + [0]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want[i, p, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= capacity
    return len(bins), sum(r["length"] for r in rows)


def test_packing(spark, docs, awkward):
    rows = packing.pack_documents(docs, PATH).collect()
    n, total = check_packing(rows, texts(docs))
    assert n <= math.ceil(total / 2048) + 1
    check_packing(packing.pack_documents(awkward, PATH).collect(), texts(awkward))
    assert packing.pack_documents(empty(spark), PATH).count() == 0


def test_local_search_empties_bins():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(1, 70, 60)
        before = packing.best_fit(lengths, 100)
        after = packing.pack(lengths, 100)
        assert sorted(i for b in after for i in b) == list(range(60))
        assert all(lengths[b].sum() <= 100 for b in after) and len(after) <= len(before)
    # 6+4, 5+5 packed badly on purpose: an exchange makes room
    search = packing.LocalSearch(np.array([50, 30, 40, 20, 60]), [[0, 1], [2, 3], [4]], 100)
    assert len(search.run()) == 2


def test_local_search_stands_still():
    """No move or exchange between any two underfull bins is left, whatever their number."""
    lengths = np.random.default_rng(5).integers(500, 901, 1500)
    bins = packing.pack(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(1500))
    fills = [int(lengths[b].sum()) for b in bins]
    assert max(fills) <= 2048
    held = sorted((2048 - f, n) for b, f in zip(bins, fills) for n in {0, *lengths[b].tolist()})
    for b, f in zip(bins, fills):
        one = lengths[b].tolist()
        two = [x + y for k, x in enumerate(one) for y in one[k + 1 :]]
        for room, n in held:
            if 0 < room <= 2048 - f:
                if any(0 < v - n <= room for v in (one + two if n else one)):
                    others = [k for k, o in enumerate(fills) if 2048 - o == room and (not n or n in lengths[bins[k]]) and bins[k] is not b]
                    assert not others


def test_local_search_saves_sequences(spark):
    """Documents of middle length: best fit alone needs more sequences than the operator gives."""
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "a " * rng.randrange(500, 900)) for i in range(600)], "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH).collect()
    lengths = np.array([r["length"] for r in rows])
    alone = packing.best_fit(lengths, 2048)
    search = packing.LocalSearch(lengths, alone, 2048)
    search.run()
    assert len({r["sequence_id"] for r in rows}) < 0.98 * len(alone) and search.moves > 100


# ---- 4: context-tree weighting ----


def test_base_score_and_counts(spark, docs):
    got = {r["doc_id"]: r for r in ctw.score_documents(docs).collect()}
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    bags = {i: Counter([*(t or "").encode().translate(lower).split(), b""]) for i, t in texts(docs)}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in bags}
    train = Counter()
    for i, b in bags.items():
        if not out[i]:
            train.update(b)
    n, v = sum(train.values()), len(train)
    for i, b in bags.items():
        base = sum(f * math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w, f in b.items())
        assert got[i]["held_out"] == out[i] and got[i]["train_tokens"] == n and got[i]["n_tokens"] == sum(b.values())
        assert got[i]["n_known"] == sum(f for w, f in b.items() if train[w])
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)


def brute_ctw(train, text, depth):
    """The weighted tree by its definition, with dictionaries."""
    nodes = defaultdict(lambda: [0, 0])
    for t in train:
        s = bytes(depth) + t + b"\0"
        for i in range(depth, len(s)):
            for j in range(8):
                for d in range(depth + 1):
                    nodes[s[i - d : i], (1 << j) | (s[i] >> (8 - j))][(s[i] >> (7 - j)) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    children = defaultdict(list)
    for ctx, pre in nodes:
        if ctx:
            children[ctx[1:], pre].append((ctx, pre))
    memo = {}

    def weighted(node):
        if node not in memo:
            own, longer = kt(*nodes[node]), sum(map(weighted, children[node]))
            memo[node] = (own, own, None) if len(node[0]) == depth else (math.log(0.5) + max(own, longer) + math.log1p(math.exp(-abs(own - longer))), own, longer)
        return memo[node][0]

    total, s = 0.0, bytes(depth) + text + b"\0"
    for i in range(depth, len(s)):
        for j in range(8):
            p = None
            for d in range(depth, -1, -1):
                node = (s[i - d : i], (1 << j) | (s[i] >> (8 - j)))
                if node not in nodes:
                    continue
                weighted(node)
                a, b = nodes[node]
                own = (b + 0.5) / (a + b + 1)
                if p is None:
                    p = own
                else:
                    share = 1 / (1 + math.exp(min(700, memo[node][2] - memo[node][1])))
                    p = share * own + (1 - share) * p
            p = 0.5 if p is None else p
            total += math.log10(p if (s[i] >> (7 - j)) & 1 else 1 - p)
    return total


def test_tree_against_its_definition(spark):
    train = ["the cat sat on the mat", "the cat sat", "", "\u00e9t\u00e9 the dog"]
    rows = [(i, t, None, None, None) for i, t in enumerate([*train, *["the cat", "zebra the", None]] * 3)]
    got = {(r["doc_id"]): r for r in ctw.score_documents(spark.createDataFrame(rows, DOC)).collect()}
    learned = [(t or "").encode() for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 10 and t is not None]
    for i, t, *_ in rows:
        assert got[i]["score"] == pytest.approx(brute_ctw(learned, (t or "").encode(), ctw.DEPTH), rel=1e-4, abs=1e-4)


def test_tree_is_a_distribution(spark):
    """Probabilities of all next bytes sum to one after seen and unseen contexts."""
    from keyfold.llm.common import Scratch, utf8

    texts_ = spark.createDataFrame([("abracadabra " * 5,), ("the theme of the thesis",)], "text string").select(utf8().alias("data"))
    tree = ctw.train(texts_, Scratch(spark, "t"))
    for ctx in (b"abrac", b"\0\0\0\0\0", b"zzzzz", b"qqthe"):
        g = np.array([sum(c << (8 * (5 - k)) for k, c in enumerate(ctx)) | b for b in range(256)], np.uint64)
        assert (10 ** tree.log10(g)).sum() == pytest.approx(1, abs=1e-6)


def test_no_string_is_dropped(spark, monkeypatch):
    """A corpus with more nodes than a segment used to keep, and strings beyond those sent to the workers."""
    rng = random.Random(11)
    # contexts that share their nearest three bytes are in one segment
    rows = [(i, "".join(rng.choice("bcdfghjklmnpqrst") + rng.choice("bcdfghjklmnpqrst") + "xyz" + rng.choice("aeiou") for _ in range(400)), None, None, None) for i in range(20)]
    learned = [t.encode() for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 10]
    want = [brute_ctw(learned, t.encode(), ctw.DEPTH) for _, t, *_ in rows[:2]]
    for sent in (ctw.SENT, 3):
        for name in ("SENT", "NODES"):
            monkeypatch.setattr(ctw, name, sent, raising=False)
        got = {r["doc_id"]: r["score"] for r in ctw.score_documents(spark.createDataFrame(rows, DOC)).collect()}
        assert [got[0], got[1]] == pytest.approx(want, rel=1e-9)


def test_ctw_awkward(spark, awkward):
    got = ctw.score_documents(awkward).collect()
    assert len(got) == len(AWKWARD) and all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    for r in got:
        want = -r["score"] * math.log2(10) / r["n_bytes"] if r["n_bytes"] else None
        assert r["bits_per_byte"] == (want and pytest.approx(want))
    assert {r["n_bytes"] for r in got if r["doc_id"] in (6, 7)} == {300_000, 20_000}
    assert ctw.score_documents(empty(spark)).count() == 0


# ---- 5: near duplicates ----


def brute_components(source, width, percent):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in source:
        w = (t or "").encode().translate(lower).split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = defaultdict(list)
    for k, s in enumerate(sets):
        seen = Counter()
        for x in s:
            for o in index[x]:
                seen[o] += 1
            index[x].append(k)
        for o, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                up[find(k)] = find(o)
    best = defaultdict(list)
    for k, (i, _) in enumerate(source):
        best[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(source):
        ids = [x for x in best[find(k)] if x is not None]
        out.append((i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, width, percent).collect())
    assert got == Counter(brute_components(texts(df), width, percent))


def test_near_duplicate_chains(spark, monkeypatch):
    """A group whose links reach the hub only through others, with small blocks."""
    for name, n in (("HUB_BLOCK", 4), ("SIG_BLOCK", 6), ("LEFT_BLOCK", 3), ("RIGHT_BLOCK", 5)):
        monkeypatch.setattr(minhash, name, n)
    rng, rows = random.Random(4), []
    base = [f"w{k}" for k in range(150)]
    for g in range(60):
        w = list(base)
        for k in rng.sample(range(150), rng.choice([1, 2, 3, 5, 7])):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((g, " ".join(w), None, None, None))
    df = spark.createDataFrame(rows, DOC)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, 3, 85).collect())
    assert got == Counter(brute_components([(r[0], r[1]) for r in rows], 3, 85))


def test_near_duplicates_awkward(spark, awkward):
    got = minhash.near_duplicates(awkward, 3, 85).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(texts(awkward), 3, 85))
    assert all(r["kept"] for r in got if r["doc_id"] in (1, 2, 3, 4))
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    facts = common.Scratch(spark, "t").save(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k <> 900"))
    got = common.join_hot(rows, facts, "k", "n", 1000)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert Counter(map(tuple, got.select("k", "id", "top").collect())) == Counter((1 if i < 700 else i, i, 699 if i < 700 else i) for i in range(1000) if i != 900)


def test_deduplicate_by_row(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(2, a), (5, b), (5, a), (None, a), (None, "only here one two"), (None, "only here one two"), (7, "same key"), (7, "same key"), (8, "same key"), (9, None), (9, None), (10, " "), (3, b + " end")]
    docs = spark.createDataFrame([(i, t, "x", 1.0, "y", "z") for i, t in rows], "doc_id long, text string, th string, score double, row string, stays string")
    got = minhash.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(2, a), (3, b + " end"), (None, "only here one two"), (7, "same key"), (9, None), (9, None), (10, " ")], key=repr)
    assert minhash.deduplicate(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    mh = minhash.CirculantMinHash()
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    a, b = x[:900], x[100:]
    sig = mh.signatures([a, b])
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.12
    assert (mh.signatures([np.concatenate([a] * 12)])[0] == sig[0]).all()


# ---- 6: chat ----


def test_template_round_trip():
    rng = random.Random(5)
    bits = ["\\", "###", "</turn>", "#", "<", "/turn>", "\n", ":", " ", "### user: ", "a", "\u00e9", "\\\\", "\\###", "</turn>\n### x: "]
    for _ in range(500):
        turns = [("".join(rng.choice(bits) for _ in range(rng.randrange(4))) if rng.random() < 0.3 else "assistant", "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(5))]
        text, mask = chat.render(turns)
        assert list(chat.read_back(text)) == turns
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    records = [
        ('{"prompt": "p", "response": "r"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
        ('{"output": "o", "instruction": "i", "input": "x", "id": 3}', "instruction_input", [("user", "i\n\nx"), ("assistant", "o")]),
        ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}]}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', "from_value", [("user", "a"), ("assistant", "b")]),
        ('{"other": 1}', None, None),
        ("broken", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(records)], "conv_id long, record string")
    for r in chat.turns_of_records(df).collect():
        _, layout, turns = records[r["conv_id"]]
        assert r["layout"] == layout and (r["turns"] and [(t["role"], t["text"]) for t in r["turns"]]) == turns
    flat = spark.createDataFrame([(1, "i", None, "o", "extra")], "conv_id long, instruction string, input string, output string, z string")
    assert [tuple(t) for t in chat.turns_of_table(flat).first()["turns"]] == [("user", "i"), ("assistant", "o")]
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.createDataFrame([(1, 2)], "conv_id long, unknown long"))


def test_chat_rows_awkward(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (1, 1, "assistant", None), (None, 0, "user", "n"), (2, None, "assistant", "</turn>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(chat.turns_of_table(df))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nx\n" + b"assistant\n\n" * 2).hexdigest()
    assert got[2]["loss_chars"] == 7 and got[None]["n_turns"] == 1
    assert chat.digests(chat.format_turns(chat.turns_of_table(df.limit(0)))).count() == 0


def test_table_by_turn_with_other_columns(spark):
    """Columns of other layouts beside the turns change nothing."""
    df = spark.createDataFrame([(1, 0, "user", "a", "S", "I", "N", "O", "p", "r"), (1, 1, "assistant", "b", "S", "I", "N", "O", "p", "r")], "conv_id long, turn long, role string, text string, system string, instruction string, input string, output string, prompt string, response string")
    for layout in (None, "rows"):
        got = chat.turns_of_table(df, layout=layout).collect()
        assert [(r["conv_id"], [tuple(t) for t in r["turns"]]) for r in got] == [(1, [("user", "a"), ("assistant", "b")])]
    assert [tuple(t) for t in chat.turns_of_table(df, layout="prompt_response").first()["turns"]] == [("user", "p"), ("assistant", "r")]


# ---- 8: decontamination ----


def brute_hits(source, items, width=10):
    wanted = defaultdict(set)
    for i, t in items:
        w = fm_index.split_words((t or "").encode())
        for k in range(max(1, len(w) - width + 1) if w else 0):
            wanted[tuple(w[k : k + width])].add(i)
    lengths, out = {len(k) for k in wanted}, []
    for i, t in source:
        w = fm_index.split_words((t or "").encode())
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in wanted:
                    hit.update(range(k, k + n))
                    found |= wanted[key]
        out.append((i, len(w), len(hit), tuple(sorted(x for x in found if x is not None))))
    return Counter(out)


def hits(df):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect())


def test_contamination(spark, monkeypatch):
    for sf in (SF, "/root/testdata/sf0.01"):
        d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
        items = [(r["item_id"], r["text"]) for r in b.collect()]
        want = brute_hits(texts(d), items)
        assert hits(fm_index.contamination(d, b)) == want and sum(n for k, n in want.items() if k[2])
    monkeypatch.setattr(fm_index, "BENCH_BYTES", 1500)  # several blocks
    d, b = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    assert hits(fm_index.contamination(d, b)) == brute_hits(texts(d), [(r["item_id"], r["text"]) for r in b.collect()])


def test_contamination_awkward(spark, awkward):
    items = [(1, "three FOUR five"), (2, None), (3, ""), (None, "eleven twelve"), (4, "one two three four five six seven eight nine ten eleven"), (5, "long word long"), (5, "a"), (6, "a")]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert hits(fm_index.contamination(awkward, b)) == brute_hits(texts(awkward), items)
    assert hits(fm_index.contamination(awkward, b.limit(0))) == brute_hits(texts(awkward), [])
    assert fm_index.contamination(empty(spark), b).count() == 0
    clean = fm_index.clean_texts(awkward, b)
    assert clean.columns == awkward.columns and clean.count() == len(AWKWARD)
    assert sum(n for k, n in hits(fm_index.contamination(clean, b)).items() if k[2]) == 0


def test_blocks_of_a_benchmark_are_cut_at_once(spark, awkward, monkeypatch):
    """Overlapping passages of items in different blocks go whole, and words around a cut stay."""
    w = [[f"d{d}w{k}" for k in range(30)] for d in range(8)]
    items = [(10 * d + n, " ".join(w[d][a:b])) for d in range(8) for n, a, b in ((1, 0, 15), (2, 10, 22))]
    # these words are neighbours only once a passage between them is gone
    rows = [(100 + d, " ".join(["a1", *w[d], "b2"]), "en", "s", d) for d in range(8)] + [(200 + d, " ".join(["p"] * 5 + w[d][:15] + ["q"] * 5), "en", "s", d) for d in range(8)]
    items += [(90 + k, " ".join(["p"] * 5 + ["q"] * 5)) for k in range(3)]
    b = spark.createDataFrame([*items, (None, "eleven twelve"), (7, None)], "item_id long, text string")
    docs = spark.createDataFrame([(*r, i, 7, "clash", "rid") for i, r in enumerate(rows)], awkward.schema).unionByName(awkward)
    key = lambda df: Counter(map(tuple, df.collect()))
    want = key(fm_index.clean_texts(docs, b))
    monkeypatch.setattr(fm_index, "BENCH_BYTES", 500)
    got = fm_index.clean_texts(docs, b)
    assert got.columns == docs.columns and key(got) == want
    assert {r["text"] for r in got.where("doc_id = 200").collect()} == {"p p p p p  q q q q q"}


def test_phrases_are_small():
    """Arrays of a benchmark stay within a few times its text; pickled as well."""
    rng = random.Random(2)
    items = [(i % 300 or None, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(0, 300))).encode()) for i in range(1000)]
    p = fm_index.Phrases(items, 10)
    size = sum(len(t) for _, t in items)
    assert p.nbytes() < 6 * size and len(pickle.dumps(p)) < 6 * size
    windows = defaultdict(set)
    for i, t in items:
        w = t.split()
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    names = {v: k for k, v in p.vocab.items()}
    got = {tuple(names[x] for x in row if x): set(p.items_of(k)) for k, row in enumerate(p.matrix)}
    assert got == {k: v - {None} for k, v in windows.items()} and len(p.lengths) == len(windows)


def test_fm_index_on_random_sequences():
    rng = np.random.default_rng(6)
    for sigma in (2, 3, 9):
        for _ in range(30):
            seq = np.append(rng.integers(0, sigma, rng.integers(1, 200)), 0).astype(np.int64)
            index = fm_index.FMIndex(seq, sigma)
            for n in (1, 2, 3):
                p = rng.integers(1, sigma, (1, n))
                low, high = index.search(p, np.array([n]))
                at = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
                assert at == [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p[0]).all()]


# ---- 9: sharding ----


def test_shards(spark, docs, awkward, monkeypatch):
    for rows in (20_000, 7):
        monkeypatch.setattr(sharding, "ROWS", rows)
        for df in (docs, awkward):
            got = sharding.shuffle_shards(df, 16).collect()
            assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(df))
            by = defaultdict(list)
            for r in got:
                by[r["shard"]].append(r["slot"])
            sizes = [len(by[s]) for s in range(16)]
            assert max(sizes) - min(sizes) <= 1
            assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shuffle_shards(empty(spark)).count() == 0


def test_matrix_law():
    counts, sizes = [30, 50, 20], [25, 25, 50]
    seen, squares = np.zeros((3, 3)), np.zeros((3, 3))
    for seed in range(3000):
        m = np.array(sharding.communication_matrix(counts, sizes, seed))
        assert (m.sum(1) == counts).all() and (m.sum(0) == sizes).all()
        seen += m
        squares += m * m
    mean = np.outer(counts, sizes) / 100
    assert np.abs(seen / 3000 - mean).max() < 0.2
    # the variance of the hypergeometric law, too
    want = mean * (1 - np.array(counts)[:, None] / 100) * (1 - np.array(sizes) / 100) * 100 / 99
    assert np.abs((squares / 3000 - (seen / 3000) ** 2) / want - 1).max() < 0.15


def test_whole_shuffle_is_uniform(spark):
    """Over many seeds: where rows go, and how often two rows of one partition go together, as in a uniform permutation.

    Dealing each partition evenly, in place of the drawn matrix, would part rows of one partition too often.
    """
    n, parts, shards, seeds = 24, 3, 3, 40
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(n)], "doc_id long, text string").repartitionByRange(parts, "doc_id")
    path = common.Scratch(spark, "t").save(docs)
    lies = {r["doc_id"]: r["p"] for r in path.select("doc_id", F.spark_partition_id().alias("p")).collect()}
    assert len(set(lies.values())) > 1
    cells, slots, together, pairs = np.zeros((n, shards)), np.zeros(n), 0, 0
    for seed in range(seeds):
        at = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_shards(path, shards, seed).collect()}
        for i, (s, slot) in at.items():
            cells[i, s] += 1
            slots[i] += slot
        same = [(i, j) for i in range(n) for j in range(i) if lies[i] == lies[j]]
        pairs += len(same)
        together += sum(at[i][0] == at[j][0] for i, j in same)
    want = seeds / shards
    chi = ((cells - want) ** 2 / want).sum()
    assert chi < n * (shards - 1) + 5 * math.sqrt(2 * n * (shards - 1))
    assert abs(together / pairs - (n / shards - 1) / (n - 1)) < 0.025
    assert abs(slots.mean() / seeds - (n / shards - 1) / 2) < 1e-9 and np.abs(slots / seeds - 3.5).max() < 5 * 2.3 / math.sqrt(seeds)


# ---- 10: quality ----


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.QUERIES["op10_attention_quality"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    y, s = np.array([r["quality"] for r in got]), np.array([r["score"] for r in got])
    order = np.argsort(np.argsort(s))
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.97
    assert ((s >= 0.5) == (y == 1)).mean() > 0.97


def test_quality_awkward(spark, awkward):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (8, None, None), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(awkward, labels)
    got = quality.score_documents(awkward, model, columns=tuple(awkward.columns)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.train(empty(spark), labels.limit(0))
    assert quality.score_documents(awkward, none).count() == len(AWKWARD)
    assert quality.score_documents(empty(spark), none).count() == 0


def test_gradients_match_differences():
    """Forward pass against loops over documents and passages, gradients against finite differences."""
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality.N_FEATURES)) for n in (1, 3, 5)]
    y, x, starts = np.array([0.0, 1.0, 1.0]), np.concatenate(bags), np.array([0, 1, 4])
    m = quality.AttentionMIL()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    sig = lambda z: 1 / (1 + math.exp(-z))

    def one(bag, p):
        h = [np.tanh(passage @ p["W"] + p["b"]) for passage in bag]
        e = [sum(p["w"][k] * math.tanh(a @ p["V"][:, k]) * sig(a @ p["U"][:, k]) for k in range(len(p["w"]))) for a in h]
        weights = [math.exp(v - max(e)) for v in e]
        z = sum(w * a for w, a in zip(weights, h)) / sum(weights)
        return sig(z @ p["c"] + p["d"][0])

    assert m.score(x, starts) == pytest.approx([one(b, m.p) for b in bags])
    loss = lambda: -np.mean([math.log(one(b, m.p) if t else 1 - one(b, m.p)) for b, t in zip(bags, y)])
    for name, grad in m.gradients(x, starts, y).items():
        assert grad.shape == m.p[name].shape
        for at in rng.integers(0, grad.size, 6):
            flat, step = m.p[name].reshape(-1), 1e-5
            held = flat[at]
            flat[at] = held + step
            up = loss()
            flat[at] = held - step
            down = loss()
            flat[at] = held
            assert grad.reshape(-1)[at] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-8)


def test_training_is_bounded(spark):
    """Repeated keys and long texts: one row of a key, so many passages."""
    docs = spark.createDataFrame([(i % 3, "word " * (5000 if i else 9)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    seen = []
    fit = quality.AttentionMIL.fit
    quality.AttentionMIL.fit = lambda self, bags, y, **kw: seen.append([len(b) for b in bags]) or fit(self, bags, y, **kw)
    try:
        quality.train(docs, labels, passages=7)
    finally:
        quality.AttentionMIL.fit = fit
    assert len(seen[0]) <= 3 and max(seen[0]) == 7


def test_words_are_told_apart():
    a, b, c = quality.word_rows([b"quality", b"Quality", b"quantity"])
    assert (a == b).all() and a[0] != c[0] and (quality.word_rows([b"x" * 200]) >= 0).all()
    bag = quality.encode_passages(b"one two three " * 40)
    assert bag.shape == (3, quality.N_FEATURES) and bag[:, quality._N_PLAIN :].sum(1) == pytest.approx([3.0] * 3)


# ---- pipeline ----


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    kept = cp.quality_classifier(spark, docs, sf)
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert kept.columns == docs.columns and sum(i in ids for i in good) >= 0.98 * len(good)
    sets = brute_components(texts(docs), 5, 80)
    once = cp.near_dedup(spark, docs, sf)
    assert once.columns == docs.columns
    assert sorted(r["doc_id"] for r in once.select("doc_id").collect()) == sorted({c for _, _, c in sets})
    clean = cp.decontamination(spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    before, after = brute_hits(texts(docs), items), brute_hits(texts(clean), items)
    assert sum(k[2] for k in before) > 0 and sum(k[2] for k in after) == 0
    rows = cp.run(spark, sf).collect()
    assert rows and {r["doc_id"] for r in rows} <= ids


def test_pipeline_awkward(spark, awkward):
    """Columns named as the stages name theirs inside, upper case alike."""
    import corpus_pipeline as cp

    names = "score score1 _data _h _stays stays th k t c c0 rid top row0 spans spans0 label n first".split()
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars", "row", "size", F.col("data").alias("Data"), "_part", F.lit(1).alias("a `quoted` name"), *[F.lit(f"v{i}").alias(n) for i, n in enumerate(names)])
    for name, stage in cp.STAGES:
        for df in (docs, docs.limit(0)):
            got = stage(spark, df, SF)
            assert name == cp.STAGES[-1][0] or got.columns == df.columns
            got.collect()


def test_pipeline_frees_what_stages_wrote(spark, tmp_path):
    import corpus_pipeline as cp

    rows = cp.run(spark, SF).count()
    root = common.Scratch(spark, "t").root.rsplit("/", 1)[0]
    held = [p for p in os.listdir(root) if p.startswith(("keyfold-dedup", "keyfold-neardup", "keyfold-decontamination"))]
    before = {p for p in held if os.listdir(f"{root}/{p}")}
    cp.run(spark, SF).count()
    assert rows and {p for p in os.listdir(root) if p.startswith("keyfold-dedup") and os.listdir(f"{root}/{p}")} <= before
