"""The registered queries of the ten operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyfold.session import table

from . import chat, ctw, fm_index, minhash, packing, quality, sharding, tokens, topk_search, url_filters

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _strength(up: str) -> str:
    """Pseudo-counts of a prior, from one level's n, good and the rate above."""
    spread, room = f"sum(power(good - n * {up}, 2) / n - {up} * (1 - {up}))", f"sum({up} * (1 - {up}) * (n - 1))"
    return f"CASE WHEN {spread} > 0 AND {room} > 0 THEN least({url_filters.MOST}, greatest({url_filters.LEAST}, {room} / {spread} - 1)) ELSE {url_filters.MOST} END"


_OP1 = f"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '(?s)^([^/?#]*)', 1) AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '(?s)^([^?#]*)', 1) AS path FROM h),
rules(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS said FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
parts AS (SELECT DISTINCT host, string_split(host, '.') AS s FROM p),
k AS (SELECT host, CASE WHEN two THEN array_to_string(s[-3:], '.') ELSE array_to_string(s[-2:], '.') END AS domain, CASE WHEN two THEN array_to_string(s[-2:], '.') ELSE s[-1] END AS suffix
      FROM (SELECT *, regexp_matches(array_to_string(s[-2:], '.'), '^(?:{"|".join(url_filters.SECOND_LABELS)})[.][a-z]{{2}}$') AS two FROM parts)),
c AS (SELECT host, domain, suffix, count(*) AS n, count(*) FILTER (quality = 1) AS good FROM p JOIN labels ON doc_id = page_id JOIN k USING (host) WHERE quality IS NOT NULL GROUP BY ALL),
e AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM c),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(mean) AS up FROM c, e GROUP BY suffix),
st AS (SELECT {_strength("up")} AS t FROM s0),
sx AS (SELECT suffix, (good + t * up) / (n + t) AS s_mean FROM s0, st),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(s_mean) AS up FROM c JOIN sx USING (suffix) GROUP BY domain, suffix),
dt AS (SELECT {_strength("up")} AS t FROM d0),
dx AS (SELECT domain, (good + t * up) / (n + t) AS d_mean FROM d0, dt),
h0 AS (SELECT host, n, good, d_mean AS up FROM c JOIN dx USING (domain)),
w AS (SELECT {_strength("up")} AS t FROM h0),
b AS (SELECT k.host, t, coalesce(n, 0) AS n, coalesce(good, 0) AS good, coalesce(d_mean, s_mean, mean) AS up FROM k LEFT JOIN sx USING (suffix) LEFT JOIN dx USING (domain) LEFT JOIN c USING (host), w, e),
ab AS (SELECT host, (good + t * up) / (n + t) AS pm, good + t * up AS a, n - good + t * (1 - up) AS b FROM b),
cells AS (SELECT host, pm, i, (a - 1) * ln((i + 0.5) / {url_filters.CELLS}) + (b - 1) * ln(1 - (i + 0.5) / {url_filters.CELLS}) AS l FROM ab, (SELECT unnest(range(0, {url_filters.CELLS})) AS i)),
g AS (SELECT host, pm, i, exp(l - max(l) OVER (PARTITION BY host)) AS x FROM cells),
u2 AS (SELECT host, pm, sum(x) OVER (PARTITION BY host ORDER BY i) AS upto, sum(x) OVER (PARTITION BY host) AS every FROM g),
z AS (SELECT host, round(any_value(pm), 6) AS posterior_mean, round(count(*) FILTER (upto < {url_filters.QUANTILE} * every) / {url_filters.CELLS}, 6) AS bound FROM u2 GROUP BY host)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict, posterior_mean, bound
FROM p JOIN z USING (host) LEFT JOIN m USING (page_id)
"""


@query("op1_url_filters", _OP1)
def op1_url_filters(spark, sf_dir):
    """Every page's verdict; labelled outcomes are the rows of labels with the page's id."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels")
    host, _ = url_filters.split_url(F.col("url"))
    outcomes = pages.select("page_id", host.alias("host")).join(labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good_page")), "page_id")
    judged = url_filters.judge(pages, outcomes)
    return judged.withColumns({c: F.round(c, 6) for c in ("posterior_mean", "bound")})


_OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.e, r.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v r ON r.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, r::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""


@query("op2_topk_search", _OP2)
def op2_topk_search(spark, sf_dir):
    """The ten nearest rows by integer inner product of every row whose id is divisible by 100."""
    rows = topk_search.quantise(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), 10)


@query("op9_sharding")
def op9_sharding(spark, sf_dir):
    """All documents into 16 shards under the law of equal row counts."""
    return sharding.shuffle_shards(table(spark, sf_dir, "documents"), 16)


TOKENIZER = "word_bpe_49k.json"


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer(), 2048)


@query("op4_ctw_scoring")
def op4_ctw_scoring(spark, sf_dir):
    """Every document's log10 probability under the context tree and under the unigram base."""
    return ctw.score_documents(table(spark, sf_dir, "documents"))


_OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x, len(w) AS size FROM d),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, i, size, concat_ws(' ', x, lead(x, 1) OVER q, lead(x, 2) OVER q) AS g FROM t WINDOW q AS (PARTITION BY doc_id ORDER BY i)) WHERE i <= greatest(1, size - 2)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
x AS (SELECT doc_id, n, g FROM g JOIN s USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN m ON a = doc_id
"""


@query("op5_circulant_minhash", _OP5)
def op5_circulant_minhash(spark, sf_dir):
    """Components of documents whose 3-word shingle sets are similar to 85 in 100."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


_CONTROL = r"\### Assistant: </turn> ok"


@query(
    "op6_chat_formatting",
    r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), e AS (
        SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
            replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS head FROM t
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
        sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
        sum(length(body) + length(head) + 14)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op6_chat_formatting(spark, sf_dir):
    """All conversations and the fixed one, formatted, then read back into digests."""
    turns = chat.turns_of_table(table(spark, sf_dir, "conversations"), layout="rows")
    fixed = spark.createDataFrame([(-7, [("user", _CONTROL), ("assistant", _CONTROL)])], "conv_id long, messages array<struct<role: string, content: string>>")
    turns = turns.unionByName(chat.turns_of_table(fixed))
    return chat.digests(chat.format_turns(turns))


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    """Token counts of every whole document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), _tokenizer(), 2048)


_WORDS8 = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
b AS (SELECT item_id, {_WORDS8} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ls WHERE len(w) >= n)),
o AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (win)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op8_fm_decontamination", _OP8)
def op8_fm_decontamination(spark, sf_dir):
    """Every document's words inside occurrences of the benchmark's ten-word windows."""
    found = fm_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op10_attention_quality")
def op10_attention_quality(spark, sf_dir):
    """Every document's quality score; labels outside the held-out part train the model."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
