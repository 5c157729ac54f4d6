"""The registry of queries over the driver's tables, and the DuckDB SQL that each must equal.

The original data sets are not available, so a query keeps its shape and reads
an analogous table; missing values are put in by the same rule on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from keyfold.functions import text as T
from keyfold.operators import allocate, extend, folds, metrics, tasks, timeline
from keyfold.plans import jobs
from keyfold.session import scratch_path, table
from keyfold.sources import generate, readers, sinks
from keyfold.streaming import archive_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NODES, DAY = 8, 86_400_000


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name, with its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- stand-ins for the data sets ----


def _events_mq(spark, d):
    """The weather layout from events: every seventh temperature is missing, every fifth precipitation no number."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("station"), F.when(F.col("event_id") % 7 == 0, jobs.MISSING).otherwise(F.col("value").cast("string")).alias("temp"), F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.round("value", 2).cast("string")).alias("precip"), F.date_format("ts", "yyyyMMddHHmmss").alias("date"), "event_type")


_MQ = "(SELECT CAST(user_id AS VARCHAR) AS station, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS temp, CASE WHEN event_id % 5 = 0 THEN 0 ELSE round(value, 2) END AS precip, event_type FROM events)"
_BIN = "CASE WHEN round(temp - 273.15, 9) - floor(round(temp - 273.15, 9)) >= 0.5 THEN floor(round(temp - 273.15, 9)) + 0.5 ELSE floor(round(temp - 273.15, 9)) END"


def _ratings(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").cast("string").alias("film"), F.when(F.col("l_orderkey") % 11 == 0, jobs.MISSING).otherwise(F.col("l_quantity").cast("string")).alias("score"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_linenumber")


def _sales(spark, d):
    li = table(spark, d, "lineitem")
    amount = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    return li.select(F.col("l_suppkey").cast("string").alias("shop"), F.when(F.col("l_orderkey") % 13 == 0, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"), F.when(F.col("l_orderkey") % 17 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("article"), F.when(F.col("l_orderkey") % 19 == 0, jobs.SALES_HEADER).otherwise(amount).alias("amount"))


_SALES = "(SELECT CAST(l_suppkey AS VARCHAR) AS shop, CASE WHEN l_orderkey % 13 = 0 THEN 'empty key' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date, CASE WHEN l_orderkey % 17 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS article, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem WHERE l_orderkey % 19 <> 0)"


def _tasks(spark, d):
    """key: part, owner: a node of the supplier, nb_values."""
    li = table(spark, d, "lineitem")
    return tasks.task_table(li.withColumn("node", F.col("l_suppkey") % NODES), "l_partkey", "node")


_TASKS = f"(SELECT l_partkey AS key, l_suppkey % {NODES} AS owner, count(*)::BIGINT AS nb_values FROM lineitem GROUP BY ALL)"


def _owned(spark, d):
    """key: part, owner: the node that has the task, cost."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("cost")).withColumn("owner", F.col("key") % NODES)


_OWNED = f"(SELECT l_partkey AS key, count(*)::BIGINT AS cost, l_partkey % {NODES} AS owner FROM lineitem GROUP BY l_partkey)"


def _loads(spark, d):
    """Loads of the nodes, uneven on purpose."""
    return _owned(spark, d).groupBy("owner").agg((F.sum("cost") + F.max("owner") * 200).alias("load"))


_LOADS = f"(SELECT owner, (sum(cost) + max(owner) * 200)::BIGINT AS load FROM {_OWNED} GROUP BY owner)"


def _archive(spark, d):
    """id: event type, ts in milliseconds, value in hundredths."""
    return table(spark, d, "events").select(F.col("event_type").alias("id"), timeline.millis("ts").alias("ts"), F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("value"), F.col("event_id").alias("seq"))


_ARCHIVE = "(SELECT event_type AS id, epoch_us(ts) // 1000 AS ts, floor(value * 100 + 0.5)::BIGINT AS value, event_id AS seq FROM events)"
_CELLS = f"a AS {_ARCHIVE}, lim AS (SELECT min(ts) AS s, max(ts) AS l FROM a), b AS (SELECT a.*, greatest(0, ceil((ts - s) / {DAY}.0)::BIGINT) AS bucket FROM a, lim), grid AS (SELECT unnest(range(0, ((l + {DAY} - s) // {DAY})::BIGINT + 1)) AS bucket FROM lim)"

# ---- words, folds and jobs ----

_WORDS = "(SELECT unnest(string_split(line, ' ')) AS word FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))"


@query("count_words", f"SELECT word, count(*) AS n FROM {_WORDS} WHERE word <> '' GROUP BY word")
def count_words(spark, d):
    return jobs.count_words(table(spark, d, "documents").select(F.col("text").alias("line")))


@query("tokenize_explode", "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)) WHERE word <> '' GROUP BY ALL")
def tokenize_explode(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", F.explode(F.split("line", " ")).alias("word")).where("word <> ''").groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("count_by_keyword", "SELECT keyword, count(*) AS n FROM (SELECT unnest(string_split(rtrim(line, ' '), ' ')) AS keyword FROM (SELECT replace(unnest(string_split(text, chr(10))), '.', ' ') AS line FROM documents) WHERE rtrim(line, ' ') <> '' OR line = '') GROUP BY keyword")
def count_by_keyword(spark, d):
    """Every line is a record."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return jobs.count_by_keyword(lines.select(F.replace("line", F.lit("."), F.lit(" ")).alias("phrase")))


@query("count_key", "SELECT l_partkey AS k, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY l_partkey")
def count_key(spark, d):
    return jobs.count_key(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("v")))


@query("fold_add_int", "SELECT l_suppkey, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY l_suppkey")
def fold_add_int(spark, d):
    return folds.fold_by(table(spark, d, "lineitem"), ["l_suppkey"], total=folds.add_int("l_linenumber"))


@query("fold_add_double", "SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY l_suppkey")
def fold_add_double(spark, d):
    return folds.fold_by(table(spark, d, "lineitem"), ["l_suppkey"], total=folds.add_double("l_extendedprice", 2))


@query("fold_mean_double", "SELECT l_suppkey, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_suppkey")
def fold_mean_double(spark, d):
    return folds.fold_by(table(spark, d, "lineitem"), ["l_suppkey"], mean=folds.mean_double("l_quantity", 6))


@query("fold_mean_int", "SELECT c_nationkey, (sum(trunc(c_acctbal - 5000)::BIGINT)::BIGINT // count(*))::BIGINT AS mean FROM customer GROUP BY c_nationkey")
def fold_mean_int(spark, d):
    """Negative values too: the division goes towards zero."""
    c = table(spark, d, "customer").withColumn("v", (F.col("c_acctbal") - 5000).cast("bigint"))
    return folds.fold_by(c, ["c_nationkey"], mean=folds.mean_int("v"))


@query("fold_generic", "SELECT l_suppkey, (list_reduce(list_prepend(7::BIGINT, list_sort(list(l_linenumber::BIGINT))), lambda a, x: (a * 31 + x) % 1000003))::BIGINT AS digest FROM lineitem GROUP BY l_suppkey")
def fold_generic(spark, d):
    """A fold that no built-in aggregate has."""
    return folds.fold_sorted(table(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber", 7, lambda a, x: (a * 31 + x) % 1000003, name="digest")


@query("two_phase_aggregate", "SELECT l_suppkey, (sum(l_quantity::INT)::BIGINT // count(*))::BIGINT AS mean_int, sum(l_quantity::INT)::BIGINT AS total, count(*)::BIGINT AS n FROM lineitem GROUP BY l_suppkey")
def two_phase_aggregate(spark, d):
    li = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    return folds.two_phase_mean_int(li, ["l_suppkey"], "q", "l_linenumber")


@query("generated_mean_int", "SELECT l_partkey AS key, l_suppkey AS reducer, (sum(l_quantity::INT)::BIGINT // count(*))::BIGINT AS mean FROM lineitem GROUP BY ALL")
def generated_mean_int(spark, d):
    li = table(spark, d, "lineitem")
    return jobs.generated(li.select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("reducer"), F.col("l_quantity").cast("int").alias("val1")))


@query("precipitation_by_station", f"SELECT station, CAST(sum(CAST(precip AS DECIMAL(18,6))) AS DOUBLE) AS total FROM {_MQ} GROUP BY station")
def precipitation_by_station(spark, d):
    return jobs.precipitation_by_station(_events_mq(spark, d))


@query("mean_temperature_by_station", f"SELECT station, round(avg(temp - 273.15), 6) AS mean FROM {_MQ} WHERE temp IS NOT NULL GROUP BY station")
def mean_temperature_by_station(spark, d):
    return jobs.temperature_by_station(_events_mq(spark, d))


@query("histogram_half_unit", f"SELECT {_BIN} AS bin, count(*) AS n FROM {_MQ} WHERE temp IS NOT NULL GROUP BY ALL")
def histogram_half_unit(spark, d):
    return jobs.record_by_temperature(_events_mq(spark, d))


@query("histogram_half_unit_by_station", f"SELECT {_BIN} AS bin, event_type AS station, count(*) AS n FROM {_MQ} WHERE temp IS NOT NULL GROUP BY ALL")
def histogram_half_unit_by_station(spark, d):
    e = _events_mq(spark, d).drop("station").withColumnRenamed("event_type", "station")
    return jobs.record_by_temperature_station(e)


@query("count_by_date_suffix_station", "SELECT strftime(o_orderdate, '%m%d%H%M%S') AS suffix, o_orderpriority AS station, count(*) AS n FROM orders GROUP BY ALL")
def count_by_date_suffix_station(spark, d):
    return jobs.record_by_date_suffix_station(_orders(spark, d))


@query("count_by_year_station", "SELECT strftime(o_orderdate, '%Y') AS year, o_orderpriority AS station, count(*) AS n FROM orders GROUP BY ALL")
def count_by_year_station(spark, d):
    return jobs.record_by_year_station(_orders(spark, d))


def _orders(spark, d):
    return table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("date"), F.col("o_orderpriority").alias("station"))


@query("count_by_day_month", "SELECT strftime(l_shipdate, '%m %d') AS day, count(*) AS n FROM lineitem GROUP BY ALL")
def count_by_day_month(spark, d):
    return jobs.record_by_day_month(_ratings(spark, d))


@query("filter_range_count", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey < 900 GROUP BY l_partkey")
def filter_range_count(spark, d):
    return table(spark, d, "lineitem").where("l_partkey < 900").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("count_by_some_films", "SELECT CAST(l_partkey AS VARCHAR) AS film, count(*) AS n FROM lineitem WHERE l_partkey < 9000 GROUP BY ALL")
def count_by_some_films(spark, d):
    return jobs.record_by_some_films(_ratings(spark, d))


@query("count_by_film", "SELECT CAST(l_partkey AS DOUBLE) AS film, count(*) AS n FROM lineitem GROUP BY l_partkey")
def count_by_film(spark, d):
    return jobs.record_by_film(_ratings(spark, d))


@query("count_by_score_film", "SELECT CAST(l_partkey AS VARCHAR) AS film, CAST(l_linenumber AS VARCHAR) AS score, count(*) AS n FROM lineitem GROUP BY ALL")
def count_by_score_film(spark, d):
    return jobs.record_by_score_film(_ratings(spark, d).withColumn("score", F.col("l_linenumber").cast("string")))


@query("mean_score_by_film", "SELECT CAST(l_partkey AS VARCHAR) AS film, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY l_partkey")
def mean_score_by_film(spark, d):
    return jobs.score_by_film(_ratings(spark, d))


@query("mean_int_by_song", "SELECT l_partkey AS song, (sum(l_quantity::INT)::BIGINT // count(*))::BIGINT AS mean FROM lineitem GROUP BY l_partkey")
def mean_int_by_song(spark, d):
    return jobs.mean_by_song(table(spark, d, "lineitem").select(F.col("l_partkey").alias("song"), F.col("l_quantity").cast("int").alias("grade")))


@query("count_grade", "SELECT l_linenumber AS grade, count(*) AS n FROM lineitem GROUP BY ALL")
def count_grade(spark, d):
    return jobs.count_grade(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("grade")))


@query("count_by_account", "SELECT CAST(user_id AS VARCHAR) AS account, count(*) AS n FROM events GROUP BY ALL")
def count_by_account(spark, d):
    return jobs.count_by_account(table(spark, d, "events").select(F.col("user_id").cast("string").alias("account")))


def _revenue_sql(key: str, alias: str) -> str:
    return f"SELECT {key} AS {alias}, CAST(sum(amount) AS DOUBLE) AS revenue FROM {_SALES} GROUP BY ALL"


@query("revenue_by_article", _revenue_sql("CASE WHEN article = '' THEN 'empty key' ELSE article END", "article"))
def revenue_by_article(spark, d):
    return jobs.revenue_by_article(_sales(spark, d))


@query("revenue_by_shop", _revenue_sql("shop", "shop"))
def revenue_by_shop(spark, d):
    return jobs.revenue_by_shop(_sales(spark, d))


@query("revenue_by_shop_and_article", _revenue_sql("shop || '@' || article", "key"))
def revenue_by_shop_and_article(spark, d):
    return jobs.revenue_by_shop_and_article(_sales(spark, d))


@query("revenue_by_date", _revenue_sql("date", "date"))
def revenue_by_date(spark, d):
    return jobs.revenue_by_date(_sales(spark, d))


# ---- projections, predicates, sources and sinks ----


def _kv_lines(spark, d, name: str, value) -> str:
    path = scratch_path(spark, name)
    table(spark, d, "orders").select(value.alias("value")).write.text(path)
    return path


_ORDER_LINE = ("o_orderkey", "o_custkey", "o_orderpriority")


@query("project_delimited", "SELECT o_orderkey::INT AS k, o_custkey::INT AS v, o_orderpriority AS p FROM orders")
def project_delimited(spark, d):
    path = _kv_lines(spark, d, "delimited", F.concat_ws(";", *_ORDER_LINE))
    return readers.project(readers.lines(spark, path), ";", {"k": (0, "int"), "v": (1, "int"), "p": (2, "string")})


@query("scan_presplit", "SELECT count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders")
def scan_presplit(spark, d):
    path = scratch_path(spark, "presplit")
    table(spark, d, "orders").select(F.concat_ws(";", *_ORDER_LINE).alias("value")).repartition(4).write.text(path)
    return readers.presplit(spark, path).agg(F.count("*").alias("n"), F.sum(T.field("value", ";", 1).cast("bigint")).alias("total"))


@query("scan_round_robin", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 8)::INT AS split FROM orders")
def scan_round_robin(spark, d):
    return readers.round_robin(table(spark, d, "orders").select("o_orderkey"), 8, "o_orderkey")


@query("scan_archive_csv", f"SELECT ts, id, value FROM {_ARCHIVE}")
def scan_archive_csv(spark, d):
    path = scratch_path(spark, "archive")
    sinks.write_archive(_archive(spark, d).select("ts", "id", "value"), path)
    return readers.archive(spark, path, "ts bigint, id string, value bigint")


@query("sink_result_lines", "SELECT CAST(l_suppkey AS VARCHAR) || ' ' || CAST(count(*) AS VARCHAR) AS value FROM lineitem GROUP BY l_suppkey")
def sink_result_lines(spark, d):
    path = scratch_path(spark, "results")
    counts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    sinks.write_results(counts, ["l_suppkey"], "n", path)
    return spark.read.text(path)


@query("composite_key", "SELECT CAST(l_suppkey AS VARCHAR) || ' ' || l_returnflag || ' ' || l_linestatus AS key, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus")
def composite_key(spark, d):
    keys = ("l_suppkey", "l_returnflag", "l_linestatus")
    return table(spark, d, "lineitem").groupBy(*keys).agg(F.count("*").alias("n")).select(T.composite_key(*keys).alias("key"), "n")


@query("filter_sentinel", f"SELECT station, count(*) AS n FROM {_MQ} WHERE temp IS NOT NULL AND station <> '7' GROUP BY station")
def filter_sentinel(spark, d):
    return _events_mq(spark, d).where(~((F.col("temp") == jobs.MISSING) | (F.col("station") == "7"))).groupBy("station").agg(F.count("*").alias("n"))


@query("default_on_parse_error", f"SELECT event_type, CAST(sum(CAST(precip AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {_MQ} GROUP BY event_type")
def default_on_parse_error(spark, d):
    return _events_mq(spark, d).groupBy("event_type").agg(folds.add_double(T.parse_or(F.col("precip")), 2).alias("total"))


@query("replicate_rows", "SELECT l_suppkey, count(*) AS n, sum(copy)::BIGINT AS copies FROM (SELECT l_suppkey, unnest(range(1, l_linenumber % 4 + 1)) AS copy FROM lineitem) GROUP BY l_suppkey")
def replicate_rows(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber")
    return tasks.replicate(li, F.col("l_linenumber") % 4).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("copy").alias("copies"))


_LINES = "(SELECT doc_id, generate_subscripts(l, 1)::INT - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query("split_trailing", f"SELECT doc_id, line_no, CASE WHEN rtrim(line, '.') = '' AND line <> '' THEN 0 ELSE len(string_split(rtrim(line, '.'), '.')) END::BIGINT AS n FROM {_LINES}")
def split_trailing(spark, d):
    """Trailing empty fields of every line are dropped."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.size(T.split_fields("line", ".")).cast("bigint").alias("n"))


@query("scan_chunk_files", "SELECT CAST(l_suppkey AS VARCHAR) AS key, count(*) AS n, sum(l_linenumber)::BIGINT AS total, count(DISTINCT c) AS files FROM (SELECT *, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 500 AS c FROM lineitem WHERE l_suppkey <= 5) GROUP BY l_suppkey")
def scan_chunk_files(spark, d):
    """Chunks of the values of five suppliers, written as files and read again."""
    path, li = scratch_path(spark, "chunks"), table(spark, d, "lineitem").where("l_suppkey <= 5").select("l_suppkey", "l_orderkey", "l_linenumber")
    chunks = tasks.assign_chunks(li, "l_suppkey", 500, "l_orderkey", "l_linenumber")
    sinks.write_chunks(chunks.select(F.col("l_suppkey").alias("key"), "chunk_index", F.col("l_linenumber").alias("value")), path)
    return readers.chunk_files(spark, path).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("bigint")).alias("total"), F.count_distinct("file").alias("files"))


@query("sink_concatenated", "SELECT count(*) AS n, 1::BIGINT AS files FROM (SELECT DISTINCT l_suppkey FROM lineitem)")
def sink_concatenated(spark, d):
    """The result lines of all receivers in one file."""
    path = scratch_path(spark, "concatenated")
    counts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    sinks.concatenate(sinks.result_lines(counts, ["l_suppkey"], "n"), path)
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"), F.count_distinct("f").alias("files"))


# ---- grouping ----


@query("hash_partition", "SELECT (abs(h) % 8)::INT AS bucket, count(*) AS n FROM (SELECT list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(c_name) + 1), lambda i: unicode(c_name[i])::BIGINT)), lambda a, x: ((a * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM customer) GROUP BY ALL")
def hash_partition(spark, d):
    return table(spark, d, "customer").groupBy(T.hash_bucket("c_name", 8).alias("bucket")).agg(F.count("*").alias("n"))


@query("chunking", "SELECT l_suppkey, c AS chunk_index, count(*) AS nb_values FROM (SELECT l_suppkey, ((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 50)::INT AS c FROM lineitem) GROUP BY ALL")
def chunking(spark, d):
    return tasks.chunk(table(spark, d, "lineitem"), "l_suppkey", 50)


@query("chunk_assignment", "SELECT l_orderkey, l_linenumber, l_suppkey, ((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 50)::INT AS chunk_index FROM lineitem")
def chunk_assignment(spark, d):
    """Every row with the chunk that it goes to."""
    return tasks.assign_chunks(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", 50, "l_orderkey", "l_linenumber")


@query("amplify_chosen", "SELECT c_custkey, copy::INT AS copy FROM (SELECT c_custkey, unnest(range(1, f + 1)) AS copy FROM (SELECT c_custkey, CASE WHEN CASE WHEN abs(h) % 8 = 0 THEN 8 ELSE abs(h) % 8 END IN (2, 3) THEN 2 + 1 + c_custkey % 4 ELSE 2 END AS f FROM (SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(c_name) + 1), lambda i: unicode(c_name[i])::BIGINT)), lambda a, x: ((a * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM customer)))")
def amplify_chosen(spark, d):
    """Rows of the keys in classes 2 and 3 of 8 are written 3 to 6 times, others twice."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return tasks.replicate(c, tasks.amplification("c_name", F.col("c_custkey"), (2, 3), 8, 2, 1, 4)).select("c_custkey", "copy")


# ---- task table, costs ----

_RATE = f"(SELECT key, owner, nb_values, round(nb_values / sum(nb_values) OVER (PARTITION BY key), 2) AS rate FROM {_TASKS})"


@query("ownership_rate", f"SELECT * FROM {_RATE}")
def ownership_rate(spark, d):
    return tasks.ownership_rate(_tasks(spark, d))


@query("ownership_histogram", f"SELECT t / 10 AS rate, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, 11)) AS t) LEFT JOIN (SELECT round(rate * 10)::INT AS t, count(*) AS n FROM {_RATE} GROUP BY ALL) USING (t)")
def ownership_histogram(spark, d):
    return tasks.ownership_histogram(tasks.ownership_rate(_tasks(spark, d)))


@query("tasks_per_rate", f"SELECT owner, rate, count(*) AS n FROM {_RATE} GROUP BY ALL")
def tasks_per_rate(spark, d):
    return tasks.ownership_rate(_tasks(spark, d)).groupBy("owner", "rate").agg(F.count("*").alias("n"))


@query("locality_ratio", f"SELECT count(*) FILTER (owner = key % {NODES}) AS local, count(*) AS total FROM {_TASKS}")
def locality_ratio(spark, d):
    return _tasks(spark, d).agg(F.count_if(F.col("owner") == F.col("key") % NODES).alias("local"), F.count("*").alias("total"))


@query("cost_nb_values", f"SELECT key, sum(nb_values)::BIGINT AS cost FROM {_TASKS} GROUP BY key")
def cost_nb_values(spark, d):
    return tasks.cost_nb_values(_tasks(spark, d))


_AGENTS = f"(SELECT DISTINCT l_suppkey % {NODES} AS agent FROM lineitem)"


@query("cost_remote_multiplier", f"SELECT key, agent, sum(CASE WHEN owner = agent THEN nb_values ELSE nb_values * 3 END)::BIGINT AS cost FROM {_TASKS} CROSS JOIN {_AGENTS} GROUP BY ALL")
def cost_remote_multiplier(spark, d):
    t = _tasks(spark, d)
    return tasks.cost_remote_multiplier(t, t.select(F.col("owner").alias("agent")), 3)


@query("cost_hardware", f"SELECT key, agent, sum(1 + nb_values * 100 // 50 + nb_values * 100 // 10 + CASE WHEN owner = agent THEN 0 ELSE nb_values * 100 // 20 END)::BIGINT AS cost FROM {_TASKS} CROSS JOIN {_AGENTS} GROUP BY ALL")
def cost_hardware(spark, d):
    t = _tasks(spark, d)
    return tasks.cost_hardware(t, t.select(F.col("owner").alias("agent")))


# ---- bundles, delegation, splitting ----


@query("bundle_order", f"SELECT owner, key, cost, row_number() OVER (PARTITION BY owner ORDER BY cost, key)::INT AS place FROM {_OWNED}")
def bundle_order(spark, d):
    return tasks.bundle_order(_owned(spark, d))


@query("next_task_csdb", f"SELECT owner, arg_min(key, {{'c': cost, 'k': key}}) AS perform, arg_max(key, {{'c': cost, 'k': key}}) AS delegate FROM {_OWNED} GROUP BY owner")
def next_task_csdb(spark, d):
    return tasks.next_task(_owned(spark, d), "csdb")


@query("next_task_cbds", f"SELECT owner, arg_max(key, {{'c': cost, 'k': key}}) AS perform, arg_min(key, {{'c': cost, 'k': key}}) AS delegate FROM {_OWNED} GROUP BY owner")
def next_task_cbds(spark, d):
    return tasks.next_task(_owned(spark, d), "cbds")


def _pairs(spark, d, t):
    """Owners' rows with every peer: the result's own size, but for the nodes' loads nothing is sent."""
    l = _loads(spark, d)
    peers = l.select(F.col("owner").alias("peer"), F.col("load").alias("peer_load"))
    return t.join(l.withColumnRenamed("load", "my_load"), "owner").crossJoin(tasks.few(peers)).where("peer <> owner")


_PAIRS = f"(SELECT t.key, t.owner, t.cost, m.load AS my_load, p.owner AS peer, p.load AS peer_load FROM {_OWNED} t JOIN {_LOADS} m ON m.owner = t.owner JOIN {_LOADS} p ON p.owner <> t.owner)"


@query("acceptance_test", f"SELECT owner, peer, count(*) FILTER ((my_load - (peer_load + cost)) / my_load > 0.05) AS accepted, count(*) AS total FROM {_PAIRS} GROUP BY ALL")
def acceptance_test(spark, d):
    """Acceptance hangs on a task's cost alone, so an owner's distinct costs meet the peers, not its tasks."""
    costs = _owned(spark, d).groupBy("owner", "cost").agg(F.count("*").alias("n"))
    pairs = tasks.acceptance(_pairs(spark, d, costs), 0.05)
    return pairs.groupBy("owner", "peer").agg(F.sum(F.when(F.col("accepts"), F.col("n")).otherwise(0)).alias("accepted"), F.sum("n").alias("total"))


@query("fairness_benefit", f"SELECT key, peer, round((my_load - (peer_load + cost)) / my_load, 6) AS benefit FROM {_PAIRS}")
def fairness_benefit(spark, d):
    return tasks.acceptance(_pairs(spark, d, _owned(spark, d))).select("key", "peer", F.round("benefit", 6).alias("benefit"))


@query("select_bidder", f"SELECT key, arg_min(owner, {{'c': load + c, 'o': owner}}) AS winner FROM (SELECT t.key, l.owner, l.load, sum(CASE WHEN t.owner = l.owner THEN nb_values ELSE nb_values * 3 END)::BIGINT AS c FROM {_TASKS} t CROSS JOIN {_LOADS} l GROUP BY ALL) GROUP BY key")
def select_bidder(spark, d):
    t = _tasks(spark, d)
    cost = tasks.cost_remote_multiplier(t, t.select(F.col("owner").alias("agent")), 3)
    bids = cost.join(tasks.few(_loads(spark, d).withColumnRenamed("owner", "agent")), "agent")
    return tasks.select_bidder(bids.select("key", F.col("agent").alias("bidder"), "load", "cost"))


@query(
    "k_eligible_delegate",
    f"SELECT owner, key, cost, representative, n_peers FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n_peers DESC, greatest(my - cost, pl + cost), key) AS r FROM (SELECT owner, key, cost, any_value(my_load) AS my, least(count(*), 3)::INT AS n_peers, arg_max(peer, {{'l': peer_load, 'm': -peer}}) AS representative, max(peer_load) AS pl FROM {_PAIRS} WHERE peer_load + cost < my_load GROUP BY owner, key, cost)) WHERE r = 1",
)
def k_eligible_delegate(spark, d):
    return tasks.k_eligible_delegate(_owned(spark, d), _loads(spark, d), 3)


_ELIGIBLE = f"(SELECT owner, key AS delegate FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n_peers DESC, greatest(my - cost, pl + cost), key) AS r FROM (SELECT owner, key, cost, any_value(my_load) AS my, least(count(*), 2)::INT AS n_peers, max(peer_load) AS pl FROM {_PAIRS} WHERE peer_load + cost < my_load GROUP BY owner, key, cost)) WHERE r = 1)"


@query("k_eligible_small", f"SELECT owner, perform, delegate FROM (SELECT owner, arg_min(key, {{'c': cost, 'k': key}}) AS perform FROM {_OWNED} GROUP BY owner) LEFT JOIN {_ELIGIBLE} USING (owner)")
def k_eligible_small(spark, d):
    return tasks.k_eligible(_owned(spark, d), _loads(spark, d), 2, "small")


@query("k_eligible_big", f"SELECT owner, perform, delegate FROM (SELECT owner, arg_max(key, {{'c': cost, 'k': key}}) AS perform FROM {_OWNED} GROUP BY owner) LEFT JOIN {_ELIGIBLE} USING (owner)")
def k_eligible_big(spark, d):
    return tasks.k_eligible(_owned(spark, d), _loads(spark, d), 2, "big")


@query("bid_order", f"SELECT p.owner AS bidder, i.owner AS initiator, i.load, row_number() OVER (PARTITION BY p.owner ORDER BY i.load DESC, i.owner)::INT AS place FROM {_LOADS} p JOIN {_LOADS} i ON i.load > p.load")
def bid_order(spark, d):
    """Every node bids to those with a larger load."""
    l = _loads(spark, d)
    bidders = l.select(F.col("owner").alias("bidder"), F.col("load").alias("mine"))
    calls = l.withColumnRenamed("owner", "initiator").crossJoin(tasks.few(bidders)).where("load > mine")
    return tasks.bid_order(calls)


_OWN_BUNDLE = f"(SELECT t.key % {NODES} AS owner, t.key, sum(nb_values)::BIGINT AS cost, round(coalesce(sum(nb_values) FILTER (t.owner = t.key % {NODES}), 0) / sum(nb_values), 2) AS rate, round(max(nb_values) / sum(nb_values), 2) AS max_rate FROM {_TASKS} t GROUP BY t.key)"
_CLASS = "CASE WHEN rate = 0 THEN 2 WHEN rate = max_rate THEN 0 ELSE 1 END"
_RANKED = f"CASE {_CLASS} WHEN 0 THEN -cost::DOUBLE WHEN 1 THEN -rate ELSE cost::DOUBLE END"


@query("ownership_bundle_order", f"SELECT owner, key, {_CLASS} AS class, row_number() OVER (PARTITION BY owner ORDER BY {_CLASS}, {_RANKED}, key)::INT AS perform_place, row_number() OVER (PARTITION BY owner ORDER BY {_CLASS} DESC, {_RANKED} DESC, key DESC)::INT AS delegate_place FROM {_OWN_BUNDLE}")
def ownership_bundle_order(spark, d):
    t = _tasks(spark, d)
    own = F.coalesce(F.sum(F.when(F.col("owner") == F.col("key") % NODES, F.col("nb_values"))), F.lit(0))
    b = t.groupBy("key").agg(F.sum("nb_values").alias("cost"), F.round(own / F.sum("nb_values"), 2).alias("rate"), F.round(F.max("nb_values") / F.sum("nb_values"), 2).alias("max_rate"))
    return tasks.ownership_bundle_order(b.withColumn("owner", F.col("key") % NODES))


@query("split_in_two", "WITH c AS (SELECT l_suppkey AS key, c, count(*) AS n FROM (SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 50 AS c FROM lineitem) GROUP BY ALL) SELECT key, half, count(*) AS n_chunks, sum(n)::BIGINT AS nb_values FROM (SELECT *, ntile(2) OVER (PARTITION BY key ORDER BY c)::INT AS half FROM c) GROUP BY ALL")
def split_in_two(spark, d):
    chunks = tasks.chunk(table(spark, d, "lineitem"), "l_suppkey", 50)
    return tasks.split_in_two(chunks.withColumnRenamed("l_suppkey", "key"))


@query("k_split_deal", "SELECT key, chunk_index, nb_values, CASE WHEN sum(nb_values) OVER (PARTITION BY key ORDER BY chunk_index) >= n // 2 THEN 3 ELSE chunk_index % 3 END::INT AS part FROM (SELECT l_suppkey AS key, c AS chunk_index, count(*) AS nb_values, any_value(n) AS n FROM (SELECT l_suppkey, ((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 50)::INT AS c, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) GROUP BY l_suppkey, c)")
def k_split_deal(spark, d):
    """Half of every supplier's values dealt to three parts, the rest stays: with equal chunks the parts take turns."""
    chunks = tasks.chunk(table(spark, d, "lineitem"), "l_suppkey", 50).withColumnRenamed("l_suppkey", "key")
    choice = _suppliers(spark, d).select(F.col("l_suppkey").alias("key"), F.call_function("div", F.col("c"), F.lit(2).cast("bigint")).alias("delta"), F.lit(3).alias("k"))
    return tasks.deal_chunks(chunks, choice)


_BIG = f"(SELECT owner, max(cost) * 40 AS cost FROM {_OWNED} GROUP BY owner)"


@query(
    "k_split_choice",
    f"SELECT owner, delta, k, result FROM (SELECT owner, delta, k, round(own - k * delta / (k + 1), 6) AS result, row_number() OVER (PARTITION BY owner ORDER BY round(own - k * delta / (k + 1), 6), k) AS r FROM (SELECT m.owner, m.load AS own, m.load - p.load AS delta, (row_number() OVER (PARTITION BY m.owner ORDER BY p.load, p.owner))::INT AS k FROM {_LOADS} m JOIN {_LOADS} p ON p.owner <> m.owner JOIN {_BIG} b ON b.owner = m.owner WHERE m.load - p.load >= 20 AND m.load - p.load <= b.cost)) WHERE r = 1",
)
def k_split_choice(spark, d):
    big = _owned(spark, d).groupBy("owner").agg((F.max("cost") * 40).alias("cost"))
    return tasks.k_split_choice(_loads(spark, d), big, 10)


# ---- allocation ----

_LPT = f"""WITH RECURSIVE t AS (SELECT key, cost, row_number() OVER (ORDER BY cost DESC, key) AS i FROM {_OWNED}),
r(i, key, cost, receiver, loads) AS (
  SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, NULL::INT, list_transform(range(0, {NODES}), lambda x: 0::BIGINT)
  UNION ALL
  SELECT t.i, t.key, t.cost, (list_position(r.loads, list_min(r.loads)) - 1)::INT, list_transform(r.loads, lambda x, j: x + CASE WHEN j = list_position(r.loads, list_min(r.loads)) THEN t.cost ELSE 0 END)
  FROM r JOIN t ON t.i = r.i + 1)
SELECT key, receiver, cost FROM r WHERE i > 0"""


@query("lpt_allocation", _LPT)
def lpt_allocation(spark, d):
    return allocate.lpt(_owned(spark, d), NODES)


def _best_owners(spark, d):
    t = _tasks(spark, d)
    by = t.groupBy("key").agg(F.sum("nb_values").alias("cost"), F.max("nb_values").alias("_m"), F.collect_list(F.struct("owner", "nb_values")).alias("_o"))  # owners: nodes of a cluster
    return by.select("key", "cost", F.transform(F.filter("_o", lambda o: o["nb_values"] == F.col("_m")), lambda o: o["owner"].cast("int")).alias("best_owners"))


_OWNERSHIP = f"""WITH RECURSIVE s AS (SELECT key, sum(nb_values)::BIGINT AS cost, max(nb_values) AS m FROM {_TASKS} GROUP BY key),
o AS (SELECT s.key, s.cost, coalesce(list(t.owner ORDER BY t.owner) FILTER (t.nb_values = s.m AND t.owner < 6), []) AS near FROM s JOIN {_TASKS} t ON t.key = s.key GROUP BY s.key, s.cost),
t AS (SELECT *, row_number() OVER (ORDER BY len(near) = 0, key) AS i FROM o),
r(i, key, cost, receiver, loads) AS (
  SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, NULL::INT, list_transform(range(0, 6), lambda x: 0::BIGINT)
  UNION ALL
  SELECT i, key, cost, receiver, list_transform(loads, lambda x, j: x + CASE WHEN j = receiver + 1 THEN cost ELSE 0 END)
  FROM (SELECT t.i, t.key, t.cost, r.loads, (list_sort(list_transform(CASE WHEN len(t.near) = 0 THEN range(0, 6) ELSE t.near END, lambda x: r.loads[x + 1] * 100 + x))[1] % 100)::INT AS receiver
        FROM r JOIN t ON t.i = r.i + 1))
SELECT key, receiver, cost FROM r WHERE i > 0"""


@query("ownership_allocation", _OWNERSHIP)
def ownership_allocation(spark, d):
    """Six of the eight nodes receive; tasks of the other two are left over."""
    return allocate.by_ownership(_best_owners(spark, d), 6)


@query("generated_allocation", "SELECT CAST(l_partkey AS VARCHAR) AS key, (l_suppkey % 6)::INT AS receiver, count(*) AS cost FROM lineitem GROUP BY l_partkey, l_suppkey")
def generated_allocation(spark, d):
    keyed = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("cost"))
    return allocate.by_key_suffix(keyed.select(T.composite_key("l_partkey", "l_suppkey", sep="_").alias("key"), "cost"), 6)


@query("hash_allocation", "SELECT key, (abs(h) % 8)::INT AS receiver, cost FROM (SELECT key, cost, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(key::VARCHAR) + 1), lambda i: unicode((key::VARCHAR)[i])::BIGINT)), lambda a, x: ((a * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM " + _OWNED + ")")
def hash_allocation(spark, d):
    return allocate.by_hash(_owned(spark, d), NODES)


_PLANNER = f"""WITH RECURSIVE begin AS (SELECT key, (abs(h) % {NODES})::INT AS receiver, cost FROM (SELECT key, cost, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(key::VARCHAR) + 1), lambda i: unicode((key::VARCHAR)[i])::BIGINT)), lambda a, x: ((a * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM {_OWNED})),
r AS (
  SELECT 0 AS step, key, receiver, cost FROM begin
  UNION ALL
  (WITH loads AS (SELECT n::INT AS receiver, coalesce(sum(cost), 0) AS load FROM range(0, {NODES}) t(n) LEFT JOIN r ON r.receiver = n GROUP BY n),
   ranked AS (SELECT receiver, load, row_number() OVER (ORDER BY load DESC, receiver) AS p FROM loads),
   peers AS (SELECT g.receiver, t.receiver AS taker, g.load AS mine, t.load AS theirs FROM ranked g JOIN ranked t ON t.p = {NODES} + 1 - g.p WHERE g.p <= {NODES // 2} AND g.load > t.load),
   fits AS (SELECT r.key, r.receiver, r.cost, taker, mine, theirs, sum(cost) OVER (PARTITION BY r.receiver ORDER BY cost DESC, key DESC ROWS UNBOUNDED PRECEDING) AS after FROM r JOIN peers ON peers.receiver = r.receiver WHERE mine - (theirs + cost) > 0 AND cost > 0),
   takes AS (SELECT *, bool_and((mine - (after - cost)) - (theirs + after) > 0) OVER (PARTITION BY receiver ORDER BY cost DESC, key DESC ROWS UNBOUNDED PRECEDING) AS ok FROM fits)
   SELECT r.step + 1, r.key, coalesce(m.taker, r.receiver), r.cost FROM r LEFT JOIN (SELECT key, receiver, taker FROM takes WHERE ok) m ON m.key = r.key AND m.receiver = r.receiver WHERE EXISTS (SELECT 1 FROM takes WHERE ok)))
SELECT receiver, sum(cost)::BIGINT AS load FROM r WHERE step = (SELECT max(step) FROM r) GROUP BY receiver"""


@query("delegation_planner", _PLANNER)
def delegation_planner(spark, d):
    """Hash allocation improved by rounds of delegation until nothing moves; loads of the nodes."""
    start = allocate.by_hash(_owned(spark, d), NODES)
    return allocate.loads_of(allocate.delegation_rounds(start, NODES))


# ---- profiles and metrics ----

_PARTS = "(SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)"
_SUPPLIERS = "(SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY l_suppkey)"


def _parts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))


def _suppliers(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("c"))


@query("task_profile", f"SELECT count(*) AS tasks, max(n) AS most, (sum(n)::BIGINT // count(*))::BIGINT AS mean, list_sort(list(n))[(count(*) // 2)::INT + 1] AS median, (count(*) FILTER (n = 1))::BIGINT AS singletons FROM {_PARTS}")
def task_profile(spark, d):
    return metrics.profile(_parts(spark, d))


@query("top_k_tasks", f"SELECT l_partkey, n FROM {_PARTS} ORDER BY n DESC, l_partkey LIMIT 10")
def top_k_tasks(spark, d):
    return _parts(spark, d).orderBy(F.desc("n"), "l_partkey").limit(10)


@query("bottom_k_tasks", f"SELECT l_partkey, n FROM {_PARTS} ORDER BY n, l_partkey LIMIT 10")
def bottom_k_tasks(spark, d):
    return _parts(spark, d).orderBy("n", "l_partkey").limit(10)


@query("contribution_fairness", f"SELECT round(min(c) / max(c), 6) AS fairness FROM {_SUPPLIERS}")
def contribution_fairness(spark, d):
    return _suppliers(spark, d).agg(metrics.ratio("c").alias("fairness"))


@query("time_fairness", "SELECT round(min(t) / max(t), 6) AS fairness, arg_min(u, {'t': t, 'u': u}) AS fastest, arg_max(u, {'t': t, 'u': u}) AS slowest FROM (SELECT user_id AS u, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS t FROM events GROUP BY user_id HAVING count(*) > 1)")
def time_fairness(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("u")).agg((F.max(timeline.millis("ts")) - F.min(timeline.millis("ts"))).alias("t"), F.count("*").alias("n")).where("n > 1")
    return e.agg(metrics.ratio("t").alias("fairness"), F.min_by("u", F.struct("t", "u")).alias("fastest"), F.max_by("u", F.struct("t", "u")).alias("slowest"))


@query("workload_summary", f"SELECT min(c) AS lo, max(c) AS hi, sum(c)::BIGINT AS total, round(avg(c), 6) AS mean FROM {_SUPPLIERS}")
def workload_summary(spark, d):
    return _suppliers(spark, d).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("c").alias("total"), F.round(F.avg("c"), 6).alias("mean"))


_OUTCOMES = "(SELECT event_id % 7 AS o FROM events)"


@query("negotiation_totals", "SELECT " + ", ".join(f"count(*) FILTER (o = {i}) AS {o}" for i, o in enumerate(metrics.NEGOTIATION)) + f" FROM {_OUTCOMES}")
def negotiation_totals(spark, d):
    """Events as a log of negotiations; the seventh kind is none of the outcomes."""
    names = F.array(*[F.lit(o) for o in metrics.NEGOTIATION], F.lit("other"))
    return metrics.negotiation_totals(table(spark, d, "events").select(F.get(names, (F.col("event_id") % 7).cast("int")).alias("outcome")))


@query("initial_workloads", f"SELECT id, arg_min(value, {{'t': ts, 's': seq}}) AS workload FROM {_ARCHIVE} GROUP BY id")
def initial_workloads(spark, d):
    return metrics.initial_workloads(_archive(spark, d))


@query("makespan_gain", f"SELECT round(100 - max(c) FILTER (l_suppkey % 2 = 0) / max(c) * 100, 6) AS gain FROM {_SUPPLIERS}")
def makespan_gain(spark, d):
    return _suppliers(spark, d).agg(metrics.better_by(F.max(F.when(F.col("l_suppkey") % 2 == 0, F.col("c"))), F.max("c")).alias("gain"))


@query("count_if", "SELECT event_type, count(*) FILTER (value > 50) AS n FROM events GROUP BY event_type")
def count_if(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("n"))


@query("argmin_argmax", f"SELECT arg_min(l_suppkey, {{'c': c, 'k': l_suppkey}}) AS least, arg_max(l_suppkey, {{'c': c, 'k': l_suppkey}}) AS most FROM {_SUPPLIERS}")
def argmin_argmax(spark, d):
    return _suppliers(spark, d).agg(F.min_by("l_suppkey", F.struct("c", "l_suppkey")).alias("least"), F.max_by("l_suppkey", F.struct("c", "l_suppkey")).alias("most"))


@query("average_across_runs", "SELECT round(avg(c), 6) AS mean FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_linenumber)")
def average_across_runs(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("c")).agg(F.round(F.avg("c"), 6).alias("mean"))


@query("average_effective_k", "SELECT round(avg(nullif(k, 0)), 6) AS k FROM (SELECT count(*) FILTER (l_returnflag = 'R' AND l_linenumber = 7) AS k FROM lineitem GROUP BY l_suppkey)")
def average_effective_k(spark, d):
    k = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)).alias("k"))
    return k.agg(F.round(F.avg(F.nullif("k", F.lit(0))), 6).alias("k"))


@query("same_results", "SELECT l_partkey, a.v AS left_value, b.v AS right_value FROM (SELECT l_partkey, sum(l_linenumber)::BIGINT AS v FROM lineitem GROUP BY ALL) a FULL JOIN (SELECT l_partkey, sum(l_linenumber)::BIGINT AS v FROM lineitem WHERE l_linenumber < 7 GROUP BY ALL) b USING (l_partkey) WHERE a.v IS DISTINCT FROM b.v")
def same_results(spark, d):
    li = table(spark, d, "lineitem")
    total = lambda df: df.groupBy("l_partkey").agg(folds.add_int("l_linenumber").alias("v"))
    return metrics.same_results(total(li), total(li.where("l_linenumber < 7")), ["l_partkey"], "v")


@query("config_cartesian", "SELECT * FROM (VALUES ('csdb'), ('cbds')) a(policy), (VALUES (0), (1)) b(threshold), (VALUES (1), (4)) c(k)")
def config_cartesian(spark, d):
    one = lambda name, vals, kind: spark.createDataFrame([(v,) for v in vals], f"{name} {kind}")
    return one("policy", ["csdb", "cbds"], "string").crossJoin(one("threshold", [0, 1], "int")).crossJoin(one("k", [1, 4], "int"))


@query("distinct_owners", "SELECT DISTINCT l_suppkey % 8 AS node FROM lineitem")
def distinct_owners(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % NODES).alias("node")).distinct()


@query("list_difference", "SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0")
def list_difference(spark, d):
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").where("o_custkey % 3 = 0").select("o_custkey"))


@query("reducer_series", "SELECT CAST(l_suppkey % 8 AS VARCHAR) || ' ' || CAST(sum(c) AS VARCHAR) || ' ' || string_agg(CAST(c AS VARCHAR), ' ' ORDER BY c DESC) AS line FROM (SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY l_suppkey) GROUP BY l_suppkey % 8")
def reducer_series(spark, d):
    """A line for each receiver: its number, its total and its tasks' sizes, largest first."""
    s = _suppliers(spark, d).groupBy((F.col("l_suppkey") % NODES).alias("r")).agg(F.sum("c").alias("total"), F.sort_array(F.collect_list("c"), asc=False).alias("sizes"))
    return s.select(F.concat_ws(" ", F.col("r").cast("string"), F.col("total").cast("string"), F.array_join(F.col("sizes").cast("array<string>"), " ")).alias("line"))


@query("generate_uniform", "SELECT (i // 30)::INT AS k, count(*) AS n FROM range(0, 3000) t(i) GROUP BY ALL")
def generate_uniform(spark, d):
    return generate.uniform(spark, 100, 30).groupBy("k").agg(F.sum("v").alias("n"))


@query("generate_leave_one_empty", "SELECT (k % 7 + 1)::INT AS reducer, count(*) * 3 AS n FROM range(0, 100) t(k) GROUP BY ALL")
def generate_leave_one_empty(spark, d):
    return generate.leave_one_empty(spark, 100, 3, 8).groupBy("reducer").agg(F.count("*").alias("n"))


def _drawn(tag: int) -> str:
    """The generator's draw of 0 .. 2^32 - 1 for row i, seed 10."""
    return f"('0x' || substr(md5('10-{tag}-' || i), 1, 8))::BIGINT"


@query("generate_skewed", f"SELECT floor(u * u * 200)::INT AS key, count(*) AS n, min(v)::INT AS lo, max(v)::INT AS hi FROM (SELECT ({_drawn(0)} % 1073741824) / 1073741824 AS u, {_drawn(1)} % 99998 + 1 AS v FROM range(0, 20000) t(i)) GROUP BY ALL")
def generate_skewed(spark, d):
    return generate.skewed(spark, 20_000, 200, 8, 8).groupBy("key").agg(F.count("*").alias("n"), F.min("val1").alias("lo"), F.max("val1").alias("hi"))


_USER_WORDS = extend.UserJob(map=lambda line: ((w[0], len(w)) for w in line.split(" ") if w), neutral=lambda: (0, 0), fold=lambda s, v: (s[0] + v, s[1] + 1), merge=lambda a, b: (a[0] + b[0], a[1] + b[1]), post=lambda s: s[0] // s[1])


@query("user_job", f"SELECT word[1] AS key, (sum(length(word))::BIGINT // count(*))::BIGINT AS result FROM {_WORDS} WHERE word <> '' GROUP BY ALL")
def user_job(spark, d):
    """A map function and a fold in Python: the whole mean length of words by first letter."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return extend.run(_USER_WORDS, lines)


# ---- time ----


@query("timeline_tumbling", f"WITH {_CELLS} SELECT bucket, count(seq) AS n FROM grid LEFT JOIN b USING (bucket) GROUP BY bucket")
def timeline_tumbling(spark, d):
    return timeline.tumble(_archive(spark, d), DAY, F.count("*").alias("n"), zero=("n",))


@query("timeline_counts", f"WITH {_CELLS} SELECT bucket, count(seq) AS n, coalesce(sum(value), 0)::BIGINT AS total, (count(seq) FILTER (id = 'click'))::BIGINT AS clicks FROM grid LEFT JOIN b USING (bucket) GROUP BY bucket")
def timeline_counts(spark, d):
    return timeline.tumble(_archive(spark, d), DAY, F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if(F.col("id") == "click").alias("clicks"), zero=("n", "total", "clicks"))


@query("timeline_mean", f"WITH {_CELLS} SELECT bucket, round(sum(value) / count(seq), 6) AS mean FROM grid LEFT JOIN b USING (bucket) GROUP BY bucket")
def timeline_mean(spark, d):
    return timeline.tumble(_archive(spark, d), DAY, F.round(F.sum("value") / F.count("*"), 6).alias("mean"))


_LOCF = f"""WITH {_CELLS}, ids AS (SELECT DISTINCT id FROM a), c AS (SELECT id, bucket, arg_max(value, {{'t': ts, 's': seq}}) AS v FROM b GROUP BY ALL),
f AS (SELECT id, bucket, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY bucket), 0) AS v FROM ids CROSS JOIN grid LEFT JOIN c USING (id, bucket))"""


@query("timeline_fairness", _LOCF + " SELECT bucket, CASE WHEN max(v) = 0 THEN 0 ELSE round(min(v) / max(v), 6) END::DOUBLE AS fairness, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, round(avg(v), 6) AS mean FROM f GROUP BY bucket")
def timeline_fairness(spark, d):
    return timeline.fairness(timeline.carried(_archive(spark, d), DAY, 0))


@query("timeline_state_count", _LOCF + " SELECT bucket, count(*) FILTER (v > 5000) AS n FROM f GROUP BY bucket")
def timeline_state_count(spark, d):
    return timeline.state_count(timeline.carried(_archive(spark, d), DAY, 0), F.col("value") > 5000)


@query("timeline_running_total", f"WITH {_CELLS}, ids AS (SELECT DISTINCT id FROM a), c AS (SELECT id, bucket, sum(value)::BIGINT AS v FROM b GROUP BY ALL) SELECT id, bucket, coalesce(sum(v) OVER (PARTITION BY id ORDER BY bucket), 0)::BIGINT AS value FROM ids CROSS JOIN grid LEFT JOIN c USING (id, bucket)")
def timeline_running_total(spark, d):
    return timeline.running(_archive(spark, d), DAY)


@query("timeline_closed_both", f"WITH {_CELLS} SELECT g.bucket, count(a.seq) AS n FROM grid g CROSS JOIN lim LEFT JOIN a ON a.ts BETWEEN s + (g.bucket - 1) * {DAY} AND s + g.bucket * {DAY} GROUP BY g.bucket")
def timeline_closed_both(spark, d):
    """Buckets closed at both ends: a record on a boundary counts in two."""
    a = _archive(spark, d)
    start, last = timeline.bounds(a)
    i = timeline.bucket(F.col("ts"), F.lit(start), DAY)
    on_edge = (F.col("ts") - start) % DAY == 0
    both = a.select(F.explode(F.when(on_edge, F.array(i, i + 1)).otherwise(F.array(i))).alias("bucket"))
    counts = both.groupBy("bucket").agg(F.count("*").alias("n"))
    return timeline.grid(a, start, last, DAY).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("archive_fuse", f"SELECT id, ts, value, seq FROM {_ARCHIVE}")
def archive_fuse(spark, d):
    a = _archive(spark, d)
    return timeline.fuse(a.where("seq % 2 = 0"), a.where("seq % 2 = 1"))


@query("latest_per_key", "SELECT user_id, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    return timeline.latest(table(spark, d, "events"), "user_id", "value", "ts", "event_id")


@query("latest_every_nth", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i % 5 = 0 OR i = n")
def latest_every_nth(spark, d):
    """Every fifth message of a sender, and its newest."""
    return timeline.latest_every(table(spark, d, "events"), "user_id", 5, "ts", "event_id").select("user_id", "event_id", "value")


@query("stream_timeline", "SELECT (date_trunc('day', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY)::TIMESTAMP AS \"end\", count(*) AS n FROM events GROUP BY ALL")
def stream_timeline(spark, d):
    """The streaming plan in update mode over the files there are; a day's last update is its row."""
    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(d)
    name = scratch_path(spark, "t").rsplit("-", 1)[1]
    plan = archive_stream.right_closed_timeline(s, "ts", "1 day", "10 minutes", F.count("*").alias("n"))
    got = archive_stream.run_once(plan, f"timeline_{name}")
    return got.groupBy("end").agg(F.max("n").alias("n")).select(F.col("end").cast("timestamp_ntz").alias("end"), "n")
