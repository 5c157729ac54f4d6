"""Fixtures with hand-made results, invariants and streaming."""

import pytest
from pyspark.sql import functions as F

from keyfold.functions import text
from keyfold.operators import allocate, folds, metrics, tasks, timeline
from keyfold.plans import jobs
from keyfold.sources import generate, readers, sinks
from keyfold.streaming import archive_stream


def run(spark, tmp_path, name, lines, **kw):
    p = tmp_path / "in.txt"
    p.write_text("\n".join(lines))
    return sorted(map(tuple, jobs.run(spark, name, str(p), **kw).collect()))


def weather(station="A", date="20190105120000", temp="mq", precip="mq"):
    f = [""] * 41
    f[0], f[1], f[7], f[40] = station, date, temp, precip
    return ";".join(f)


def test_half_degrees(spark, tmp_path):
    lines = [weather(temp=t) for t in ("mq", "298.65", "298.64", "272.9")]
    assert run(spark, tmp_path, "meteoRecordByTemperature", lines) == [(-0.5, 1), (25.0, 1), (25.5, 1)]
    assert run(spark, tmp_path, "meteoRecordByTemperatureStation", [*lines, weather("mq", temp="290")]) == [(-0.5, "A", 1), (25.0, "A", 1), (25.5, "A", 1)]


def test_other_weather_jobs(spark, tmp_path):
    assert run(spark, tmp_path, "meteoPrecipitationByStation", [weather(precip="x"), weather(precip="1.5")]) == [("A", 1.5)]
    assert run(spark, tmp_path, "meteoTemperatureByStation", [weather(temp="274.15"), weather(), weather(temp="276.15")]) == [("A", 2.0)]
    assert run(spark, tmp_path, "meteoRecordByYearStation", [weather("7")]) == [("0105120000", "7", 1)]
    assert run(spark, tmp_path, "recordByCalendarYearStation", [weather("7")]) == [("2019", "7", 1)]


def test_means_and_counts(spark, tmp_path):
    assert run(spark, tmp_path, "musicMeanBySong", ["1\tu\t3", "1\tu\t4"]) == [(1, 3)]
    assert run(spark, tmp_path, "musicCountGrade", ["1\tu\t3", "2\tu\t3"]) == [(3, 2)]
    assert run(spark, tmp_path, "countkey", ["1;5", "1;6", "", "2;1"]) == [(1, 11), (2, 1)]
    assert run(spark, tmp_path, "generated", ["1;2;-3;0;0;0", "1;2;-4;0;0;0"]) == [(1, 2, -3)]
    assert run(spark, tmp_path, "yahooCountByKeyword", ["0\tacc\t0\ta  b  "]) == [("", 1), ("a", 1), ("b", 1)]
    assert run(spark, tmp_path, "yahooCountByAccount", ["0\tacc\t0\ta"]) == [("acc", 1)]
    assert run(spark, tmp_path, "countWords", [" a  b "]) == [("a", 1), ("b", 1)]


def test_ratings(spark, tmp_path):
    lines = ["1,u,4,2004-05-06", "1,u,mq,2004-05-06", "9001,u,2,2005-05-06"]
    assert run(spark, tmp_path, "netflixRecordBySomeFilms", lines) == [("1", 2)]
    assert run(spark, tmp_path, "netflixRecordByDayMonth", lines) == [("05 06", 3)]
    assert run(spark, tmp_path, "netflixScoreByFilm", lines) == [("1", 4.0), ("9001", 2.0)]
    assert run(spark, tmp_path, "netflixRecordByFilm", lines) == [(1.0, 2), (9001.0, 1)]
    assert run(spark, tmp_path, "netflixRecordByScoreFilm", lines) == [("1", "4", 1), ("1", "mq", 1), ("9001", "2", 1)]


def test_sales(spark, tmp_path):
    lines = [";shop;date;;article;montant", ";S;D;;;2.0"]
    assert run(spark, tmp_path, "revenueByArticle", lines) == [("empty key", 2.0)]
    assert run(spark, tmp_path, "revenueByShop", lines) == [("S", 2.0)]
    assert run(spark, tmp_path, "revenueByShopAndArticle", lines) == [("S@", 2.0)]
    assert run(spark, tmp_path, "revenueByDate", lines) == [("D", 2.0)]


def test_strict_and_permissive(spark, tmp_path):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        run(spark, tmp_path, "countkey", ["1;x"])
    assert run(spark, tmp_path, "countkey", ["1;x", "1;2"], permissive=True) == [(1, 2)]
    with pytest.raises(KeyError):
        jobs.run(spark, "none", "x")


def test_split_and_hash(spark):
    df = spark.createDataFrame([("a;b;;",), (";;",), ("",), (";a",)], "v string")
    assert [r[0] for r in df.select(text.split_fields("v", ";")).collect()] == [["a", "b"], [], [""], ["", "a"]]
    h = spark.createDataFrame([("station_7",), ("",), ("polygenelubricants",)], "v string")
    assert [r[0] for r in h.select(text.java_hash("v")).collect()] == [-2081386516, 0, -2147483648]
    assert all(0 <= r[0] < 7 for r in h.select(text.hash_bucket("v", 7)).collect())


def test_two_phases_equal_one(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") - 500).alias("v"), (F.col("id") % 13).alias("part"))
    one = folds.fold_by(df, ["k"], mean_int=folds.mean_int("v"))
    two = folds.two_phase_mean_int(df, ["k"], "v", "part").select("k", "mean_int")
    assert sorted(one.collect()) == sorted(two.collect())
    assert metrics.same_results(one, two, ["k"], "mean_int").count() == 0


def test_lpt_and_ownership(spark):
    t = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], "key string, cost bigint")
    assert sorted(r["load"] for r in allocate.loads_of(allocate.lpt(t, 2)).collect()) == [8, 10]
    many = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") % 37 + 1).alias("cost"))
    blocked = allocate.lpt(many, 6, blocks=8)
    loads = [r["load"] for r in allocate.loads_of(blocked).collect()]
    assert blocked.select("key").distinct().count() == 5000 and max(loads) - min(loads) <= 8 * 37
    rates = tasks.ownership_rate(spark.createDataFrame([("t", "x", 2), ("t", "y", 1)], "key string, owner string, nb_values bigint"))
    assert sorted((r["owner"], r["rate"]) for r in rates.collect()) == [("x", 0.67), ("y", 0.33)]


def test_planner_invariants(spark):
    t = spark.range(200).select(F.col("id").alias("key"), (F.col("id") % 17 + 1).alias("cost"))
    start = t.withColumn("receiver", F.when(F.col("key") < 120, 0).otherwise(F.col("key") % 5).cast("int"))
    end = allocate.delegation_rounds(start, 5, 8)
    a, b = ({r["receiver"]: r["load"] for r in allocate.loads_of(x).collect()} for x in (start, end))
    assert sum(a.values()) == sum(b.values()) and max(b.values()) < max(a.values())
    assert end.count() == 200 == end.select("key").distinct().count()
    placed = allocate.apply(t, end, "key", 5).withColumn("p", F.spark_partition_id())
    assert placed.where("p <> receiver").count() == 0


def test_planner_stops_when_nothing_moves(spark):
    """All tasks start on one node; no mirrored pair is left that accepts another."""
    t = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") % 17 + 1).alias("cost"), F.lit(0).alias("receiver"))
    rows = allocate.delegation_rounds(t, 6).collect()
    assert sorted(r["key"] for r in rows) == list(range(3000))
    loads = {r: sum(x["cost"] for x in rows if x["receiver"] == r) for r in range(6)}
    ranked = sorted(loads, key=lambda r: (-loads[r], r))
    for g, t in zip(ranked[:3], reversed(ranked)):
        assert not any(loads[t] + x["cost"] < loads[g] for x in rows if x["receiver"] == g)


def test_right_closed_buckets(spark):
    a = spark.createDataFrame([(0,), (1000,), (1001,), (3000,)], "ts bigint")
    got = timeline.tumble(a, 1000, F.count("*").alias("n"), zero=("n",)).orderBy("bucket").collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 0)]
    assert timeline.tumble(a.limit(0), 1000, F.count("*").alias("n")).count() == 0


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i // 3} 0{i % 3 * 4}:00:00", i % 2, i) for i in range(9)]
    df = spark.createDataFrame(rows, "ts string, k int, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    plan = lambda x: archive_stream.right_closed_timeline(x, "ts", "1 day", "1 minute", F.count("*").alias("n"))
    assert sorted(map(tuple, archive_stream.run_once(plan(s), "a", "update").collect())) == sorted(map(tuple, plan(df).select("n", "end").collect()))
    closed = archive_stream.run_once(plan(s), "b", "append").collect()
    assert len(closed) < plan(df).count()
    newest = archive_stream.run_once(archive_stream.latest_per_key(s, "k", "v", "ts"), "c")
    assert sorted(map(tuple, newest.collect())) == [(0, 8), (1, 7)]


def test_sources_and_sinks(spark, tmp_path):
    df = generate.uniform(spark, 4, 5)
    assert df.count() == 20 and [r[0] for r in df.groupBy("k").count().select("count").distinct().collect()] == [5]
    assert generate.leave_one_empty(spark, 6, 2, 3).where("reducer = 0").count() == 0
    sk = generate.skewed(spark, 2000, 50, 4, 4)
    assert sk.count() == 2000 and sk.where("val1 < 1 or val1 > 99998 or key < 0 or key >= 50").count() == 0
    assert sorted(sk.collect()) == sorted(generate.skewed(spark, 2000, 50, 4, 4).collect())
    sinks.write_results(df.groupBy("k").agg(F.sum("v").alias("v")), ["k"], "v", str(tmp_path / "r"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "r")).collect()) == ["0 5", "1 5", "2 5", "3 5"]
    sinks.write_record(spark.createDataFrame([(2, 1)], "b int, a int"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).collect()[0][0] == "a;b"
    split = readers.round_robin(df.withColumn("n", F.monotonically_increasing_id()), 3, "n")
    assert sorted(r["count"] for r in split.groupBy("split").count().collect()) == [6, 7, 7]
    assert readers.parse_config(["// c", "a : b", "x : y : z", "no colon"]) == {"a": "b", "x": "y"}
    held = readers.project(readers.memory(spark, "1;\u00e9\n\n2;x\n".encode()), ";", {"k": (0, "int"), "v": (1, "string")})
    assert sorted(map(tuple, held.collect())) == [(1, "\u00e9"), (2, "x")] and readers.memory(spark, "").count() == 0
    assert readers.parse_addresses(["// c", "host 3", ""]) == [("host", 3)]


def test_round_robin_under_small_partitions(spark):
    """A wide column that is used, and partitions that adaptive execution coalesces: numbers stay those of the order."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "60k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        df = spark.range(60_000).select(((F.col("id") * 7919) % 60_000).alias("n"), F.repeat(F.col("id").cast("string"), 12).alias("wide"))
        got = readers.round_robin(df, 8, "n")
        assert got.where("split <> n % 8").count() == 0 and got.count() == 60_000
        assert got.agg(F.sum(F.length("wide") * 0 + F.col("split") - F.col("n") % 8)).first()[0] == 0
        assert got.where(F.length("wide") > 10).where("split <> n % 8").count() == 0
        chunks = tasks.assign_chunks(df.withColumn("k", F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("n") % 50)), "k", 100, "n").collect()
        by: dict = {}
        for r in sorted(chunks, key=lambda r: r["n"]):
            i = by.get(r["k"], 0)
            assert r["chunk_index"] == i // 100
            by[r["k"]] = i + 1
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_chunks_and_deals(spark, tmp_path):
    rows = [("a", i, n) for i, n in enumerate([5, 3, 4, 4, 9, 1])] + [("b", 0, 2)]
    chunks = spark.createDataFrame(rows, "key string, chunk_index int, nb_values bigint")
    choice = spark.createDataFrame([("a", 17, 2)], "key string, delta bigint, k int")
    got = sorted(map(tuple, tasks.deal_chunks(chunks, choice).collect()))
    # 5 to the first part, 3 and then 4 to the second; 16 values are below 17, the chunk of 9 and what follows stay
    assert got == [("a", 0, 5, 0), ("a", 1, 3, 1), ("a", 2, 4, 1), ("a", 3, 4, 0), ("a", 4, 9, 2), ("a", 5, 1, 2)]
    values = spark.createDataFrame([("k 1", 0, 3), ("k 1", 0, 1), ("k 1", 1, 2), ("z", 0, 7)], "key string, chunk_index int, value int")
    sinks.write_chunks(values, str(tmp_path / "c"))
    back = readers.chunk_files(spark, str(tmp_path / "c"))
    assert sorted((r["key"], r["value"]) for r in back.collect()) == [("k 1", "1"), ("k 1", "2"), ("k 1", "3"), ("z", "7")]
    assert back.select("file").distinct().count() == 3


def test_amplification(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")  # hashes 97, 98, 99
    f = tasks.amplification("k", F.lit(5), (1, 4), 4, 2, 1, 3)
    # classes of 4: 1, 2 and 3; the chosen class 1 gets 2 + 1 + 5 % 3
    assert [tuple(r) for r in keys.select("k", f.alias("f")).orderBy("k").collect()] == [("a", 5), ("b", 2), ("c", 2)]


def test_mailbox_and_folds(spark):
    df = spark.createDataFrame([("x", i, i * 10) for i in range(1, 8)] + [("y", 1, 5)], "k string, t int, v int")
    got = sorted((r["k"], r["t"]) for r in timeline.latest_every(df, "k", 3, "t").collect())
    assert got == [("x", 3), ("x", 6), ("x", 7), ("y", 1)]
    assert sorted((r["k"], r["t"]) for r in timeline.latest_every(df, "k", 0, "t").collect()) == [("x", 7), ("y", 1)]
    joined = folds.fold_sorted(df, ["k"], "v", "", lambda a, x: f"{a},{x}", lambda a: a[1:], "string", "line")
    assert sorted(map(tuple, joined.collect())) == [("x", "10,20,30,40,50,60,70"), ("y", "5")]
    assert folds.fold_sorted(df.limit(0), ["k"], "v", 0, lambda a, x: a + x).count() == 0


def test_nodes_are_counted(spark):
    nodes = spark.range(30).select(F.col("id").alias("owner"), F.col("id").alias("load"))
    assert "broadcast" in tasks.few(nodes)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in tasks.few(nodes, 10)._jdf.queryExecution().analyzed().toString().lower()
    with pytest.raises(ValueError, match="nodes"):
        tasks._ranked(nodes, F.col("load"), most=10)


def test_strategies_and_config(spark):
    from keyfold.plans import strategies as st

    t = spark.createDataFrame([("a", 0, 4), ("a", 1, 2), ("b", 1, 3)], "key string, owner int, nb_values bigint")
    agents = spark.createDataFrame([(0,), (1,)], "agent int")
    plain = sorted(map(tuple, st.cost_strategy("(multiplier, 1.1)")(t, agents).collect()))
    assert plain == [("a", 6), ("b", 3)]
    assert sorted(map(tuple, st.cost_strategy("(multiplier, 2)")(t, agents).collect())) == [("a", 0, 8), ("a", 1, 10), ("b", 0, 6), ("b", 1, 3)]
    assert st.cost_strategy("(hardware, 1, 10, 5, 0, 2)")(t, agents).count() == 4
    owned = spark.createDataFrame([("a", 0, 9), ("b", 0, 1), ("c", 1, 1)], "key string, owner int, cost bigint")
    loads = owned.groupBy("owner").agg(F.sum("cost").alias("load"))
    assert sorted(map(tuple, st.bundle_strategy("csdb")(owned, loads).collect())) == [(0, "a"), (1, "c")]
    assert [tuple(r) for r in st.bundle_strategy("(k-eligible-small, 2)")(owned, loads).collect()] == [(0, "b", 1, 1, 1)]
    assert st.bundle_strategy("csdb", 1.0)(owned, loads).count() == 0
    for f, x in ((st.bundle_strategy, "naive"), (st.partition_strategy, "none")):
        with pytest.raises(KeyError):
            f(x)
    c = st.RunConfig.parse(["nb-reducer : 3", "task-split : true", "threshold : 0.5", "other : 1"])
    assert (c.nb_reducer, c.task_split, c.threshold, c.nb_mapper) == (3, True, 0.5, 8)
    assert st.expand_sweep(["a : 1", "*b : 2, 3"]) == [{"a": "1", "b": "2"}, {"a": "1", "b": "3"}]
    assert set(st.sweep_folders(["a : 1", "* z : x y", "*b : 2, 3"])) == {"b-2_z-xy", "b-3_z-xy"}
    assert sorted(map(tuple, st.perform_strategy("(k-eligible-big, 2)")(owned).collect())) == [(0, "a"), (1, "c")]
    assert sorted(map(tuple, st.perform_strategy("(k-eligible-small, 2)")(owned).collect())) == [(0, "b"), (1, "c")]
    assert sorted(map(tuple, tasks.k_eligible(owned, loads, 2, "big").collect())) == [(0, "a", "b"), (1, "c", None)]
    heavy = owned.unionByName(spark.createDataFrame([("d", 0, 40)], "key string, owner int, cost bigint"))
    total = heavy.groupBy("owner").agg(F.sum("cost").alias("load"))
    for allowed, n in ((True, 0), (False, 0)):
        assert st.split_strategy(st.RunConfig(task_split=allowed, chunk_size=4))(total, heavy).count() == n
    wide = spark.createDataFrame([(0, 60), (1, 30)], "owner int, load bigint")
    assert [tuple(r) for r in st.split_strategy(st.RunConfig(task_split=True, chunk_size=4))(wide, heavy).collect()] == [(0, 30, 1, 45.0)]
