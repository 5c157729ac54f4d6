"""The catalogue of named jobs: each is a plan over the typed columns of its data set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions.text import half_unit_bin, or_empty_key, parse_or
from keyfold.operators import folds
from keyfold.sources.readers import read_dataset

#: Text of a missing value, and the text by which a header row of sales is known.
MISSING, SALES_HEADER = "mq", "montant"
KELVIN = 273.15


@dataclass(frozen=True)
class Job:
    """A named query: the data set it reads and its plan."""

    name: str
    source: str
    plan: Callable[[DataFrame], DataFrame]


JOBS: dict[str, Job] = {}


def job(name: str, source: str):
    """Registers a plan under its name."""

    def add(plan):
        JOBS[name] = Job(name, source, plan)
        return plan

    return add


def run(spark: SparkSession, name: str, paths: str | list[str], permissive: bool = False) -> DataFrame:
    """Runs a job by name over files of its data set."""
    if name not in JOBS:
        raise KeyError(f"unknown job {name!r}; there are {', '.join(sorted(JOBS))}")
    return JOBS[name].plan(read_dataset(spark, JOBS[name].source, paths, permissive))


def _count(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


@job("countkey", "kv")
def count_key(df):
    """Sums field 1 by field 0."""
    return df.groupBy("k").agg(folds.add_int("v").alias("total"))


@job("generated", "skewed")
def generated(df):
    return df.groupBy("key", "reducer").agg(folds.mean_int("val1").alias("mean"))


@job("meteoPrecipitationByStation", "weather")
def precipitation_by_station(df):
    """Text that is no number counts as 0."""
    return df.groupBy("station").agg(folds.add_double(parse_or(F.col("precip")), 6).alias("total"))


@job("meteoTemperatureByStation", "weather")
def temperature_by_station(df):
    return df.where(F.col("temp") != MISSING).groupBy("station").agg(folds.mean_double(F.col("temp").cast("double") - KELVIN, 6).alias("mean"))


def _bins(df):
    """Celsius by half units; the difference is rounded to nine places first, so that 25.5 is not taken for 25.4999..."""
    return df.where(F.col("temp") != MISSING).withColumn("bin", half_unit_bin(F.round(F.col("temp").cast("double") - KELVIN, 9)))


@job("meteoRecordByTemperature", "weather")
def record_by_temperature(df):
    return _count(_bins(df), "bin")


@job("meteoRecordByTemperatureStation", "weather")
def record_by_temperature_station(df):
    return _count(_bins(df.where(F.col("station") != MISSING)), "bin", "station")


@job("meteoRecordByYearStation", "weather")
def record_by_date_suffix_station(df):
    """Keeps its name's history: the key is the date without its first four characters."""
    return _count(df, F.substr("date", F.lit(5)).alias("suffix"), "station")


@job("recordByCalendarYearStation", "weather")
def record_by_year_station(df):
    """What the name above says: by year."""
    return _count(df, F.substr("date", F.lit(1), F.lit(4)).alias("year"), "station")


@job("netflixRecordBySomeFilms", "ratings")
def record_by_some_films(df):
    return _count(df.where(F.col("film").cast("int") < 9000), "film")


@job("netflixRecordByScoreFilm", "ratings")
def record_by_score_film(df):
    return _count(df, "film", "score")


@job("netflixRecordByDayMonth", "ratings")
def record_by_day_month(df):
    return _count(df, F.concat_ws(" ", F.split_part("day", F.lit("-"), F.lit(2)), F.split_part("day", F.lit("-"), F.lit(3))).alias("day"))


@job("netflixScoreByFilm", "ratings")
def score_by_film(df):
    return df.where(F.col("score") != MISSING).groupBy("film").agg(folds.mean_double(F.col("score").cast("double"), 6).alias("mean"))


@job("netflixRecordByFilm", "ratings")
def record_by_film(df):
    return _count(df, F.col("film").cast("double").alias("film"))


@job("musicMeanBySong", "songs")
def mean_by_song(df):
    return df.groupBy("song").agg(folds.mean_int("grade").alias("mean"))


@job("musicCountGrade", "songs")
def count_grade(df):
    return _count(df, "grade")


@job("yahooCountByAccount", "keywords")
def count_by_account(df):
    return _count(df, "account")


@job("yahooCountByKeyword", "keywords")
def count_by_keyword(df):
    """Empty words between spaces count, those at the end do not."""
    cut = F.regexp_replace("phrase", " +$", "")
    words = F.when((cut == "") & (F.col("phrase") != ""), F.array().cast("array<string>")).otherwise(F.split(cut, " "))
    return _count(df.select(F.explode(words).alias("keyword")), "keyword")


def _sales(df):
    return df.where(F.col("amount") != SALES_HEADER).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def _revenue(df, *keys):
    return _sales(df).groupBy(*keys).agg(folds.add_double("amount", 2).alias("revenue"))


@job("revenueByArticle", "sales")
def revenue_by_article(df):
    return _revenue(df, or_empty_key("article").alias("article"))


@job("revenueByShop", "sales")
def revenue_by_shop(df):
    return _revenue(df, "shop")


@job("revenueByShopAndArticle", "sales")
def revenue_by_shop_and_article(df):
    return _revenue(df, "shop", "article").select(F.concat_ws("@", "shop", "article").alias("key"), "revenue")


@job("revenueByDate", "sales")
def revenue_by_date(df):
    return _revenue(df, or_empty_key("date").alias("date"))


@job("countWords", "text")
def count_words(df):
    """Non-empty words between spaces of every line."""
    lines = df.select(F.explode(F.split("line", "\n")).alias("line"))
    return _count(lines.select(F.explode(F.split("line", " ")).alias("word")).where("word <> ''"), "word")
