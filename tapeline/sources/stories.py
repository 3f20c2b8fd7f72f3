"""Scans of news feeds, archives and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeline import schema
from tapeline.functions.textual import site_of
from tapeline.operators.archive import settled
from tapeline.session import exists
from tapeline.sources import runs


def news_for(news: DataFrame, symbol: str, since: str) -> DataFrame:
    return news.where(F.array_contains("symbols", symbol)
                      & (F.col("published") >= F.lit(since).cast("timestamp")))


def feed_to_archive(news: DataFrame) -> DataFrame:
    """A news feed in archive columns, one row per story and ticker; the source comes from the link."""
    return news.select(F.col("published"), F.explode("symbols").alias("symbol"),
                       site_of(F.col("url")).alias("source"), "headline", "summary", "url")


def read_rss(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """RSS files as rows: times in UTC, text trimmed, a missing description empty."""
    items = (spark.read.format("xml").option("rowTag", "item").schema(schema.RSS_ITEM).load(path))
    def trimmed(c):
        return F.btrim(F.coalesce(F.col(c), F.lit("")))
    stamp = F.regexp_extract("pubDate", r"(\d{1,2} \w{3} \d{4} .*)$", 1)
    # with or without seconds; a time that cannot be read is null, and only its story is lost
    when = F.coalesce(*[F.try_to_timestamp(stamp, F.lit(f"d MMM yyyy {clock} Z")) for clock in ("HH:mm:ss", "HH:mm")])
    named = F.regexp_replace(F.col("pubDate"), r"\s(GMT|UT|UTC|Z)\s*$", " +0000")
    items = items.withColumn("pubDate", named)
    return items.select(when.alias("published"), F.lit(symbol).alias("symbol"),
                        site_of(trimmed("link")).alias("source"), trimmed("title").alias("headline"),
                        trimmed("description").alias("summary"), trimmed("link").alias("url"))


def load_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive; an empty table where nothing was ever written. What is there but cannot be read is an
    error, as a merge would otherwise begin anew."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema.ARCHIVE)
    return spark.read.schema(schema.ARCHIVE).parquet(path)


STORIES = schema.ARCHIVE + ", _u string, _h string"
TICKERS = "_u string, _more array<string>"


def archive_parts(spark: SparkSession, root: str, parts: list[runs.Run]) -> tuple[DataFrame, DataFrame]:
    """The stories of some runs of a streamed archive, and the tickers for stories of earlier runs."""
    return settled(runs.read(spark, root, "stories", STORIES, parts), runs.read(spark, root, "tickers", TICKERS, parts))


def newest_archive(spark: SparkSession, root: str) -> DataFrame:
    """The archive as its stream has written it so far."""
    stories, _ = archive_parts(spark, root, runs.runs_after(runs.newest(spark, root)))
    return stories.drop("_u", "_h")
