"""Scans of holdings, positions and decision logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeline import schema


def read_holdings_csv(spark: SparkSession, path: str, portfolio_id: int = 0) -> DataFrame:
    raw = spark.read.schema(schema.HOLDINGS_CSV).option("header", True).csv(path)
    return raw.select(F.lit(portfolio_id).cast("bigint").alias("portfolio_id"), "symbol", "name",
                      F.col("value_eur").alias("value"), F.col("profit_eur").alias("profit"))


def positions(raw: DataFrame) -> DataFrame:
    """Broker strings to numbers; the profit share as %."""
    return raw.select("portfolio_id", "symbol", "asset_class", F.col("qty").cast("double").alias("qty"),
                      F.col("market_value").cast("double").alias("value"),
                      (F.col("unrealized_plpc").cast("double") * 100.0).alias("profit_pct"))


def newest_run(log: DataFrame) -> DataFrame:
    """Decisions of each account's latest run."""
    last = log.groupBy("portfolio_id").agg(F.max("time").alias("time"))
    return log.join(last, ["portfolio_id", "time"], "left_semi")


def newest_rows(log: DataFrame, k: int = 20, ties: Sequence[str] = ()) -> DataFrame:
    """The k newest rows, a report of a set length."""
    return log.orderBy(F.desc("time"), "portfolio_id", "symbol", *ties).limit(k)
