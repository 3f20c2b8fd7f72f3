"""Scans of prices, trades and dividends. Filters and columns reach the Parquet reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeline import schema
from tapeline.functions import fixed
from tapeline.operators.prices import complete_days, gap_grid, moment, one_per_day


def daily_closes(spark: SparkSession, path: str, as_of: str, symbols: Sequence[str] | None = None,
                 days: int = 365, keep_gaps: bool = False) -> DataFrame:
    """Closes of the last `days` days before `as_of` (a date), brought to one row per symbol and day.

    `keep_gaps`: the full grid with nulls; otherwise only days on which every symbol has a close.
    """
    start = F.date_sub(F.to_date(F.lit(as_of)), days)
    bars = spark.read.schema(schema.BARS).parquet(path).where(F.col("ts") >= start.cast("timestamp"))
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(*symbols))
    closes = one_per_day(bars.select("symbol", F.to_date("ts").alias("day"), "ts", "close"))
    if not keep_gaps:
        return complete_days(closes, symbols)
    if symbols is None:
        return gap_grid(closes)
    names = spark.createDataFrame([(s,) for s in dict.fromkeys(symbols)], "symbol string")
    return gap_grid(closes, names)


def market_minutes(bars: DataFrame) -> DataFrame:
    """Regular-hours bars (09:30 to 15:59 New York) with local time and date."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(fixed.MARKET_ZONE), F.col("ts").cast("timestamp_ntz"))
    minute = F.date_format("local_ts", "HH:mm")
    return (bars.withColumn("local_ts", local).withColumn("session", F.to_date("local_ts"))
            .where(minute.between(fixed.SESSION_OPEN, fixed.SESSION_LAST_MINUTE)))


def latest_session(bars: DataFrame) -> DataFrame:
    """Minutes of the newest session each symbol traded in."""
    regular = market_minutes(bars)
    newest = regular.groupBy("symbol").agg(F.max("session").alias("session"))
    return regular.join(newest, ["symbol", "session"], "left_semi")


def latest_trade(trades: DataFrame) -> DataFrame:
    at = moment()
    return trades.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("price", at).alias("price"),
                                        F.max_by("size", at).alias("size"))


def dividend_window(dividends: DataFrame, today: str, days: int = 400, ahead: int = 90) -> DataFrame:
    day = F.to_date(F.lit(today))
    return dividends.where(F.col("ex_date").between(F.date_sub(day, days), F.date_add(day, ahead)))


def equity_history(raw: DataFrame) -> DataFrame:
    """Epoch seconds to times; missing and non-positive values are dropped."""
    return (raw.where(F.col("equity") > 0)
            .withColumn("ts", F.timestamp_seconds("ts")))


def bars_view(bars: DataFrame) -> DataFrame:
    """OHLCV rounded to cents."""
    prices = [F.round(c, 2).alias(c) for c in ("open", "high", "low", "close")]
    return bars.select("symbol", "day", *prices, "volume")
