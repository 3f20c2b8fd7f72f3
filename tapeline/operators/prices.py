"""Price-table operators: day grids, returns, indicators. Input contract: unique (keys, day)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SYMBOL = ("symbol",)


def timeline(keys: Sequence[str] = SYMBOL, order: str = "day"):
    """Window over one series. A series has one row per day, so it is small by contract."""
    return Window.partitionBy(*keys).orderBy(order)


def so_far(keys: Sequence[str] = SYMBOL, order: str = "day"):
    return timeline(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def one_per_day(closes: DataFrame, keys: Sequence[str] = SYMBOL, latest_by: str = "ts") -> DataFrame:
    """Bring a feed with repeated rows to the (keys, day) grain; partial aggregation does the work."""
    return closes.groupBy(*keys, "day").agg(F.max_by("close", latest_by).alias("close"))


def complete_days(closes: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """Only days on which every symbol has a close. A requested symbol without any row leaves
    no complete day; `missing_symbols` names it."""
    kept = closes.where(F.col("close").isNotNull())
    if symbols is not None:
        kept = kept.where(F.col("symbol").isin(*symbols))
        wanted = F.lit(len(set(symbols)))
    else:
        wanted = kept.agg(F.count_distinct("symbol")).scalar()
    days = (kept.groupBy("day").agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") == wanted).select("day"))
    return kept.join(days, "day", "left_semi").select(*closes.columns)


def gap_grid(closes: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Every (symbol, day) of the calendar; a missing close is null. The calendar is one array
    with a date per trading day."""
    calendar = closes.agg(F.array_sort(F.collect_set("day"))).scalar()
    wanted = symbols if symbols is not None else closes.select("symbol").distinct()
    grid = wanted.select("symbol", F.explode(calendar).alias("day"))
    return grid.join(closes, ["symbol", "day"], "left")


def missing_symbols(closes: DataFrame, symbols: DataFrame) -> DataFrame:
    return symbols.join(closes.where(F.col("close").isNotNull()), "symbol", "left_anti")


def with_history(closes: DataFrame, min_days: int, symbols: DataFrame | None = None) -> DataFrame:
    """Row count per requested symbol and whether it is usable."""
    counts = closes.groupBy("symbol").agg(F.count("close").alias("days"))
    if symbols is not None:
        counts = (symbols.select("symbol").distinct().join(counts, "symbol", "left")
                  .withColumn("days", F.coalesce("days", F.lit(0))))
    return counts.withColumn("usable", F.col("days") >= min_days)


def finished_bars(closes: DataFrame, market_open: bool, market_date: str) -> DataFrame:
    """Drop today's bar while the market is open: it is not a close yet."""
    if not market_open:
        return closes
    return closes.where(F.col("day") != F.to_date(F.lit(market_date)))


def daily_returns(closes: DataFrame, keys: Sequence[str] = SYMBOL, first: float | None = None,
                  value: str = "close", out: str = "r") -> DataFrame:
    """Change against the previous row; the first row is null, or `first`. A zero base gives null."""
    r = F.try_divide(F.col(value), F.lag(value).over(timeline(keys))) - 1.0
    return closes.withColumn(out, r if first is None else F.coalesce(r, F.lit(first)))


def complete_returns(closes: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """Returns on the complete days: a return spans any day that was dropped."""
    returns = daily_returns(complete_days(closes, symbols))
    return returns.where(F.col("r").isNotNull()).select("symbol", "day", "r")


def moves(closes: DataFrame) -> DataFrame:
    """Move in %, its size, and the next row's move."""
    step = daily_returns(closes, out="_r").withColumn("move_pct", F.col("_r") * 100.0).drop("_r")
    return (step.withColumn("size_pct", F.abs("move_pct"))
            .withColumn("next_move_pct", F.lead("move_pct").over(timeline())))


def rebase(closes: DataFrame, base: float = 100.0) -> DataFrame:
    first = F.first("close").over(so_far())
    return closes.withColumn("rebased", F.try_divide(F.col("close"), first) * base)


def fill_forward(df: DataFrame, value: str, keys: Sequence[str] = SYMBOL) -> DataFrame:
    return df.withColumn(value, F.last(value, ignorenulls=True).over(so_far(keys)))


def row_numbers(df: DataFrame, keys: Sequence[str] = SYMBOL) -> DataFrame:
    """0-based position in the series and the series length."""
    everything = timeline(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (df.withColumn("rn", F.row_number().over(timeline(keys)) - 1)
            .withColumn("n_rows", F.count(F.lit(1)).over(everything)))


def recent_moves(closes: DataFrame, month_rows: int = 21) -> DataFrame:
    """Last close with its day move and its move over `month_rows` rows (or since the first row);
    symbols with fewer than two closes are left out."""
    c = F.col("close")
    ordered = timeline()
    tracked = (closes.where(c.isNotNull())
               .withColumn("_prev", F.lag("close").over(ordered))
               .withColumn("_base", F.coalesce(F.lag("close", month_rows).over(ordered),
                                               F.first("close").over(so_far())))
               .withColumn("_last", F.lead("day").over(ordered).isNull()))
    return (tracked.where(F.col("_last") & F.col("_prev").isNotNull())
            .select("symbol", "day", "close",
                    ((F.try_divide(c, F.col("_prev")) - 1.0) * 100.0).alias("day_pct"),
                    ((F.try_divide(c, F.col("_base")) - 1.0) * 100.0).alias("month_pct")))


def change_over_rows(closes: DataFrame, rows: int) -> DataFrame:
    """Change of the last row against `rows` rows before; symbols too short are left out."""
    ordered = timeline()
    tracked = (closes.withColumn("_base", F.lag("close", rows).over(ordered))
               .withColumn("_last", F.lead("day").over(ordered).isNull()))
    return (tracked.where(F.col("_last") & F.col("_base").isNotNull())
            .select("symbol", (F.try_divide(F.col("close"), F.col("_base")) - 1.0).alias("change")))


def period_facts(bars: DataFrame, high: str = "high", low: str = "low") -> DataFrame:
    """First and last close, change, highest high and lowest low per symbol."""
    facts = bars.groupBy("symbol").agg(
        F.min_by("close", "day").alias("first_close"), F.max_by("close", "day").alias("last_close"),
        F.max(high).alias("highest"), F.min(low).alias("lowest"))
    return facts.withColumn("change_pct", (F.try_divide(F.col("last_close"), F.col("first_close"))
                                           - 1.0) * 100.0)


def moment() -> Column:
    """Time and trade_id as one whole number. A struct would order the same, but aggregates over it
    sort all trades; over a number they stay hash-based."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(19,0)")
    span = F.lit(str(2 ** 64)).cast("decimal(20,0)")
    return micros * span + F.col("trade_id").cast("decimal(19,0)")


def trade_bars(trades: DataFrame, bucket: Column, name: str = "day") -> DataFrame:
    """OHLCV bars; `trade_id` settles trades with the same time."""
    at = moment()
    return trades.groupBy("symbol", bucket.alias(name)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("size").alias("volume"))


def session_summary(trades: DataFrame) -> DataFrame:
    """Trades, shares, first, last, low, high and change per symbol."""
    at = moment()
    out = trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("size").alias("shares"),
        F.min_by("price", at).alias("first_price"),
        F.max_by("price", at).alias("last_price"),
        F.min("price").alias("low"), F.max("price").alias("high"))
    return out.withColumn("change_pct", (F.try_divide(F.col("last_price"), F.col("first_price"))
                                         - 1.0) * 100.0)


def wide(closes: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """One column per requested symbol; only for the edge of a report."""
    return closes.groupBy("day").pivot("symbol", list(symbols)).agg(F.first("close"))


def long(table: DataFrame, symbols: Sequence[str]) -> DataFrame:
    return table.unpivot("day", list(symbols), "symbol", "close")
