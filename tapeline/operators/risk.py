"""Volatility forecasts and their walk-forward check."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.functions import fixed
from tapeline.functions.finance import annualise, bad_month, typical_month
from tapeline.operators.prices import row_numbers, so_far, timeline
from tapeline.operators.ranking import spearman
from tapeline.operators.rolling import with_stddevs, with_sums
from tapeline.session import cut_lineage


def with_volatility(returns: DataFrame, methods: Mapping[str, int],
                    keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Annualised volatility of the last n rows for each name -> n."""
    out = with_stddevs(returns, "r", methods, keys)
    return out.withColumns({name: annualise(F.col(name)) for name in methods})


def next_rows(value: str, horizon: int, keys: Sequence[str] = ("symbol",)) -> Column:
    """A rolling value over `horizon` rows, seen from the row before they begin."""
    return F.lead(value, horizon).over(timeline(keys))


def ewma_volatility(returns: DataFrame, lam: float = fixed.EWMA_LAMBDA, out: str = "ewma",
                    keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Exponentially weighted volatility: v_0 = r_0^2, v_t = lam * v_(t-1) + (1 - lam) * r_t^2.

    Written as a running sum, lam^t * sum(w_i * r_i^2 * lam^-i), so it stays one window in the JVM.
    The powers restart every `block` rows, where lam^block is 1e-150: finite for a series of any
    length, and only the block just before still matters in double precision.
    """
    block = max(1, int(150 * math.log(10) / -math.log(lam)))
    i = F.row_number().over(timeline(keys)) - 1
    rows = returns.withColumn("_i", i)
    rows = (rows.withColumn("_block", F.floor(F.col("_i") / block).cast("int"))
            .withColumn("_j", F.col("_i") % block))
    weight = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(1.0 - lam))
    term = weight * F.col("r") * F.col("r") * F.pow(F.lit(lam), -F.col("_j"))
    rows = rows.withColumn("_own", F.pow(F.lit(lam), F.col("_j"))
                           * F.sum(term).over(so_far([*keys, "_block"])))
    before = Window.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1)
    carried = F.max(F.when(F.col("_j") == block - 1, F.col("_own"))).over(before)
    variance = (F.col("_own") + F.coalesce(carried, F.lit(0.0))
                * F.pow(F.lit(lam), F.col("_j") + 1))
    scaled = F.sqrt(variance * float(fixed.TRADING_DAYS_PER_YEAR)) * 100.0
    return rows.withColumn(out, scaled).drop("_i", "_block", "_j", "_own")


def volatility_forecasts(returns: DataFrame, keys: Sequence[str] = ("symbol",),
                         windows: dict[str, int] | None = None) -> DataFrame:
    """One column per method, made at the end of each day."""
    windows = fixed.VOLATILITY_WINDOWS if windows is None else windows
    named = {method_column(m): n for m, n in windows.items()}
    return with_volatility(ewma_volatility(returns, keys=keys), named, keys)


def method_column(method: str) -> str:
    return "vol_" + method.replace(" ", "_")


def checkpoints(df: DataFrame, start: int, horizon: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows `start`, `start + horizon`, ... that still have `horizon` rows after them."""
    rows = row_numbers(df, keys)
    rn = F.col("rn")
    return rows.where((rn >= start) & ((rn - start) % horizon == 0)
                      & (rn < F.col("n_rows") - horizon)).drop("rn", "n_rows")


def forecast_pairs(returns: DataFrame, horizon: int = fixed.MONTH_ROWS, start: int = 252,
                   windows: dict[str, int] | None = None) -> DataFrame:
    """(symbol, day, method, forecast, actual) at each checkpoint."""
    windows = fixed.VOLATILITY_WINDOWS if windows is None else windows
    made = volatility_forecasts(with_volatility(returns, {"_now": horizon}), windows=windows)
    kept = checkpoints(made.withColumn("actual", next_rows("_now", horizon)), start, horizon)
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(method_column(m)).alias("forecast"))
                        for m in windows],
                      F.struct(F.lit("EWMA").alias("method"), F.col("ewma").alias("forecast")))
    flat = kept.select("symbol", "day", "actual", F.explode(methods).alias("m"))
    return (flat.select("symbol", "day", "m.method", "m.forecast", "actual")
            .where(F.col("forecast").isNotNull() & F.col("actual").isNotNull()))


def evaluate_forecasts(returns: DataFrame, horizon: int = fixed.MONTH_ROWS, start: int = 252,
                       windows: dict[str, int] | None = None) -> DataFrame:
    """Average miss, rank correlation and number of checks of each method, over all symbols."""
    pairs = forecast_pairs(returns, horizon, start, windows)
    errors = pairs.groupBy("method").agg(
        F.avg(F.abs(F.col("forecast") - F.col("actual"))).alias("avg_error_pts"))
    return errors.join(spearman(pairs, "forecast", "actual", ["method"]), "method")


def return_pairs(returns: DataFrame, horizon: int = fixed.MONTH_ROWS, start: int = 252) -> DataFrame:
    """Sum of the last and of the next `horizon` returns at each checkpoint."""
    rows = with_sums(returns, "r", {"past": horizon})
    rows = rows.withColumn("future", next_rows("past", horizon))
    return (checkpoints(rows, start, horizon).select("symbol", "day", "past", "future")
            .where(F.col("past").isNotNull() & F.col("future").isNotNull()))


def return_persistence(returns: DataFrame, horizon: int = fixed.MONTH_ROWS, start: int = 252) -> DataFrame:
    return spearman(return_pairs(returns, horizon, start), "past", "future")


def monthly_ranges(df: DataFrame, volatility: str = "volatility_pct") -> DataFrame:
    v = F.col(volatility)
    return df.withColumn("typical_pct", typical_month(v)).withColumn("bad_pct", bad_month(v))


def top_performers(closes: DataFrame, period_rows: int) -> DataFrame:
    """Return over the last `period_rows` rows of each symbol's own prices with next month's range;
    symbols not listed long enough are left out. Order by return_pct for the ranking."""
    back = Window.partitionBy("symbol").orderBy(F.desc("day"))     # newest first: all windows share one sort
    rows = closes.where(F.col("close").isNotNull()).select("symbol", "day", "close").withColumns({
        "_base": F.lead("close", period_rows).over(back), "_prev": F.lead("close").over(back), "_last": F.row_number().over(back) == 1})
    rows = rows.withColumn("r", F.try_divide(F.col("close"), F.col("_prev")) - 1.0).where(F.col("r").isNotNull())
    rows = rows.withColumns({"_age": F.row_number().over(back) - 1, "_first": F.lead("day").over(back).isNull()})
    newest = [F.max(F.when(F.col("_last"), F.col(c))).alias(c) for c in ("close", "_base")]
    found = rows.groupBy("symbol").agg(*newest, last_ewma(F.col("r"), F.col("_age"), F.col("_first")).alias("_ewma"),
                                       last_stddev(F.col("r"), F.col("_age"), fixed.VOLATILITY_WINDOWS["3 months"]).alias("_vol"))
    table = found.where(F.col("_base").isNotNull()).select(
        "symbol", ((F.try_divide(F.col("close"), F.col("_base")) - 1.0) * 100.0).alias("return_pct"), annualise(F.coalesce("_vol", "_ewma")).alias("volatility_pct"))
    return monthly_ranges(table)


def last_ewma(r: Column, age: Column, first: Column, lam: float = fixed.EWMA_LAMBDA) -> Column:
    """Aggregate: the last exponentially weighted deviation, of rows numbered back from the newest; `first` is the oldest."""
    return F.sqrt(F.sum(F.when(first, 1.0).otherwise(1.0 - lam) * r * r * F.pow(F.lit(lam), age)))


def last_stddev(r: Column, age: Column, rows: int) -> Column:
    """Aggregate: the sample deviation of the newest `rows` returns, null if there are fewer. As in `with_stddevs`, noise
    counts as zero."""
    recent = F.when(age < rows, r)
    total, squares = F.sum(recent), F.sum(recent * recent)
    spread = squares - total * total / rows
    return F.when(F.count(recent) == rows, F.sqrt(F.when(spread > squares * 1e-14, spread / (rows - 1)).otherwise(F.lit(0.0))))


def best_and_worst(table: DataFrame, by: str = "return_pct", k: int = 5) -> DataFrame:
    """The k best and the k worst rows by one column, then symbol, with their place; missing values last.
    Both ends are top-k reports of a set length, of a table that is made once."""
    ranked = cut_lineage(table)

    def end(order: Column, name: str) -> DataFrame:
        few = ranked.orderBy(order, "symbol").limit(k)
        return few.withColumn("end", F.lit(name)).withColumn("place", F.row_number().over(Window.orderBy(order, "symbol")))
    return end(F.col(by).desc_nulls_last(), "best").unionByName(end(F.col(by).asc_nulls_last(), "worst"))
