"""Portfolio operators. Everything carries `portfolio_id`, so one job covers all portfolios; holdings are
unique on (portfolio_id, symbol). Statistics over days are in `mixes` and `books`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.functions.finance import annualise
from tapeline.operators.backtest import grown
from tapeline.operators.prices import so_far
from tapeline.operators.ranking import spearman
from tapeline.operators.skew import salted_join

P = ("portfolio_id",)


def _share(value: str, keys: Sequence[str]) -> Column:
    return F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*keys)))


def normalise(weights: DataFrame, value: str = "weight", keys: Sequence[str] = P) -> DataFrame:
    """Scale positive weights to sum to one; the others are dropped."""
    return weights.where(F.col(value) > 0).withColumn(value, _share(value, keys))


def without_positive_weight(weights: DataFrame, value: str = "weight", keys: Sequence[str] = P) -> DataFrame:
    """Portfolios `normalise` cannot scale: the caller decides whether that is an error."""
    return (weights.groupBy(*keys).agg(F.max(value).alias("_max"))
            .where(F.coalesce("_max", F.lit(0.0)) <= 0).drop("_max"))


def held_weights(holdings: DataFrame, keys: Sequence[str] = P) -> DataFrame:
    """Money in each holding -> its share."""
    return holdings.withColumn("weight", _share("value", keys))


def equities(positions: DataFrame) -> DataFrame:
    return positions.where(F.col("asset_class") == "us_equity")


def profit_and_loss(holdings: DataFrame, keys: Sequence[str] = P) -> DataFrame:
    """Cost, profit % and share of the total per holding."""
    cost = F.col("value") - F.col("profit")
    return (holdings.withColumn("cost", cost)
            .withColumn("profit_pct", F.try_divide(F.col("profit"), cost) * 100.0)
            .withColumn("share_pct", _share("value", keys) * 100.0))


def uncovered(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Holdings without any return. The mix is undefined for their portfolios."""
    return weights.join(returns.select("symbol").distinct(), "symbol", "left_anti")


def equal_weight_returns(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return returns.groupBy(*keys, "day").agg(F.avg("r").alias("r"))


def effective_holdings(weights: DataFrame, keys: Sequence[str] = P) -> DataFrame:
    return weights.groupBy(*keys).agg(
        F.try_divide(F.lit(1.0), F.sum(F.col("weight") * F.col("weight"))).alias("effective"))


def path_stats(series: DataFrame, keys: Sequence[str], **more: Column) -> DataFrame:
    """What 100 became, volatility and worst drawdown of each daily series.

    The path starts at 100 * (1 + first return), so a loss on the first day is not a drawdown. `more`
    adds aggregates of other columns of the series.
    """
    value = F.product(1.0 + F.col("r")).over(so_far(keys))
    path = series.withColumn("_v", value)
    path = path.withColumn("_peak", F.max("_v").over(so_far(keys)))
    return path.groupBy(*keys).agg(
        grown(F.col("r")).alias("grown_100"), annualise(F.stddev_samp("r")).alias("volatility_pct"),
        (F.min(F.try_divide(F.col("_v") - F.col("_peak"), F.col("_peak"))) * 100.0)
        .alias("biggest_drop_pct"),
        F.count(F.lit(1)).alias("days"), *[c.alias(name) for name, c in more.items()])


def growth(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series.withColumn("growth", 100.0 * F.product(1.0 + F.col("r")).over(so_far(keys)))


def symbol_years(returns: DataFrame) -> DataFrame:
    """The same statistics for each symbol on its own."""
    series = returns.select("symbol", "day", "r").withColumn("year", F.year("day"))
    stats = path_stats(series, ["symbol", "year"])
    return stats.select("symbol", "year", (F.col("grown_100") - 100.0).alias("return_pct"),
                        "volatility_pct", "biggest_drop_pct", "days")


def year_pairs(years: DataFrame, value: str) -> DataFrame:
    """Each symbol's value of one year beside its next year's."""
    following = years.select("symbol", (F.col("year") - 1).alias("year"), F.col(value).alias("next"))
    return years.select("symbol", "year", F.col(value).alias("this")).join(following, ["symbol", "year"])


def holders(holdings: DataFrame) -> DataFrame:
    """How many rows each symbol has: what a join on symbol is balanced by."""
    return holdings.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def with_sector(df: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sector by symbol, Other when unknown. No hint: small tables are broadcast by their size."""
    return (df.join(sectors.select("symbol", "sector"), "symbol", "left")
            .withColumn("sector", F.coalesce("sector", F.lit("Other"))))


def sector_money(positions: DataFrame, value: str = "money_pct", keys: Sequence[str] = P) -> DataFrame:
    return positions.groupBy(*keys, "sector").agg(F.sum(value).alias(value))


def basket_stats(returns: DataFrame, baskets: DataFrame) -> DataFrame:
    """Equal-weight baskets(basket, symbol) side by side."""
    joined = salted_join(baskets, returns, ["symbol"])
    return path_stats(equal_weight_returns(joined, ["basket"]), ["basket"])


def swap(weights: DataFrame, out_symbol: str, in_symbol: str, default: float,
         keys: Sequence[str] = P) -> DataFrame:
    """What-if: the share of one holding moves to another. When it is not held, `default` is added."""
    moved = weights.groupBy(*keys).agg(F.coalesce(
        F.max(F.when(F.col("symbol") == out_symbol, F.col("weight"))), F.lit(default)).alias("weight"))
    rest = weights.where(F.col("symbol") != out_symbol).select(*keys, "symbol", "weight")
    added = moved.select(*keys, F.lit(in_symbol).alias("symbol"), "weight")
    return rest.unionByName(added).groupBy(*keys, "symbol").agg(F.sum("weight").alias("weight"))


def compare_years(current: DataFrame, what_if: DataFrame) -> DataFrame:
    """Years in which the what-if was calmer or made more; equal mixes differ only by summation
    noise, which is rounded off."""
    def less(a, b):
        return F.round(F.col(a), 6) < F.round(F.col(b), 6)
    b = what_if.select("portfolio_id", "year", F.col("volatility_pct").alias("_v"),
                       F.col("return_pct").alias("_r"))
    return (current.join(b, ["portfolio_id", "year"]).groupBy("portfolio_id")
            .agg(F.count_if(less("_v", "volatility_pct")).alias("calmer_years"),
                 F.count_if(less("return_pct", "_r")).alias("richer_years"),
                 F.count(F.lit(1)).alias("years")))


def excluded_money(holdings: DataFrame, left_out: DataFrame) -> DataFrame:
    """Money left out of the risk maths and its share of the portfolio."""
    total = holdings.groupBy("portfolio_id").agg(F.sum("value").alias("total"))
    out = left_out.groupBy("portfolio_id").agg(F.sum("value").alias("excluded"))
    joined = total.join(out, "portfolio_id", "left")
    return joined.select("portfolio_id", "total", F.coalesce("excluded", F.lit(0.0)).alias("excluded"),
                         (F.try_divide(F.coalesce("excluded", F.lit(0.0)), F.col("total")) * 100.0)
                         .alias("excluded_pct"))


def cash_share(holdings: DataFrame, cash: DataFrame) -> DataFrame:
    """Money invested, cash and the cash's share in % of each account."""
    invested = holdings.groupBy("portfolio_id").agg(F.sum("value").alias("invested"))
    both = invested.join(cash.select("portfolio_id", "cash"), "portfolio_id", "left").withColumn("cash", F.coalesce("cash", F.lit(0.0)))
    return both.withColumn("cash_pct", F.try_divide(F.col("cash"), F.col("cash") + F.col("invested")) * 100.0)


def swing_money(holdings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Money of a typical and of a bad month of each holding; `ranges` has typical_pct and bad_pct."""
    return holdings.select("portfolio_id", "symbol", "value").join(ranges.select("symbol", "typical_pct", "bad_pct"), "symbol").select(
        "portfolio_id", "symbol", (F.col("value") * F.col("typical_pct") / 100.0).alias("typical_money"),
        (F.col("value") * F.col("bad_pct") / 100.0).alias("bad_money"))


def mean_rank_persistence(years: DataFrame, values: Sequence[str] = ("volatility_pct", "return_pct")) -> DataFrame:
    """(measure, rank_corr, years): the mean over pairs of neighbouring years of how alike the ranks are."""
    out = None
    for value in values:
        each = spearman(year_pairs(years, value), "this", "next", ["year"])
        mean = each.agg(F.avg("rank_corr").alias("rank_corr"), F.count("rank_corr").alias("years")).select(
            F.lit(value).alias("measure"), "rank_corr", "years")
        out = mean if out is None else out.unionByName(mean)
    return out
