"""Next month's risk of holdings and whole portfolios, in dollars or euros."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tapeline.functions import fixed
from tapeline.operators import books as bk
from tapeline.operators.risk import monthly_ranges


class Outlook(NamedTuple):
    holdings: DataFrame   # portfolio_id, symbol, volatility_pct, typical_pct, bad_pct
    mix: DataFrame        # portfolio_id, volatility_pct, typical_pct, bad_pct
    left_out: DataFrame


def forecast_holdings(closes: DataFrame, holdings: DataFrame, method: str = "3 months",
                      min_days: int = 63, fx_returns: DataFrame | None = None,
                      windows: dict[str, int] | None = None) -> Outlook:
    """If any holding of a portfolio lacks the method's history, all of them use EWMA; the mix
    always does. With `fx_returns` the swings are those seen in euros."""
    rows = (fixed.VOLATILITY_WINDOWS if windows is None else windows)[method]
    book = bk.books(closes, holdings, min_days, fx_returns=fx_returns)
    made = book.facts(bk.outlook_facts(rows), "symbol string, volatility_pct double")
    return Outlook(monthly_ranges(made.where(F.col("symbol").isNotNull())),
                   monthly_ranges(made.where(F.col("symbol").isNull()).drop("symbol")), book.left_out)


def usd_against_eur(usd_mix: DataFrame, eur_mix: DataFrame, margin: float = 0.5) -> DataFrame:
    """Mix volatility both ways; a difference beyond `margin` points is called."""
    a = usd_mix.select("portfolio_id", F.col("volatility_pct").alias("usd_pct"))
    b = eur_mix.select("portfolio_id", F.col("volatility_pct").alias("eur_pct"))
    gap = F.col("eur_pct") - F.col("usd_pct")
    return a.join(b, "portfolio_id").withColumn(
        "effect", F.when(gap > margin, "adds risk").when(gap < -margin, "lowers risk")
        .otherwise("about the same"))


def plan_risk(closes: DataFrame, plan: DataFrame, months: list[int], min_days: int = 200) -> DataFrame:
    """Volatility and drawdown of a transition plan's mixes at the given months.

    Every symbol of the plan has to be present on a day, whether held at that month or not.
    """
    steps = [F.max(F.when((F.col("month") == m) & (F.col("value") > 0), F.col("value"))).alias(f"_plan{i}") for i, m in enumerate(months)]
    symbols = plan.groupBy("portfolio_id", "symbol").agg(F.max("value").alias("value"), *steps)
    kind = dict(plan.dtypes)["month"]
    return bk.books(closes, symbols, min_days, carry=[f"_plan{i}" for i in range(len(months))], crowded=10).facts(
        bk.plan_facts(months), f"month {kind}, grown_100 double, volatility_pct double, biggest_drop_pct double, days bigint")
