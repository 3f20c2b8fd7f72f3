"""Dollar prices and returns seen in euros."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeline.functions.finance import currency_part_pct, euro_return, euro_total_pct
from tapeline.operators.prices import fill_forward
from tapeline.operators.skew import salted_join


def to_euro_prices(closes: DataFrame, rates: DataFrame) -> DataFrame:
    """Divide by the rate of the same day, filled forward along the price days of each symbol;
    days before the first rate stay null."""
    joined = closes.join(rates.select("day", "rate"), "day", "left")
    return (fill_forward(joined, "rate")
            .withColumn("close_eur", F.try_divide(F.col("close"), F.col("rate"))))


def to_euro_returns(returns: DataFrame, fx_returns: DataFrame) -> DataFrame:
    fx = fx_returns.select("day", F.col("r").alias("_fx"))
    return (returns.join(fx, "day", "left")
            .withColumn("r_eur", euro_return(F.col("r"), F.col("_fx"))).drop("_fx"))


def split_return(df: DataFrame, usd_pct: str, fx_pct: str) -> DataFrame:
    """Result in euros and the part that came from the exchange rate."""
    usd, fx = F.col(usd_pct), F.col(fx_pct)
    return (df.withColumn("total_eur_pct", euro_total_pct(usd, fx))
            .withColumn("currency_pct", currency_part_pct(usd, fx)))


def mix_in_both(holdings: DataFrame, changes: DataFrame, fx_pct: str = "fx_pct") -> DataFrame:
    """Result of each whole portfolio in dollars and euros, weighted over the covered holdings.

    `changes(symbol, usd_pct, fx_pct)`.
    """
    covered = salted_join(holdings, changes.where(F.col("usd_pct").isNotNull()), ["symbol"])
    value = F.col("value")
    mixed = covered.groupBy("portfolio_id").agg(
        F.try_divide(F.sum(value * F.col("usd_pct")), F.sum(value)).alias("usd_pct"),
        F.max(fx_pct).alias("fx_pct"))
    return split_return(mixed, "usd_pct", "fx_pct")
