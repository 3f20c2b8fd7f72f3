"""Cash dividends: last year's payments, yield, income and the next ex-date."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeline.operators.prices import timeline
from tapeline.operators.skew import salted_join


def dividend_facts(dividends: DataFrame, today: str) -> DataFrame:
    """Per symbol: payments and money per share in (today - 365, today], and the next ex-date.

    The estimate steps from the last payment in whole median gaps until it is after today; with g
    days per step that is last + g * (floor((today - last) / g) + 1). A gap under a day has none.
    """
    day = F.to_date(F.lit(today))
    ex = F.col("ex_date")
    own = dividends.where(~F.col("special")).withColumn(
        "_gap", F.datediff(ex, F.lag("ex_date").over(timeline(order="ex_date"))))
    past = (ex <= day) & (ex > F.date_sub(day, 365))
    facts = own.groupBy("symbol").agg(
        F.count_if(past).alias("payments_12m"),
        F.coalesce(F.sum(F.when(past, F.col("rate"))), F.lit(0.0)).alias("per_share_12m"),
        F.min(F.when(ex > day, ex)).alias("_announced"), F.max("ex_date").alias("_last"),
        F.count(F.lit(1)).alias("_n"), F.floor(F.median("_gap")).cast("int").alias("_g"))
    steps = F.greatest(F.lit(1), F.floor(F.datediff(day, F.col("_last")) / F.col("_g")) + 1)
    estimate = F.when((F.col("_n") >= 2) & (F.col("_g") >= 1),
                      F.date_add("_last", (F.col("_g") * steps).cast("int")))
    return facts.select(
        "symbol", "payments_12m", "per_share_12m",
        F.coalesce("_announced", estimate).alias("next_date"),
        F.when(F.col("_announced").isNotNull(), "announced").when(estimate.isNotNull(), "estimate")
        .otherwise("-").alias("next_is"))


def summarise(dividends: DataFrame, prices: DataFrame, holdings: DataFrame, today: str) -> DataFrame:
    """One row per holding. A missing (or zero) price leaves the yield unknown unless nothing was paid."""
    facts = dividend_facts(dividends, today)
    both = facts.join(prices.select("symbol", "price"), "symbol", "full")         # one row per symbol on either side
    rows = (salted_join(holdings.select("portfolio_id", "symbol", "value"), both, ["symbol"], "left")
            .withColumn("payments_12m", F.coalesce("payments_12m", F.lit(0)))
            .withColumn("per_share_12m", F.coalesce("per_share_12m", F.lit(0.0)))
            .withColumn("next_is", F.coalesce("next_is", F.lit("-"))))
    paid, price = F.col("per_share_12m"), F.col("price")
    known = price.isNotNull() & (price != 0)
    yield_pct = F.when(known, F.try_divide(paid, price) * 100.0).when(paid == 0, F.lit(0.0))
    return (rows.withColumn("yield_pct", yield_pct)
            .withColumn("income_year", F.col("value") * F.col("yield_pct") / 100.0).drop("price"))


def income_totals(summary: DataFrame) -> DataFrame:
    """Unknown yields are left out of the income."""
    return summary.groupBy("portfolio_id").agg(
        F.coalesce(F.sum("income_year"), F.lit(0.0)).alias("income_year"),
        F.count_if(F.col("income_year") > 0).alias("payers"),
        F.sum("value").alias("value"),
        (F.try_divide(F.coalesce(F.sum("income_year"), F.lit(0.0)), F.sum("value")) * 100.0)
        .alias("portfolio_yield_pct"))


def upcoming(summary: DataFrame, today: str, days: int = 183) -> DataFrame:
    return summary.where(F.col("next_date") <= F.date_add(F.to_date(F.lit(today)), days))


def next_payment(summary: DataFrame) -> DataFrame:
    """The earliest coming ex-date of each portfolio; the symbol settles ties."""
    first = F.min_by(F.struct("symbol", "next_date", "next_is"), F.struct("next_date", "symbol"))
    return (summary.where(F.col("next_date").isNotNull()).groupBy("portfolio_id")
            .agg(first.alias("n")).select("portfolio_id", "n.*"))
