"""Portfolio day moves and rule alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapeline.functions.finance import pct
from tapeline.operators.portfolio import _share, holders, with_sector, P
from tapeline.operators.skew import salted_join


def holdings_moves(holdings: DataFrame, recent: DataFrame) -> DataFrame:
    """Each holding with its latest moves and its share of the money; no data leaves nulls."""
    shared = holdings.withColumn("share_pct", _share("value", P) * 100.0)
    return salted_join(shared, recent.select("symbol", "close", "day_pct", "month_pct"), ["symbol"], "left",
                       counts=holders(holdings))


def portfolio_day(moved: DataFrame) -> DataFrame:
    """Day move of the whole portfolio over the holdings that have one, and how many have none."""
    share, move = F.col("share_pct"), F.col("day_pct")
    return moved.groupBy("portfolio_id").agg(
        F.try_divide(F.sum(move * share), F.sum(F.when(move.isNotNull(), share))).alias("day_pct"),
        F.count_if(move.isNull()).alias("missing"))


def check_rules(moved: DataFrame, sectors: DataFrame, funds: DataFrame,
                max_single_pct: float | None = None, max_sector_pct: float | None = None,
                daily_move_pct: float | None = None) -> DataFrame:
    """Broken rules, strictly above each limit. Funds are exempt from the first two; a rule without
    a limit is off. One pass lists all candidate facts, a second fold adds the sectors."""
    flagged = with_sector(moved, sectors).join(
        funds.select("symbol", F.lit(True).alias("_fund")), "symbol", "left")
    stock = F.col("_fund").isNull()
    def limit(v):
        return F.lit(v).cast("double")
    single = F.struct(F.lit("single stock").alias("rule"), F.col("symbol").alias("subject"),
                      F.col("share_pct").alias("value"), limit(max_single_pct).alias("limit"),
                      (stock & (F.col("share_pct") > limit(max_single_pct))).alias("broken"))
    daily = F.struct(F.lit("daily move").alias("rule"), F.col("symbol").alias("subject"),
                     F.col("day_pct").alias("value"), limit(daily_move_pct).alias("limit"),
                     (F.abs("day_pct") > limit(daily_move_pct)).alias("broken"))
    facts = (flagged.select("portfolio_id", F.explode(F.array(single, daily)).alias("a"))
             .select("portfolio_id", "a.*").where(F.col("broken")).drop("broken"))
    by_sector = (flagged.where(stock).groupBy("portfolio_id", "sector")
                 .agg(F.sum("share_pct").alias("value")))
    sector = by_sector.where(F.col("value") > limit(max_sector_pct)).select(
        "portfolio_id", F.lit("sector").alias("rule"), F.col("sector").alias("subject"), "value",
        limit(max_sector_pct).alias("limit"))
    return facts.unionByName(sector)


def account_changes(equity: DataFrame) -> DataFrame:
    """Change over the last step and over the whole period. `equity(portfolio_id, ts, equity)`."""

    newest = Window.partitionBy("portfolio_id").orderBy(F.desc("ts"))
    last_two = equity.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= 2)
    day = last_two.groupBy("portfolio_id").agg(
        F.max(F.when(F.col("_k") == 1, F.col("equity"))).alias("equity"),
        F.max(F.when(F.col("_k") == 2, F.col("equity"))).alias("_before"))
    start = equity.groupBy("portfolio_id").agg(F.min_by("equity", "ts").alias("_first"))
    return day.join(start, "portfolio_id").select(
        "portfolio_id", "equity",
        pct(F.try_divide(F.col("equity"), F.col("_before")) - 1.0).alias("day_pct"),
        pct(F.try_divide(F.col("equity"), F.col("_first")) - 1.0).alias("period_pct"))
