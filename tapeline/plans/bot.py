"""Paper bot: rule, holdings and cash of every account to a list of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeline.operators.backtest import latest_signal
from tapeline.operators.planning import pending_flag, purchase_plan
from tapeline.operators.skew import salted_join


def decide_all(closes: DataFrame, watchlist: DataFrame, positions: DataFrame, cash: DataFrame,
               open_orders: DataFrame, ma_rows: int = 50, budget: float = 1000.0) -> DataFrame:
    """`watchlist(portfolio_id, pos, symbol)`, `positions(portfolio_id, symbol, qty)`."""
    signals = latest_signal(closes, ma_rows)
    rows = (salted_join(watchlist, signals, ["symbol"], "left")
            .join(positions.select("portfolio_id", "symbol", F.col("qty").cast("bigint").alias("held")),
                  ["portfolio_id", "symbol"], "left")
            .na.fill(0, ["days", "held"])
            .withColumn("own", F.coalesce("own", F.lit(False))))
    return purchase_plan(pending_flag(rows, open_orders), cash, budget, ma_rows)
