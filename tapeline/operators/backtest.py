"""Moving-average rule: positions, returns with costs, leaderboards and parameter sweeps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.functions import fixed
from tapeline.operators.prices import daily_returns, row_numbers, so_far, timeline
from tapeline.operators.rolling import window_sums, with_sums


def _next_row(flag: Column) -> Column:
    """A flag decided on one row and acted on at the next; false before the first decision."""
    return F.lag(F.coalesce(flag, F.lit(False)), 1, False).over(timeline())


def moving_average(closes: DataFrame, rows: int, out: str = "average") -> DataFrame:
    """Mean of the last `rows` closes, null until there are that many."""
    return with_sums(closes, "close", {"_sum": rows}).withColumn(out, F.col("_sum") / rows).drop("_sum")


def above(close: Column, average: Column) -> Column:
    """Close over average. A tie within the noise of summation is no."""
    return F.coalesce(close - average > F.abs(average) * 1e-12, F.lit(False))


def grown(returns: Column) -> Column:
    """Aggregate: what 100 becomes."""
    return F.lit(100.0) * F.product(1.0 + returns)


def log_growth(returns: Column) -> Column:
    """Aggregate: natural log of the growth factor, safe for very long series."""
    return F.sum(F.log1p(returns))


def backtest(closes: DataFrame, ma_rows: int, cost: float = fixed.SWITCH_COST,
             drop_warmup: bool = False) -> DataFrame:
    """Daily result of holding while the previous close was above its average.

    Columns added: average, in_market, switched, r, strategy_r. With `drop_warmup` the rows before
    the first average are removed and returns start at the first remaining row.
    """
    rule = moving_average(closes, ma_rows)
    if drop_warmup:
        rule = rule.where(F.col("average").isNotNull())
    rule = rule.withColumn("in_market", _next_row(above(F.col("close"), F.col("average"))))
    rule = daily_returns(rule, first=0.0)
    rule = rule.withColumn(
        "switched", F.col("in_market") != F.lag("in_market", 1, False).over(timeline()))
    return rule.withColumn(
        "strategy_r", F.when(F.col("in_market"), F.col("r")).otherwise(F.lit(0.0))
        - F.when(F.col("switched"), F.lit(float(cost))).otherwise(F.lit(0.0)))


def growth_path(returns: DataFrame, value: str = "r", out: str = "growth",
                keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return returns.withColumn(out, 100.0 * F.product(1.0 + F.col(value)).over(so_far(keys)))


def with_drawdown(path: DataFrame, value: str = "growth", out: str = "drawdown_pct",
                  keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Fall from the highest value so far. The first value is the first peak."""
    peak = F.max(value).over(so_far(keys))
    return path.withColumn(out, F.try_divide(F.col(value) - peak, peak) * 100.0)


def leaderboard(closes: DataFrame, ma_rows: int, cost: float = fixed.SWITCH_COST) -> DataFrame:
    """Rule against buy & hold per symbol: growth, worst drawdown, switches, time held, winner.

    One shuffle on symbol feeds every window and the final aggregate.
    """
    tested = backtest(closes, ma_rows, cost)
    for value, name in (("r", "hold"), ("strategy_r", "rule")):
        tested = growth_path(tested, value, f"_{name}")
        tested = with_drawdown(tested, f"_{name}", f"_{name}_dd")
    board = tested.groupBy("symbol").agg(
        grown(F.col("r")).alias("hold_100"), grown(F.col("strategy_r")).alias("rule_100"),
        F.min("_hold_dd").alias("hold_drop_pct"), F.min("_rule_dd").alias("rule_drop_pct"),
        F.count_if("switched").alias("switches"),
        (F.avg(F.col("in_market").cast("double")) * 100.0).alias("in_market_pct"),
        F.count(F.lit(1)).alias("days"))
    return board.withColumn("winner", F.when(F.col("rule_100") > F.col("hold_100"), "rule")
                            .otherwise("hold"))


def describe(closes: DataFrame) -> DataFrame:
    """Buy & hold of each symbol: what 100 became, return, daily standard deviation and worst drawdown."""
    rows = with_drawdown(growth_path(daily_returns(closes).where(F.col("r").isNotNull())))
    last = F.max_by("growth", "day")
    return rows.groupBy("symbol").agg(
        last.alias("grown_100"), (last - 100.0).alias("return_pct"), (F.stddev_samp("r") * 100.0).alias("daily_std_pct"),
        F.min("drawdown_pct").alias("biggest_drop_pct"), F.count(F.lit(1)).alias("days"))


def cost_effect(closes: DataFrame, ma_rows: int, skip_rows: int = 0,
                cost: float = fixed.SWITCH_COST) -> DataFrame:
    """Growth of the rule with and without the cost of switching, from row `skip_rows` on."""
    tested = row_numbers(backtest(closes, ma_rows, cost)).where(F.col("rn") >= skip_rows)
    free = F.when(F.col("in_market"), F.col("r")).otherwise(F.lit(0.0))
    return tested.groupBy("symbol").agg(grown(free).alias("without_costs"),
                                        grown(F.col("strategy_r")).alias("with_costs"))


def train_test(df: DataFrame, skip_rows: int) -> DataFrame:
    """Label rows: the first two thirds after `skip_rows` train, the rest test, earlier rows null."""
    numbered = row_numbers(df)
    cut = skip_rows + F.floor((F.col("n_rows") - skip_rows) * 2 / 3)
    return (numbered.withColumn("split", F.when(F.col("rn") < skip_rows, None)
                                .when(F.col("rn") < cut, "train").otherwise("test"))
            .drop("rn", "n_rows"))


def sweep(closes: DataFrame, windows: Sequence[int] = fixed.SWEEP_WINDOWS, skip_rows: int = 200,
          cost: float = fixed.SWITCH_COST) -> DataFrame:
    """Growth of every moving-average setting on the train and the test rows of each symbol.

    One shuffle on symbol brings a series together; all settings are columns of one matrix there, so no row per day
    and setting exists. The averages share their partial sums.
    """
    windows = [int(n) for n in windows]
    kind = dict(closes.dtypes)["symbol"]

    def one(series: pa.Table) -> pa.Table:
        close = series.column("close").to_numpy()[np.argsort(series.column("day").to_numpy())]
        train, test = _swept(close, windows, skip_rows, cost)
        names = series.column("symbol").slice(0, 1).combine_chunks()
        return pa.table({"symbol": names.take(pa.array(np.zeros(len(train), np.int64))), "ma_rows": pa.array(windows[:len(train)], pa.int32()),
                         "train_100": pa.array(train, from_pandas=True), "test_100": pa.array(test, from_pandas=True)})

    return closes.select("symbol", "day", F.col("close").cast("double").alias("close")).groupBy("symbol").applyInArrow(
        one, f"symbol {kind}, ma_rows int, train_100 double, test_100 double")


def _swept(close: np.ndarray, windows: Sequence[int], skip_rows: int, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """What 100 becomes by each setting on the train and the test rows of a series in order, as `train_test` has them; nan
    without rows, and nothing if there are neither. A missing close is nan."""
    n = len(close)
    if n <= skip_rows:
        return np.zeros(0), np.zeros(0)
    with np.errstate(all="ignore"):
        r = np.r_[0.0, np.where(close[:-1] == 0, np.nan, close[1:] / close[:-1]) - 1.0]
        r[np.isnan(r)] = 0.0
        # place 1 + i is row i; a rule acts on the row after, and is compared with the one before it
        held = np.zeros((n + 1, len(windows)), bool)
        for i, total in enumerate(window_sums(close, windows)):
            average = total / windows[i]
            held[1:, i] = close - average > np.abs(average) * 1e-12
        held, before = held[:n], np.r_[np.zeros((1, len(windows)), bool), held[:n - 1]]
        factor = 1.0 + (np.where(held, r[:, None], 0.0) - np.where(held != before, float(cost), 0.0))
    cut = skip_rows + (n - skip_rows) * 2 // 3
    made = [100.0 * np.prod(part, axis=0) if len(part) else np.full(len(windows), np.nan) for part in (factor[skip_rows:cut], factor[cut:])]
    return made[0], made[1]


def hold_by_split(closes: DataFrame, skip_rows: int = 200) -> DataFrame:
    """Buy & hold on the same spans: the bar to beat."""
    rows = train_test(daily_returns(closes, first=0.0), skip_rows)
    train, test = F.col("split") == "train", F.col("split") == "test"
    return rows.groupBy("symbol").agg(
        grown(F.when(train, F.col("r"))).alias("hold_train_100"),
        grown(F.when(test, F.col("r"))).alias("hold_test_100"))


def best_setting(swept: DataFrame, hold: DataFrame) -> DataFrame:
    """Setting that looked best on old rows, and its rank on the new ones.

    A symbol has one row per setting, so its windows are as small as the parameter list.
    """

    def level(name: str) -> Column:
        """Log growth without the noise of the order of multiplication, so that equal settings tie."""
        return F.round(F.log(F.col(name) / 100.0), 9)

    levels = swept.withColumns({"_train": level("train_100"), "_test": level("test_100")})
    by_test = Window.partitionBy("symbol").orderBy(F.desc("_test"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("symbol", "_test"))
    ranked = (levels.withColumn("_rank", F.rank().over(by_test) + (ties - 1) / 2.0)
              .join(hold.withColumn("_hold", level("hold_test_100")), "symbol"))
    best = F.max_by(F.struct("ma_rows", "train_100", "test_100", "_rank"),
                    F.struct("_train", -F.col("ma_rows"))).alias("b")
    out = ranked.groupBy("symbol").agg(
        best, F.count_if(F.col("_test") > F.col("_hold")).alias("settings_beating_hold"),
        F.count(F.lit(1)).alias("settings"))
    return out.select("symbol", F.col("b.ma_rows").alias("best_ma_rows"),
                      F.col("b.train_100").alias("best_train_100"),
                      F.col("b.test_100").alias("best_test_100"),
                      F.floor(F.col("b._rank")).alias("test_rank"),
                      "settings_beating_hold", "settings")


def latest_signal(closes: DataFrame, ma_rows: int) -> DataFrame:
    """Rule, last close and average at each symbol's last row; a short history says no."""
    rows = moving_average(closes.where(F.col("close").isNotNull()), ma_rows)
    last = rows.groupBy("symbol").agg(
        F.max_by(F.struct("close", "average"), "day").alias("l"),
        F.count(F.lit(1)).alias("days"))
    return last.select("symbol", "days", F.col("l.close").alias("price"),
                       F.col("l.average").alias("average"),
                       above(F.col("l.close"), F.col("l.average")).alias("own"))
