import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import as_dict, closes, returns, weekdays
from tapeline.operators import backtest as bt, prices as px, rolling


def test_complete_days_drop_a_day_and_returns_span_it(spark):
    table = closes(spark, A=[10, 11, 12, 15], B=[20, None, 30, 33])
    got = {(r.symbol, r.day.day): round(r.r, 6) for r in px.complete_returns(table, ["A", "B"]).collect()}
    assert got == {("A", 3): 0.2, ("A", 4): 0.25, ("B", 3): 0.5, ("B", 4): 0.1}


def test_complete_days_of_a_symbol_without_rows_is_empty_and_is_named(spark):
    table = closes(spark, A=[1, 2])
    assert px.complete_days(table, ["A", "NODATA"]).count() == 0
    wanted = spark.createDataFrame([("A",), ("NODATA",)], "symbol string")
    assert [r.symbol for r in px.missing_symbols(table, wanted).collect()] == ["NODATA"]
    grid = px.gap_grid(table, wanted).where("symbol = 'NODATA'").collect()
    assert len(grid) == 2 and all(r.close is None for r in grid)


def test_history_counts_requested_symbols_without_rows(spark):
    wanted = spark.createDataFrame([("A",), ("NEW",), ("NODATA",)], "symbol string")
    out = px.with_history(closes(spark, A=[1] * 5, NEW=[None, None, None, 1, 1]), 5, wanted)
    assert as_dict(out, "symbol", "days") == {"A": 5, "NEW": 2, "NODATA": 0}
    assert as_dict(out, "symbol", "usable") == {"A": True, "NEW": False, "NODATA": False}


def test_month_move_uses_first_row_when_short_and_needs_two_closes(spark):
    out = px.recent_moves(closes(spark, A=[100, 110, 121], ONE=[5], LONG=[100] + [200] * 21 + [300]))
    rows = {r.symbol: r for r in out.collect()}
    assert set(rows) == {"A", "LONG"}
    assert rows["A"].day_pct == pytest.approx(10) and rows["A"].month_pct == pytest.approx(21)
    assert rows["LONG"].month_pct == pytest.approx(50)    # 21 rows back, not the first


def test_one_per_day_keeps_the_latest(spark):
    df = spark.createDataFrame([("A", 1, 5.0), ("A", 3, 7.0), ("A", 2, 6.0)], "symbol string, ts int, close double")
    out = px.one_per_day(df.withColumn("day", F.lit("2024-01-01").cast("date")))
    assert [r.close for r in out.collect()] == [7.0]


def test_rule_never_earns_the_move_that_triggered_it(spark):
    out = bt.backtest(closes(spark, A=[10] * 9 + [20]), 5, cost=0.0)
    assert sum(r.strategy_r for r in out.collect()) == 0.0


def test_flat_series_is_never_above_its_average(spark):
    out = bt.backtest(closes(spark, A=[10.1] * 60), 50)
    assert not any(r.in_market for r in out.collect())


def test_cost_is_paid_on_each_switch(spark):
    prices = [10, 10, 10, 11, 12, 13, 9, 8, 8]
    out = bt.backtest(closes(spark, A=prices), 3, cost=0.01).orderBy("day").collect()
    held = [r.in_market for r in out]
    assert held == [False, False, False, False, True, True, True, False, False]
    by_hand = 1.0
    for i, h in enumerate(held):
        r = prices[i] / prices[i - 1] - 1 if i else 0.0
        by_hand *= 1 + (r if h else 0.0) - (0.01 if h != (held[i - 1] if i else False) else 0.0)
    board = bt.leaderboard(closes(spark, A=prices), 3, 0.01).first()
    assert board.rule_100 == pytest.approx(100 * by_hand) and board.switches == 2
    assert board.hold_100 == pytest.approx(80)


def test_loss_on_first_day_is_not_a_drawdown(spark):
    path = bt.with_drawdown(bt.growth_path(returns(spark, pd.DataFrame({"A": [-0.5, 0.1, -0.1]}))))
    assert path.agg(F.min("drawdown_pct")).first()[0] == pytest.approx(-10)


def test_sweep_agrees_with_single_backtests(spark):
    rng = np.random.default_rng(3)
    table = closes(spark, A=100 * np.cumprod(1 + rng.normal(0, .02, 120)), B=100 * np.cumprod(1 + rng.normal(0, .01, 120)))
    got = {(r.symbol, r.ma_rows): (r.train_100, r.test_100) for r in bt.sweep(table, [5, 12, 30], 30).collect()}
    for n in (5, 12, 30):
        for row in (bt.train_test(bt.backtest(table, n), 30).groupBy("symbol")
                    .pivot("split", ["train", "test"]).agg(bt.grown(F.col("strategy_r"))).collect()):
            assert got[(row.symbol, n)] == pytest.approx((row.train, row.test))


def test_train_is_the_first_two_thirds_after_the_skip(spark):
    out = bt.train_test(closes(spark, A=range(1, 21)), 5)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {None: 5, "train": 10, "test": 5}


def test_first_best_setting_wins_ties_and_rank_is_averaged(spark):
    swept = spark.createDataFrame([("A", 10, 120.0, 90.0), ("A", 20, 120.0, 110.0), ("A", 30, 100.0, 90.0)],
                                  "symbol string, ma_rows int, train_100 double, test_100 double")
    hold = spark.createDataFrame([("A", 1.0, 100.0)], "symbol string, hold_train_100 double, hold_test_100 double")
    row = bt.best_setting(swept, hold).first()
    assert (row.best_ma_rows, row.test_rank, row.settings_beating_hold, row.settings) == (10, 2, 1, 3)


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 21, 63])
def test_rolling_windows_agree_with_pandas(spark, rows):
    rng = np.random.default_rng(rows)
    x = rng.normal(0.001, 0.02, 100)
    df = returns(spark, pd.DataFrame({"A": x}))
    got = rolling.with_sums(df, "r", {"s": rows}).orderBy("day").toPandas()
    want = pd.Series(x).rolling(rows).sum()
    np.testing.assert_allclose(got["s"].astype(float), want, atol=1e-12)
    if rows > 1:
        got = rolling.with_stddevs(df, "r", {"s": rows, "t": 10}).orderBy("day").toPandas()
        np.testing.assert_allclose(got["s"].astype(float), pd.Series(x).rolling(rows).std(), atol=1e-12)
        np.testing.assert_allclose(got["t"].astype(float), pd.Series(x).rolling(10).std(), atol=1e-12)


def test_rolling_window_with_a_null_is_null_and_constant_has_no_spread(spark):
    days = weekdays(6)
    df = spark.createDataFrame([("A", d, v) for d, v in zip(days, [.01, .01, None, .01, .01, .01])],
                               "symbol string, day date, r double")
    got = [r.s for r in rolling.with_stddevs(df, "r", {"s": 3}).orderBy("day").collect()]
    assert got == [None, None, None, None, None, 0.0]


def test_finished_bars_only_drop_an_open_day(spark):
    table = closes(spark, A=[1, 2, 3])
    assert px.finished_bars(table, True, "2024-01-03").count() == 2
    assert px.finished_bars(table, False, "2024-01-03").count() == 3
    assert px.finished_bars(table, True, "2024-01-04").count() == 3


def test_session_summary_settles_equal_times_by_id(spark):
    trades = spark.createDataFrame([("A", 1, 10.0, 1.0, 1), ("A", 1, 12.0, 2.0, 2), ("A", 0, 8.0, 1.0, 3)],
                                   "symbol string, ts int, price double, size double, trade_id int")
    row = px.session_summary(trades).first()
    assert (row.first_price, row.last_price, row.trades, row.shares) == (8.0, 12.0, 3, 4.0)
    assert row.change_pct == pytest.approx(50) and not math.isnan(row.high)


def test_sweep_makes_no_row_per_day_and_setting(spark):
    rng = np.random.default_rng(5)
    walk = lambda n: [float(x) for x in 100 * np.cumprod(1 + rng.normal(0, .02, n))]     # noqa: E731
    gap, zero = walk(90), walk(90)
    gap[50], zero[60] = None, 0.0
    table = closes(spark, GAP=gap, ZERO=zero, FLAT=[5.0] * 90, ONE=walk(31), SHORT=walk(30), NONE=[None] * 40)
    made = bt.sweep(table, [5, 12, 30], 30)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and plan.count("Exchange") == 1
    got = {(r.symbol, r.ma_rows): (r.train_100, r.test_100) for r in made.collect()}
    want = {}
    for n in (5, 12, 30):
        for row in (bt.train_test(bt.backtest(table, n).withColumn("r", F.coalesce("r", F.lit(0.0))), 30).where("split IS NOT NULL")
                    .withColumn("s", F.when(F.col("in_market"), F.col("r")).otherwise(0.0) - F.when(F.col("switched"), 0.001).otherwise(0.0))
                    .groupBy("symbol").pivot("split", ["train", "test"]).agg(bt.grown(F.col("s"))).collect()):
            want[row.symbol, n] = row.train, row.test
    assert set(got) == set(want) and {s for s, _ in got} == {"GAP", "ZERO", "FLAT", "ONE", "NONE"}
    for k, (train, test) in want.items():
        assert got[k][0] == (None if train is None else pytest.approx(train)) and got[k][1] == pytest.approx(test)
