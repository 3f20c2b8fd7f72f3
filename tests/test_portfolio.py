import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import as_dict, closes, returns, weekdays
from tapeline.functions import finance as fin
from tapeline.operators import alerts, currency as cur, dividends as dv, mixes, planning as pl, portfolio as pf
from tapeline.plans import bot, health, outlook
from tapeline.sources import reference

HELD = "portfolio_id int, symbol string, value double"


def held(spark, *rows):
    return spark.createDataFrame([(p, s, float(x)) for p, s, x in rows], HELD)


def test_normalise_drops_zeros_and_names_empty_portfolios(spark):
    w = held(spark, (1, "A", 30), (1, "B", 10), (1, "C", 0), (2, "A", 0)).withColumnRenamed("value", "weight")
    assert as_dict(pf.normalise(w), "symbol", "weight") == {"A": 0.75, "B": 0.25}
    assert [r.portfolio_id for r in pf.without_positive_weight(w).collect()] == [2]


def test_years_start_again_at_100(spark):
    days = pd.bdate_range("2024-01-01", "2025-12-31")
    rows = [("A", d.date(), 0.001) for d in days]
    df = spark.createDataFrame(rows, "symbol string, day date, r double")
    w = spark.createDataFrame([(1, "A", 1.0)], "portfolio_id int, symbol string, weight double")
    got = {r.year: r for r in mixes.yearly_mixes(df, w).collect()}
    for year in (2024, 2025):
        n = int((days.year == year).sum())
        assert got[year].days == n and got[year].return_pct == pytest.approx((1.001 ** n - 1) * 100)
        assert got[year].volatility_pct == pytest.approx(0, abs=1e-6)


def test_effective_holdings(spark):
    w = spark.createDataFrame([(1, s, .25) for s in "ABCD"] + [(2, "A", .97), (2, "B", .01), (2, "C", .01), (2, "D", .01)],
                              "portfolio_id int, symbol string, weight double")
    got = as_dict(pf.effective_holdings(w), "portfolio_id", "effective")
    assert got[1] == pytest.approx(4) and got[2] == pytest.approx(1.0624, abs=1e-3)


def price_table(spark, n=260):
    rng = np.random.default_rng(9)
    walk = lambda s: list(100 * np.cumprod(1 + rng.normal(0, s, n)))
    a, b, fund = walk(.01), walk(.02), walk(.008)
    b[100] = None
    return dict(A=a, B=b, FUND=fund, NEW=[None] * (n - 30) + walk(.01)[:30]), n


def test_health_check_agrees_with_pandas(spark):
    series, n = price_table(spark)
    check = health.health_check(closes(spark, **series), held(spark, (1, "A", 300), (1, "B", 100), (1, "NEW", 50), (1, "GONE", 5)),
                                reference.sectors(spark, {"Tech": ("A",)}), ("FUND",), 200)
    assert {r.symbol for r in check.excluded.collect()} == {"NEW", "GONE"}
    wide = pd.DataFrame({s: series[s] for s in ("A", "B", "FUND")}).astype(float).dropna().pct_change().dropna()
    w = pd.Series({"A": .75, "B": .25})
    mix = wide[["A", "B"]] @ w
    rows = {r.symbol: r for r in check.positions.collect()}
    cov = wide[["A", "B"]].cov()
    want = w * (cov @ w) / (w @ cov @ w) * 100
    for s in "AB":
        assert rows[s].risk_pct == pytest.approx(want[s]) and rows[s].money_pct == pytest.approx(w[s] * 100)
        assert rows[s].own_volatility_pct == pytest.approx(wide[s].std() * np.sqrt(252) * 100)
    assert (rows["A"].sector, rows["B"].sector) == ("Tech", "Other")
    comparison = {r.name: r for r in check.comparison.collect()}
    value = 100 * (1 + mix).cumprod()
    assert comparison["Your mix"].grown_100 == pytest.approx(value.iloc[-1])
    assert comparison["Your mix"].biggest_drop_pct == pytest.approx(((value - value.cummax()) / value.cummax()).min() * 100)
    assert comparison["Just FUND"].grown_100 == pytest.approx(100 * (1 + wide.FUND).prod())
    assert check.correlations.first()["corr"] == pytest.approx(wide.A.corr(wide.B))
    assert check.totals.first().invested == 455      # every holding counts as invested


def test_health_check_refuses_a_benchmark_without_history(spark):
    series, _ = price_table(spark)
    with pytest.raises(ValueError, match="NEW"):
        health.health_check(closes(spark, **series), held(spark, (1, "A", 1)), reference.sectors(spark), ("NEW",), 200)


def test_outlook_falls_back_for_the_whole_portfolio(spark):
    series, n = price_table(spark)
    short = {s: v[-50:] for s, v in series.items() if s in ("A", "FUND")}
    out = outlook.forecast_holdings(closes(spark, **short), held(spark, (1, "A", 60), (1, "FUND", 40)), min_days=30)
    wide = pd.DataFrame(short).astype(float).pct_change().dropna()
    ew = lambda s: np.sqrt((s ** 2).ewm(alpha=.06, adjust=False).mean().iloc[-1] * 252) * 100
    assert as_dict(out.holdings, "symbol", "volatility_pct") == pytest.approx({s: ew(wide[s]) for s in wide})
    assert out.mix.first().volatility_pct == pytest.approx(ew(wide @ pd.Series({"A": .6, "FUND": .4})))


def test_swap_moves_or_adds_and_never_removes_more(spark):
    w = spark.createDataFrame([(1, "OUT", .4), (1, "X", .6), (2, "X", 1.0)], "portfolio_id int, symbol string, weight double")
    got = {(r.portfolio_id, r.symbol): r.weight for r in pf.swap(w, "OUT", "IN", .2).collect()}
    assert got == {(1, "X"): .6, (1, "IN"): .4, (2, "X"): 1.0, (2, "IN"): .2}


def test_transition_plan_keeps_the_total_and_sells_evenly(spark):
    h = held(spark, (1, "A", 600), (1, "KEEP", 100), (1, "F", 1000))
    split = spark.createDataFrame([(1, "F", 60.0), (1, "NEWF", 40.0)], "portfolio_id int, symbol string, weight double")
    plan = pl.transition_plan(h, split, reference.funds(spark, ("F", "NEWF")), 6, ["KEEP"])
    rows = {(r.month, r.symbol): r.value for r in plan.collect()}
    for m in range(7):
        assert sum(v for (k, _), v in rows.items() if k == m) == pytest.approx(1700)
        assert rows[(m, "A")] == pytest.approx(600 - 100 * m) and rows[(m, "KEEP")] == 100
        assert rows[(m, "NEWF")] == pytest.approx(40 * m)
    orders = as_dict(pl.monthly_orders(plan), "symbol", "change")
    assert orders == {"A": -100.0, "F": 60.0, "NEWF": 40.0}
    fees = {r.steps: (r.orders, r.fees) for r in pl.order_fees(h, pl.monthly_orders(plan), [1, 4], 2.0).collect()}
    assert fees == {1: (3, 6.0), 4: (12, 24.0)}
    assert pl.plan_checkpoints(6) == [0, 1, 3, 4, 6]


def test_rebalance_sells_all_resizes_buys_and_skips_tiny(spark):
    now = held(spark, (1, "GONE", 50), (1, "LESS", 100), (1, "SAME", 10), (1, "TINY", 10))
    goal = held(spark, (1, "LESS", 60), (1, "SAME", 10), (1, "TINY", 10.5), (1, "NEW", 70))
    got = {r.symbol: (r.change, r.side) for r in pl.rebalance_orders(now, goal).collect()}
    assert got == {"GONE": (-50.0, "SELL ALL"), "LESS": (-40.0, "SELL"), "NEW": (70.0, "BUY")}


def test_mirror_labels(spark):
    real = held(spark, (1, "S", 100), (1, "M", 100), (1, "L", 100), (1, "NONE", 20), (1, "CANT", 5))
    paper = held(spark, (1, "S", 104.9), (1, "M", 110), (1, "L", 90), (1, "X", 5))
    cant = spark.createDataFrame([(1, "CANT")], "portfolio_id int, symbol string")
    status = pl.mirror_status(paper, real, 5.0, cant)
    assert as_dict(status, "symbol", "status") == {"S": "in sync", "M": "too much", "L": "too little", "NONE": "too little",
                                                   "X": "extra", "CANT": "can't mirror"}
    row = pl.mirror_summary(status).first()
    assert (row.in_sync, row.mirrorable, row.extra) == (1, 4, 1)


@pytest.mark.parametrize("own,shares,pending,action,simple", [
    (True, 0, False, "BUY", "BUY"), (True, 3, False, "HOLD", "HOLD"), (False, 3, False, "SELL", "SELL"),
    (False, 0, False, "STAY OUT", "HOLD"), (True, 0, True, "WAIT", "WAIT"), (False, 3, True, "WAIT", "WAIT")])
def test_decision_table(spark, own, shares, pending, action, simple):
    row = spark.range(1).select(
        fin.decision(F.lit(own), F.lit(shares), F.lit(pending)).alias("a"),
        fin.simple_decision(F.lit(own), F.lit(shares), F.lit(pending)).alias("b")).first()
    assert (row.a, row.b) == (action, simple)


def test_whole_shares(spark):
    df = spark.createDataFrame([(1000.0, 300.0), (1000.0, 1001.0), (1000.0, 0.0)], "b double, p double")
    assert [r[0] for r in df.select(fin.whole_shares(F.col("b"), F.col("p"))).collect()] == [3, 0, 0]


def test_purchases_skip_what_does_not_fit_and_go_on(spark):
    rise, fall = [10.0] * 5 + [400.0], [10.0] * 5 + [5.0]
    table = closes(spark, BIG=rise, MID=[10.0] * 5 + [300.0], SMALL=[10.0] * 5 + [90.0], DOWN=fall, DEAR=[10.0] * 5 + [600.0],
                   NEW=[None] * 4 + [1.0, 2.0])
    order = ["BIG", "MID", "SMALL", "DOWN", "DEAR", "NEW", "NODATA"]
    watch = spark.createDataFrame([(1, i, s) for i, s in enumerate(order)], "portfolio_id int, pos long, symbol string")
    positions = spark.createDataFrame([(1, "DOWN", 7)], "portfolio_id int, symbol string, qty int")
    cash = spark.createDataFrame([(1, 860.0)], "portfolio_id int, cash double")
    none = spark.createDataFrame([], "portfolio_id int, symbol string")
    got = {r.symbol: (r.action, r.shares, r.note) for r in bot.decide_all(table, watch, positions, cash, none, 5, 500.0).collect()}
    assert got["BIG"] == ("BUY", 1, "")                      # 400 spent, 460 left
    assert got["MID"] == ("BUY", 1, "")                      # 300 spent, 160 left
    assert got["SMALL"] == ("SKIPPED", 0, "not enough cash")  # 5 shares cost 450
    assert got["DOWN"] == ("SELL", 7, "")
    assert got["DEAR"] == ("SKIPPED", 0, "one share costs more than the budget")
    assert got["NEW"] == got["NODATA"] == ("SKIPPED", 0, "not enough price history")


def test_euro_prices_keep_leading_gaps_and_returns_do_not(spark):
    table = closes(spark, A=[100, 110, 121])
    days = weekdays(3)
    rates = spark.createDataFrame([(days[1], 1.1)], "day date, rate double")
    got = [r.close_eur for r in cur.to_euro_prices(table, rates).orderBy("day").collect()]
    assert got[0] is None and got[1:] == pytest.approx([100, 110])
    fx = spark.createDataFrame([(days[1], 0.05)], "day date, r double")
    rows = returns(spark, pd.DataFrame({"A": [.1, .1]}))
    got = [r.r_eur for r in cur.to_euro_returns(rows, fx).orderBy("day").collect()]
    assert got == pytest.approx([.1, 1.1 / 1.05 - 1])


def test_currency_part(spark):
    row = cur.split_return(spark.createDataFrame([(10.0, 5.0)], "u double, e double"), "u", "e").first()
    assert row.total_eur_pct == pytest.approx(4.7619, abs=1e-4) and row.currency_pct == pytest.approx(-5.2381, abs=1e-4)


def test_dividend_summary(spark):
    import datetime as dt
    d = lambda s: dt.date.fromisoformat(s)
    paid = [("Q", d(x), .5, False) for x in ("2024-02-01", "2024-05-02", "2024-08-01", "2024-10-31", "2025-01-30")]
    paid += [("Q", d("2024-12-12"), 9.0, True), ("ANN", d("2025-01-10"), 1.0, False), ("ANN", d("2025-03-20"), 1.0, False),
             ("OLD", d("2023-01-01"), 1.0, False), ("OLD", d("2023-02-01"), 1.0, False), ("NOPRICE", d("2025-01-01"), 1.0, False)]
    divs = spark.createDataFrame(paid, "symbol string, ex_date date, rate double, special boolean")
    prices = spark.createDataFrame([("Q", 50.0), ("ANN", 20.0), ("OLD", 10.0), ("NEVER", 5.0)], "symbol string, price double")
    got = {r.symbol: r for r in dv.summarise(divs, prices, held(spark, *[(1, s, 100) for s in ("Q", "ANN", "OLD", "NOPRICE", "NEVER")]),
                                             "2025-02-10").collect()}
    assert (got["Q"].payments_12m, got["Q"].per_share_12m) == (4, 2.0)
    assert got["Q"].yield_pct == pytest.approx(4) and got["Q"].income_year == pytest.approx(4)
    assert (got["Q"].next_date, got["Q"].next_is) == (d("2025-05-01"), "estimate")
    assert (got["ANN"].next_date, got["ANN"].next_is) == (d("2025-03-20"), "announced")
    last = d("2023-02-01")
    while last <= d("2025-02-10"):
        last += dt.timedelta(31)
    assert got["OLD"].next_date == last and got["OLD"].yield_pct == 0.0
    assert got["NOPRICE"].yield_pct is None and got["NOPRICE"].next_is == "-"
    assert got["NEVER"].yield_pct == 0.0 and got["NEVER"].next_date is None
    total = dv.income_totals(dv.summarise(divs, prices, held(spark, (1, "Q", 100), (1, "NOPRICE", 100)), "2025-02-10")).first()
    assert total.income_year == pytest.approx(4) and total.payers == 1 and total.portfolio_yield_pct == pytest.approx(2)


def test_rules_are_strict_exempt_funds_and_can_be_off(spark):
    h = spark.createDataFrame([(1, "A", "a", 30.0), (1, "B", "b", 30.0), (1, "F", "f", 40.0)],
                              "portfolio_id int, symbol string, name string, value double")
    recent = spark.createDataFrame([("A", 1.0, -6.0, 0.0), ("F", 1.0, 1.0, 0.0)],
                                   "symbol string, close double, day_pct double, month_pct double")
    moved = alerts.holdings_moves(h, recent)
    sectors, funds = reference.sectors(spark, {"T": ("A", "B")}), reference.funds(spark, ("F",))
    fired = lambda **k: {(r.rule, r.subject) for r in alerts.check_rules(moved, sectors, funds, **k).collect()}
    assert fired(max_single_pct=30.0, max_sector_pct=60.0, daily_move_pct=6.0) == set()
    assert fired(max_single_pct=29.0) == {("single stock", "A"), ("single stock", "B")}
    assert fired(max_sector_pct=59.0, daily_move_pct=5.0) == {("sector", "T"), ("daily move", "A")}
    day = alerts.portfolio_day(moved).first()
    assert day.day_pct == pytest.approx((-6 * 30 + 1 * 40) / 70) and day.missing == 1


def test_a_symbol_that_nine_of_ten_portfolios_hold_is_spread(spark):
    rows = [(p, "HOT" if p % 10 else "COLD", 1.0) for p in range(400)]
    held_by_many = spark.createDataFrame(rows, "portfolio_id long, symbol string, value double")
    recent = spark.createDataFrame([("HOT", 5.0, 1.0, 2.0)], "symbol string, close double, day_pct double, month_pct double")
    out = alerts.holdings_moves(held_by_many, recent)
    assert out.where("day_pct = 1.0").count() == 360 and out.count() == 400
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_a_long_watchlist_is_walked_once_across_batches(spark):
    names = 20_000
    rng = np.random.default_rng(3)
    price = rng.integers(1, 90, names).astype(float)
    rows = [(a, i, f"s{i}", 9, True, float(price[i]), 1.0, 0, False) for a in (1, 2, 3) for i in range(names)]
    rng.shuffle(rows)
    rows = [(int(a), int(i), s, int(d), bool(o), float(x), float(m), int(h), bool(w)) for a, i, s, d, o, x, m, h, w in rows]
    df = spark.createDataFrame(rows, "portfolio_id int, pos bigint, symbol string, days int, own boolean, price double, average double, held bigint, pending boolean")
    cash = spark.createDataFrame([(1, 50_000.0), (2, 250.0)], "portfolio_id int, cash double")
    got = {(r.portfolio_id, r.pos): r.action for r in pl.purchase_plan(df, cash, 100.0, 5).select("portfolio_id", "pos", "action").collect()}
    want = {}
    for account, left in ((1, 50_000.0), (2, 250.0), (3, None)):
        for i in range(names):
            cost = 100.0 // price[i] * price[i]
            buy = left is not None and cost <= left
            left = left - cost if buy else left
            want[account, i] = "BUY" if buy else "SKIPPED"
    assert got == want and list(want.values()).count("BUY") > 500


def test_mixes_name_holdings_without_returns(spark):
    r = spark.createDataFrame([("A", weekdays(1)[0], 0.1)], "symbol string, day date, r double")
    w = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5)], "portfolio_id int, symbol string, weight double")
    with pytest.raises(ValueError, match="B"):
        mixes.evaluate_mixes(r, w, strict=True)
    assert mixes.evaluate_mixes(r, w.where("symbol = 'A'"), strict=True).count() == 1
