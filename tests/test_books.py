"""Portfolios on their own complete days against pandas, with gaps, zeros and many blocks."""

import numpy as np
import pandas as pd
import pytest

from helpers import closes, returns
from tapeline.operators import books as bk
from tapeline.plans import health, outlook
from tapeline.sources import reference

NAMES = list("ABCDEFG")


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    wide = pd.DataFrame({s: 50 * np.cumprod(1 + rng.normal(0, .01 + .003 * i, 130)) for i, s in enumerate(NAMES)})
    for s in NAMES[1:]:
        wide.loc[rng.choice(130, 9, replace=False), s] = np.nan
    wide.loc[40, "C"] = 0.0
    wide.loc[:110, "G"] = np.nan
    return wide


@pytest.fixture(scope="module")
def holdings():
    rng = np.random.default_rng(4)
    return [(p, str(s), float(rng.integers(1, 100))) for p in range(40) for s in rng.choice(NAMES, rng.integers(1, 6), replace=False)]


def held(spark, rows):
    return spark.createDataFrame(rows, "portfolio_id int, symbol string, value double")


def known(table):
    return {s: [None if np.isnan(x) else float(x) for x in table[s]] for s in table}


def own_returns(table, names):
    whole = table[sorted(names)].dropna()
    return whole.pct_change().iloc[1:].replace([np.inf, -np.inf], np.nan)


def plain(table, rows, bench):
    """{portfolio: (weights, returns)} on complete days, for symbols of 60 closes and more."""
    usable = [s for s in table if table[s].notna().sum() >= 60]
    out = {}
    for p in {r[0] for r in rows}:
        money = pd.Series({s: v for q, s, v in rows if q == p and s in usable})
        if len(money):
            out[p] = money / money.sum(), own_returns(table, {*money.index, bench})
    return out


@pytest.mark.parametrize("block", [3, 2000])
def test_books_match_pandas(spark, table, holdings, block):
    book = bk.books(closes(spark, **known(table)), held(spark, holdings), 60, ("A",), block=block)
    want = plain(table, holdings, "A")
    risk = {(r.portfolio_id, r.symbol): r for r in book.facts(bk.risk_facts, bk.RISK).collect()}
    lines = {(r.portfolio_id, r.name): r for r in book.facts(
        bk.comparison_facts, "name string, grown_100 double, volatility_pct double, biggest_drop_pct double").collect()}
    pairs = {(r.portfolio_id, r.sym_a, r.sym_b): r for r in book.facts(
        bk.correlation_facts, "sym_a string, sym_b string, corr double, n_days bigint").collect()}
    effective = {r.portfolio_id: r.effective for r in book.facts(bk.effective_facts, "effective double").collect()}
    assert set(risk) == {(p, s) for p, (w, r) in want.items() for s in w.index} and set(lines) == {(p, n) for p in want for n in ("Your mix", "Just A")}
    for p, (w, r) in want.items():
        mix = (r[w.index] * w).sum(axis=1, min_count=1)
        for s in w.index:
            both = pd.concat([r[s], mix], axis=1).dropna()
            assert risk[p, s].risk_pct == pytest.approx(w[s] * both.cov().iloc[0, 1] / both.iloc[:, 1].var() * 100)
            assert risk[p, s].own_volatility_pct == pytest.approx(r[s].std() * np.sqrt(252) * 100)
        path = (1 + mix).cumprod()
        assert lines[p, "Your mix"].grown_100 == pytest.approx(100 * path.iloc[-1])
        if path.min() > 0:
            assert lines[p, "Your mix"].biggest_drop_pct == pytest.approx(((path / path.cummax()) - 1).min() * 100)
        assert lines[p, "Just A"].grown_100 == pytest.approx(100 * (1 + r["A"].dropna()).prod())
        assert effective[p] == pytest.approx(1 / (w ** 2).sum())
        for a in w.index:
            for b in w.index:
                if a < b:
                    assert pairs[p, a, b].corr == pytest.approx(r[a].corr(r[b])) and pairs[p, a, b].n_days == r[[a, b]].dropna().shape[0]
    assert {(r.portfolio_id, r.symbol) for r in book.left_out.collect()} == {(p, s) for p, s, _ in holdings if s == "G"}


def test_outlook_matches_pandas_in_euros(spark, table, holdings):
    rng = np.random.default_rng(5)
    rates = pd.DataFrame({"X": rng.normal(0, .01, 130)})
    rates.loc[7, "X"] = np.nan
    fx = returns(spark, rates).select("day", "r")
    out = outlook.forecast_holdings(closes(spark, **known(table)), held(spark, holdings), min_days=60, fx_returns=fx)
    got, mixes = {(r.portfolio_id, r.symbol): r.volatility_pct for r in out.holdings.collect()}, {r.portfolio_id: r.volatility_pct for r in out.mix.collect()}
    ewma = lambda x: np.sqrt((x.dropna() ** 2).ewm(alpha=.06, adjust=False).mean().iloc[-1] * 252) * 100     # noqa: E731
    usable = [s for s in table if table[s].notna().sum() >= 60]
    for p in {r[0] for r in holdings}:
        money = pd.Series({s: v for q, s, v in holdings if q == p and s in usable})
        if not len(money):
            continue
        r = own_returns(table, money.index)
        r = (1 + r).div(1 + rates["X"].reindex(r.index).fillna(0), axis=0) - 1
        short = any(len(r[s].dropna()) < 63 for s in r)
        for s in r:
            want = ewma(r[s]) if short else r[s].dropna().iloc[-63:].std() * np.sqrt(252) * 100
            assert got[p, s] == pytest.approx(want)
        assert mixes[p] == pytest.approx(ewma((r * (money / money.sum())).sum(axis=1, min_count=1)))


def test_one_day_no_days_and_no_holdings(spark, table):
    df = closes(spark, A=[1, None, 2], B=[None, 1, 3], C=[1, 2, 3])
    book = bk.books(df, held(spark, [(1, "A", 1.0), (1, "B", 1.0), (2, "C", 0.0), (3, "C", 5.0), (4, "GONE", 1.0)]), 1)
    assert {(r.portfolio_id, r.symbol, r.weight) for r in book.facts(bk.risk_facts, bk.RISK).collect()} == {(3, "C", 1.0)}
    assert bk.books(df, held(spark, []), 1).facts(bk.effective_facts, "effective double").count() == 0
    assert bk.books(df, held(spark, [(3, "C", 5.0)]), 1, ("A",)).facts(bk.effective_facts, "effective double").collect() == [(3, 1.0)]
    assert bk.books(df, held(spark, [(3, "C", 5.0)]), 1, ("NONE",)).facts(bk.effective_facts, "effective double").count() == 0


def test_no_rows_of_holdings_and_days_are_exchanged(spark, table, holdings):
    check = health.health_check(closes(spark, **known(table)), held(spark, holdings), reference.sectors(spark), ("A",), 60)
    for made in (check.positions, check.comparison, check.effective, check.correlations):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInPandas" in plan and "Window" not in plan
        assert "day" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(portfolio_id" in x)


def test_portfolios_of_the_same_symbols_are_worked_on_together(table):
    days = np.arange(130)
    arrays = pd.DataFrame([(s, days[table[s].notna()], table[s].dropna().to_numpy(), False) for s in NAMES], columns=["_name", "days", "values", "_fx"])
    rows = pd.DataFrame([(p, s, float(p + i + 1)) for p in range(500) for i, s in enumerate("AB" if p % 2 else "ADE")], columns=["portfolio_id", "symbol", "value"])
    books = list(bk._walk(rows.sample(frac=1, random_state=1), arrays, ("A",)))
    assert sorted("".join(b.symbols) for b in books) == ["AB", "ADE"]
    assert {k for b in books for k in b.keys} == set(range(500))
    for b in books:
        some, mix = b.mix()
        at = int(np.flatnonzero(b.keys == b.keys.max())[0])
        want = own_returns(table, b.symbols) @ (pd.Series(np.arange(len(b.symbols)) + b.keys[at] + 1., b.symbols).pipe(lambda v: v / v.sum()))
        assert some.all() and mix[at] == pytest.approx(want.to_numpy())


def test_rounding_by_arithmetic_is_that_of_decimals(spark):
    from pyspark.sql import functions as F
    from tapeline.catalog import _round, rounded
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(0, 1, 3000) * 10.0 ** rng.integers(-9, 18, 3000), rng.integers(-99, 99, 50) / 8, rng.integers(-9**9, 9**9, 3000) / 1e5, 0.0, -0.0, -1e-9, np.inf, -np.inf]
    df = spark.createDataFrame([(float(v),) for v in x] + [(float("nan"),), (None,)], "x double")
    for places in (2, 6):
        both = df.select(_round(F.col("x") + 0.001 * 10.0 ** -places, places), F.round(F.col("x") + 0.001 * 10.0 ** -places, places)).collect()
        assert [repr(a) for a, _ in both] == [repr(b) for _, b in both]
    assert "FLOOR" in rounded(df)._jdf.queryExecution().executedPlan().toString()


def test_mixes_of_the_same_symbols_are_worked_on_together():
    from tapeline.operators import mixes
    code = np.repeat([0, 1, 2, 3, -1, 5], [2, 1, 2, 1, 2, 2])
    got = sorted((rows.tolist(), at.tolist()) for rows, at in mixes.alike(code, np.array([0, 1, 3, 0, 1, 3, 0, 1, 1, 2])))
    assert got == [([[0, 1], [3, 4]], [0, 1]), ([[2], [5]], [3]), ([[8, 9]], [1, 2])]
    rng = np.random.default_rng(1)
    r = rng.normal(0, .02, (5, 40))
    for i, row in enumerate(r):
        path = np.cumprod(1 + row)
        want = path[-1], row.std(ddof=1) * mixes.ANNUAL, (path / np.maximum.accumulate(path) - 1).min() * 100
        assert [x[i] for x in mixes.paths(r)] == pytest.approx(want)


def test_plans_carry_one_number_per_month_and_match_pandas(spark, table):
    money = [(1, 0, "A", 60.0), (1, 0, "C", 40.0), (1, 0, "FUND", 0.0), (1, 6, "A", 0.0), (1, 6, "C", 70.0), (1, 6, "FUND", 30.0), (1, 3, "A", 9.0),
             (2, 0, "A", 10.0), (2, 0, "C", 90.0), (2, 6, "A", 50.0), (2, 6, "C", 50.0), (3, 0, "FUND", 5.0)]
    plan = spark.createDataFrame(money, "portfolio_id int, month int, symbol string, value double")
    made = outlook.plan_risk(closes(spark, **known(table)), plan, [0, 6], 60)
    got = {(r.portfolio_id, r.month): r for r in made.collect()}
    assert set(got) == {(1, 0), (1, 6), (2, 0), (2, 6)}
    r = own_returns(table, ["A", "C"])
    for (p, m), row in got.items():
        w = pd.Series({s: v for q, k, s, v in money if (q, k) == (p, m) and s != "FUND" and v > 0})
        mine = r[w.index].dropna(how="all")
        mix = (mine * w).sum(axis=1) / (mine.notna() * w).sum(axis=1)
        path = (1 + mix).cumprod()
        assert row.days == len(mix) and row.grown_100 == pytest.approx(100 * path.iloc[-1])
        assert row.volatility_pct == pytest.approx(mix.std() * np.sqrt(252) * 100)
        if path.min() > 0:
            assert row.biggest_drop_pct == pytest.approx((path / path.cummax() - 1).min() * 100)


def test_portfolios_of_one_plan_are_worked_on_together():
    members = pd.DataFrame({"symbol": list("ABAB"), "_plan0": [1.0, 3.0, 2.0, np.nan]})
    book = bk.Book(np.array([1, 2]), np.array(["A", "B"]), np.ones((2, 2)), np.ones((2, 2)) / 2, np.zeros(2, bool), members,
                   np.array([[0, 1], [2, 3]]), np.arange(3), np.array([[.1, .2, .3], [.0, np.nan, .1]]), None)
    rows = {int(i): (g, int(d)) for at, _, grown, _, _, days in bk.plan_facts([0])(book) for i, g, d in zip(at, grown, days)}
    assert rows == {0: (pytest.approx(100 * 1.025 * 1.2 * 1.15), 3), 1: (pytest.approx(100 * 1.1 * 1.2 * 1.3), 3)}


def test_all_months_of_alike_mixes_are_one_product(monkeypatch):
    """Months with the same holdings cost one walk over the days, not one each."""
    rng, months = np.random.default_rng(8), [0, 3, 6, 9, 12]
    members = pd.DataFrame({"symbol": list("AB") * 3} | {f"_plan{i}": rng.uniform(1, 9, 6) for i in range(5)})
    book = bk.Book(np.arange(3), np.array(["A", "B"]), np.ones((3, 2)), np.ones((3, 2)) / 2, np.zeros(2, bool), members,
                   np.arange(6).reshape(3, 2), np.arange(7), rng.normal(0, .1, (2, 7)), None)
    sizes, paths = [], bk.paths
    monkeypatch.setattr(bk, "paths", lambda r: sizes.append(len(r)) or paths(r))
    got = {(int(i), int(m)): g for at, month, grown, *_ in bk.plan_facts(months)(book) for i, m, g in zip(at, month, grown)}
    assert sizes == [15] and len(got) == 15
    for (i, m), grown in got.items():
        w = members[f"_plan{months.index(m)}"].to_numpy()[2 * i:2 * i + 2]
        assert grown == pytest.approx(100 * np.prod(1 + w @ book.r / w.sum()))


def test_many_blocks_of_few_symbols_grow(spark, table, holdings):
    many = spark.createDataFrame([(p + 40 * k, s, v) for k in range(12) for p, s, v in holdings], "portfolio_id int, symbol string, value double")
    prices = closes(spark, **known(table))
    rows = [bk.books(prices, many, 10, block=8, crowded=c) for c in (1, 10)]
    blocks = [b.members.agg({"_block": "max"}).first()[0] + 1 if "_block" in b.members.columns else 0 for b in rows]
    total = rows[0].members.count()
    assert total > 8 * bk.MANY // 2 and blocks[1] <= min(bk.MANY, blocks[0])
    risk = [sorted(map(tuple, b.facts(bk.effective_facts, "effective double").collect())) for b in rows]
    assert len(risk[0]) and [x[0] for x in risk[0]] == [x[0] for x in risk[1]]
    assert [x[1] for x in risk[0]] == pytest.approx([x[1] for x in risk[1]])
