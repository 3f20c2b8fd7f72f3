import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import as_dict, closes, returns
from tapeline.operators import correlation as co, mixes, ranking, risk, skew


def ewma(r, lam=0.94):
    v, out = r[0] ** 2, []
    for i, x in enumerate(r):
        v = x * x if i == 0 else lam * v + (1 - lam) * x * x
        out.append(np.sqrt(252 * v) * 100)
    return np.array(out)


@pytest.mark.parametrize("lam,n", [(0.94, 300), (0.94, 12_500), (0.5, 1_800)])
def test_ewma_agrees_with_the_recursion_on_any_length(spark, lam, n):
    x = np.random.default_rng(1).normal(0, .02, n)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "day": np.arange(n), "r": x}))
    got = risk.ewma_volatility(df, lam).orderBy("day").toPandas()["ewma"]
    np.testing.assert_allclose(got, ewma(x, lam), rtol=1e-9)


def frame(n=900, seed=5):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"CALM": rng.normal(0, .01, n), "WILD": rng.normal(0, .03, n),
                         "TURN": np.r_[rng.normal(0, .01, n // 2), rng.normal(0, .03, n - n // 2)]})


def test_walk_forward_agrees_with_pandas(spark):
    wide = frame()
    got = {r.method: r for r in risk.evaluate_forecasts(returns(spark, wide)).collect()}
    actual = wide.rolling(21).std().shift(-21) * np.sqrt(252) * 100
    points = wide.index[252:-21:21]
    for name, n in {"last month": 21, "3 months": 63, "1 year": 252}.items():
        made = wide.rolling(n).std() * np.sqrt(252) * 100
        pairs = pd.DataFrame({"f": made.loc[points].stack(), "a": actual.loc[points].stack()}).dropna()
        assert got[name].avg_error_pts == pytest.approx((pairs.f - pairs.a).abs().mean())
        assert got[name].rank_corr == pytest.approx(pairs.f.rank().corr(pairs.a.rank()))
        assert got[name].checks == len(pairs)
    assert got["EWMA"].avg_error_pts < got["1 year"].avg_error_pts    # it adapts to the turn


def test_forecasts_look_only_backwards(spark):
    wide = frame(400)
    changed = wide.copy()
    changed.iloc[300:] *= 5
    def at(w):
        made = risk.volatility_forecasts(returns(spark, w))
        return made.orderBy("symbol", "day").toPandas().groupby("symbol").head(300)
    pd.testing.assert_frame_equal(at(wide), at(changed))


def test_return_persistence_agrees_with_pandas(spark):
    wide = frame(700, 8)
    past = wide.rolling(21).sum()
    future = past.shift(-21)
    points = wide.index[252:-21:21]
    pairs = pd.DataFrame({"p": past.loc[points].stack(), "f": future.loc[points].stack()}).dropna()
    row = risk.return_persistence(returns(spark, wide)).first()
    assert row.rank_corr == pytest.approx(pairs.p.rank().corr(pairs.f.rank())) and row.checks == len(pairs)


def test_top_performers_skip_new_listings_and_fall_back_per_symbol(spark):
    rng = np.random.default_rng(2)
    table = closes(spark, UP=np.linspace(100, 200, 120), NEW=[None] * 110 + list(rng.uniform(9, 11, 10)),
                   SHORT=[None] * 80 + list(rng.uniform(9, 11, 40)))
    rows = {r.symbol: r for r in risk.top_performers(table, 21).collect()}
    assert set(rows) == {"UP", "SHORT"}
    assert rows["UP"].return_pct == pytest.approx((200 / np.linspace(100, 200, 120)[-22] - 1) * 100)
    assert rows["SHORT"].volatility_pct is not None
    assert rows["SHORT"].bad_pct == pytest.approx(-1.65 * rows["SHORT"].typical_pct)


@pytest.mark.parametrize("ranges", [1, 5, None])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_rank_correlation_with_heavy_ties(spark, ranges, by):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": np.where(rng.random(600) < .9, 0, rng.integers(1, 3, 600)), "a": rng.integers(0, 40, 600).astype(float),
                        "b": rng.normal(size=600)})
    pdf.loc[rng.random(600) < .4, "a"] = 7.0       # one value holds a large share
    got = ranking.spearman(spark.createDataFrame(pdf), "a", "b", by, ranges=ranges).collect()
    groups = pdf.groupby("g") if by else [(None, pdf)]
    want = sorted(g.a.rank().corr(g.b.rank()) for _, g in groups)
    assert sorted(r.rank_corr for r in got) == pytest.approx(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
@pytest.mark.parametrize("some", [False, True])
def test_salted_join_is_the_plain_join(spark, how, some):
    big = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 7).alias("k"), "id")
    lookup = spark.createDataFrame([(1, "x"), (3, "y"), (9, "z")], "k long, v string")
    counts = big.groupBy("k").agg(F.count("*").alias("n")) if some else None
    got = skew.salted_join(big, lookup, ["k"], how, counts=counts)
    want = big.join(lookup, "k", how)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_salts_follow_the_share_of_a_key(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"))
    salts = {r.k: r._salts for r in skew.key_salts(big.groupBy("k").agg(F.count("*").alias("n")), ["k"]).collect()}
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert salts == {1: -(-900 * partitions // 1000)}       # one key of nine tenths: cut; the others: not
    lookup = spark.createDataFrame([(1, "x")], "k long, v string")
    spread = skew.salted_join(big.withColumn("i", F.monotonically_increasing_id()), lookup, ["k"])
    assert spread.count() == 900


@pytest.mark.parametrize("block", [2, 256])
def test_blocked_correlations_agree_with_pandas_with_gaps(spark, block):
    rng = np.random.default_rng(6)
    wide = pd.DataFrame(rng.normal(size=(60, 5)), columns=list("EDCBA"))
    wide["B"] = wide["A"] * .9 + wide["B"] * .1
    wide = wide.mask(rng.random(wide.shape) < .2)
    got = {(r.sym_a, r.sym_b): r for r in co.correlation_pairs(returns(spark, wide), block=block).collect()}
    assert len(got) == 10 and all(a < b for a, b in got)
    want = wide.corr()
    for (a, b), r in got.items():
        assert r["corr"] == pytest.approx(want.loc[a, b]) and r.n_days == (wide[a].notna() & wide[b].notna()).sum()
    assert [(r.sym_a, r.sym_b) for r in co.close_pairs(co.correlation_pairs(returns(spark, wide))).collect()] == [("A", "B")]


def test_blocked_correlations_per_portfolio(spark):
    rng = np.random.default_rng(7)
    base = pd.DataFrame(rng.normal(size=(30, 3)), columns=list("ABC"))
    rows = returns(spark, base)
    both = rows.withColumn("portfolio_id", F.lit(1)).unionByName(
        rows.where("symbol <> 'C'").withColumn("portfolio_id", F.lit(2)))
    got = {(r.portfolio_id, r.sym_a, r.sym_b): r["corr"] for r in co.correlation_pairs(both, ["portfolio_id"]).collect()}
    assert set(got) == {(1, "A", "B"), (1, "A", "C"), (1, "B", "C"), (2, "A", "B")}
    assert got[(2, "A", "B")] == pytest.approx(base.A.corr(base.B))


def test_risk_shares_equal_the_matrix_form(spark):
    wide = frame(300)
    w = pd.Series({"CALM": .5, "WILD": .3, "TURN": .2})
    weights = spark.createDataFrame([(1, s, float(x)) for s, x in w.items()], "portfolio_id int, symbol string, weight double")
    got = as_dict(mixes.mix_risk_shares(returns(spark, wide), weights), "symbol", "risk_pct")
    cov = wide[w.index].cov()
    want = w * (cov @ w) / (w @ cov @ w) * 100
    assert got == pytest.approx(want.to_dict()) and sum(got.values()) == pytest.approx(100)


def test_mixes_with_gaps_match_a_plain_reading_in_any_blocks(spark):
    wide = frame(120).mask(np.random.default_rng(3).random((120, 3)) < .2)
    held = {1: {"CALM": .5, "WILD": .3, "TURN": .2}, 2: {"WILD": 1.0}, 3: {"CALM": .4, "NONE": .6}, 4: {"NONE": 1.0}}
    weights = spark.createDataFrame([(p, s, w) for p, m in held.items() for s, w in m.items()], "portfolio_id int, symbol string, weight double")
    want = {}
    for p in (1, 2, 3):
        own = {s: w for s, w in held[p].items() if s != "NONE"}
        part = wide[list(own)].dropna(how="all")
        r = (part * pd.Series(own)).sum(axis=1)
        path = (1 + r).cumprod()
        want[p] = (100 * path.iloc[-1], r.std() * np.sqrt(252) * 100, (path / path.cummax() - 1).min() * 100, len(r))
    for holdings in (1, 2000):
        got = {r.portfolio_id: (r.grown_100, r.volatility_pct, r.biggest_drop_pct, r.days)
               for r in mixes.over_mixes(returns(spark, wide), weights, lambda h, b, d: [(100 * float(np.prod(1 + mixes._daily(h["weight"].to_numpy(), b))),
                                         *mixes._path(mixes._daily(h["weight"].to_numpy(), b))[1:], len(d))],
                                         "grown_100 double, volatility_pct double, biggest_drop_pct double, days bigint", holdings=holdings).collect()}
        assert set(got) == {1, 2, 3}
        for p in want:
            assert got[p] == pytest.approx(want[p])
    assert mixes.evaluate_mixes(returns(spark, wide), weights.limit(0)).count() == 0


def test_no_row_per_holding_and_day_is_shuffled(spark):
    wide = frame(50)
    weights = spark.createDataFrame([(1, "CALM", 1.0)], "portfolio_id int, symbol string, weight double")
    plan = mixes.mix_risk_shares(returns(spark, wide), weights)._jdf.queryExecution().executedPlan().toString()
    assert "portfolio_id#" not in "".join(x for x in plan.splitlines() if "Exchange" in x and "day" in x)
    assert "Window" not in plan


def test_pairs_picked_in_their_tasks_equal_those_of_all_pairs(spark):
    import random
    draw = random.Random(8)
    drawn = [(f"S{s}", f"2024-01-{d:02d}", draw.gauss(0, 1) if s != 5 else 0.0) for s in range(9) for d in range(1, 25) if draw.random() < 0.8]
    drawn += [("S9", day, r) for s, day, r in drawn if s == "S1"]                # a copy: tied with S1 everywhere
    table = spark.createDataFrame(drawn, "symbol string, day string, r double").withColumn("day", F.to_date("day")).cache()
    pairs = co.correlation_pairs(table).cache()
    sectors = spark.createDataFrame([(f"S{s}", s % 3) for s in range(9) if s != 2] + [("S9", None)], "symbol string, sector int")
    def same(a, b):
        place = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
        assert sorted(map(repr, map(place, a.collect()))) == sorted(map(repr, map(place, b.select(a.columns).collect())))
    for block in (3, 256):
        same(co.pairs_above(table, 0.2, block=block), co.close_pairs(pairs, 0.2))
        same(co.extreme_pairs(table, 3, block), co.alike_pairs(pairs, 3))
        known = pairs.where("corr is not null")
        same(co.sector_correlations(table, sectors, block), co.sector_averages(known, sectors.where("sector is not null")))
    assert co.pairs_above(table.limit(0)).count() == 0


def test_a_series_is_sent_once_per_block_and_blocks_are_few(spark, monkeypatch):
    import random
    draw = random.Random(9)
    rows = [(f"S{s:02d}", f"2024-01-{d:02d}", draw.gauss(0, 1)) for s in range(40) for d in range(1, 22) if draw.random() < 0.8]
    table = spark.createDataFrame(rows, "symbol string, day string, r double").withColumn("day", F.to_date("day")).cache()
    found = lambda: {(r.sym_a, r.sym_b): (round(r["corr"], 9), r.n_days) for r in co.correlation_pairs(table, block=2).collect()}
    whole = found()
    assert len(whole) == 40 * 39 // 2
    assert co._dealt(table, [], 2).count() == 40 * 16        # 20 pieces of two series, but 16 blocks
    monkeypatch.setattr(co, "BLOCKS", 3)
    assert co._dealt(table, [], 2).count() == 40 * 3
    assert found() == whole
    monkeypatch.setattr(co, "HELD", len(rows) // 4)          # more values than a task may hold: five blocks
    assert co._dealt(table, [], 2).count() == 40 * 5
    assert found() == whole


def test_top_performers_sort_each_series_once_and_agree_with_pandas(spark):
    rng = np.random.default_rng(8)
    series = {s: list(50 * np.cumprod(1 + rng.normal(0, .01 * (i + 1), 200))) for i, s in enumerate("ABCD")}
    series["B"][40] = None
    series["C"][60] = 0.0
    series["D"] = [None] * 140 + series["D"][140:]
    made = risk.top_performers(closes(spark, **series), 50)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1
    got = {r.symbol: r for r in made.collect()}
    assert set(got) == set("ABCD")
    for s, row in got.items():
        close = pd.Series(series[s], dtype=float).dropna()
        r = close.pct_change().replace([np.inf, -np.inf], np.nan).dropna()
        ewma = np.sqrt((r ** 2).ewm(alpha=.06, adjust=False).mean().iloc[-1])
        assert row.return_pct == pytest.approx((close.iloc[-1] / close.iloc[-51] - 1) * 100)
        assert row.volatility_pct == pytest.approx((ewma if s == "D" else r.iloc[-63:].std()) * np.sqrt(252) * 100)


def gapped(series, days, seed, share=0.8):
    rng = np.random.default_rng(seed)
    wide = pd.DataFrame(rng.normal(size=(days, series)), columns=[f"S{s:03d}" for s in range(series)])
    return wide.mask(rng.random(wide.shape) > share)


def vectors(wide, block_of=lambda at: 0, bi=0, bj=0):
    """Rows as a task of two blocks gets them."""
    rows = [(s, block_of(at), np.flatnonzero(wide[s].notna()).astype(np.int32) + 19_000, wide[s].dropna().to_numpy(), bi, bj)
            for at, s in enumerate(wide)]
    return pd.DataFrame(rows, columns=["symbol", "block", "days", "v", "bi", "bj"])


@pytest.mark.parametrize("all_pairs", [co.correlation_pairs, co.covariance_pairs])
def test_rows_of_all_pairs_come_in_runs_of_their_first_name(spark, all_pairs):
    rows = all_pairs(returns(spark, gapped(60, 30, 11)), block=40).collect()         # two blocks, three products
    assert len(rows) in (60 * 59 // 2, 60 * 61 // 2) and all(r.sym_a <= r.sym_b for r in rows)
    assert sum(a.sym_a != b.sym_a for a, b in zip(rows, rows[1:])) < 4 * 60


def test_bounds_hold_every_correlation_and_spare_most_products():
    wide = gapped(90, 60, 13)
    wide["S001"] = wide["S000"]                                       # alike on all days
    wide["S002"] = 0.1                                                # no variance
    wide["S003"] = wide["S004"] * 1e-9 + 1e6                          # little beside its level
    wide.loc[:1, ["S005", "S006"]] = [[0.3, 0.3], [-0.4, 0.3]]
    wide.loc[2:, "S005"] = np.nan                                     # two days
    wide.loc[1:, "S006"] = np.nan                                     # one day
    wide.loc[5, "S007"], wide.loc[6, "S008"] = 1e30, 1e-300           # one day outweighs all others
    series = vectors(wide)
    whole = next(co._meetings(series, 256, False, co._every))
    calendar = co._Calendar(series["days"].to_list())
    side = co._Side(whole.left, calendar)
    low, high = co._bounds(side, side)
    known = np.isfinite(whole.value)
    assert known.sum() > 6000 and (low[known] <= whole.value[known]).all() and (whole.value[known] <= high[known]).all()
    plain = np.isin(np.arange(90), [2, 3, 5, 6, 7, 8], invert=True)
    assert (high - low)[np.ix_(plain, plain)].max() < 1e-3
    pick, made, got = co._Ends(3), 0, []
    for met in co._meetings(vectors(gapped(90, 60, 14), lambda at: at % 2, 0, 1), 9, False, pick):
        made += met.value.size
        got.append(pick(met))
    want = gapped(90, 60, 14).corr().to_numpy()[::2, 1::2].ravel()
    got = np.sort(pd.concat(got)["corr"])
    np.testing.assert_allclose(np.r_[got[:3], got[-3:]], np.r_[np.sort(want)[:3], np.sort(want)[-3:]])
    assert made < 0.25 * want.size


def test_both_ends_come_from_one_run_over_the_pairs(spark):
    plan = co.extreme_pairs(returns(spark, gapped(6, 20, 15)), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("MapInPandas") == 1


@pytest.mark.parametrize("above", [0.45, 0.0, -0.2])
def test_only_series_that_may_be_over_the_number_are_measured(above):
    wide = gapped(80, 120, 16)
    wide["S003"] = wide["S002"] * 0.9 + wide["S003"].fillna(0) * 0.1
    split = lambda at: at % 2
    pick = co._Above(above)
    mets = list(co._meetings(vectors(wide, split, 0, 1), 10, False, pick))
    got = pd.concat([pick(met) for met in mets]).set_index(["sym_a", "sym_b"])["corr"]
    corr = wide.corr()
    want = {tuple(sorted((a, b))): corr.loc[a, b] for a in wide.columns[::2] for b in wide.columns[1::2] if corr.loc[a, b] > above}
    assert got.to_dict() == pytest.approx(want) and len(got) > 0
    assert sum(met.value.size for met in mets) <= (16 if above > 0.4 else 40 * 40)


def test_sums_of_sectors_make_a_right_side_once_for_four_left_ones(spark, monkeypatch):
    wide, made = gapped(96, 40, 17), []
    matrix = co._Side.matrix
    monkeypatch.setattr(co._Side, "matrix", lambda self, *a: (made.append(id(self)), matrix(self, *a))[1])
    held = [met for met in co._meetings(vectors(wide, lambda at: at % 2, 0, 1), 6, False, co._every)]
    assert len(held) == 8 * 8 and len(set(made)) <= 8 + 2 * 8
    monkeypatch.undo()
    named = {s: "abc"[at % 3] for at, s in enumerate(wide) if at % 7}
    sectors = spark.createDataFrame(list(named.items()), "symbol string, sector string")
    corr, want = wide.corr(), {True: [], False: []}
    for a in named:
        for b in named:
            if a < b:
                want[named[a] == named[b]].append(corr.loc[a, b])
    got = {r.same_sector: (r.mean_corr, r.pairs) for r in co.sector_correlations(returns(spark, wide), sectors, 10).collect()}
    assert got == {same: (pytest.approx(np.mean(found)), len(found)) for same, found in want.items()}
