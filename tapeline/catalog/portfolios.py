"""Portfolio, planning, currency and dividend queries. Every customer is a portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.catalog import query, r, rounded
from tapeline.catalog import views as v
from tapeline.catalog.market import (D, complete_sql, ewma_sql, full_sql, path_steps, returns_sql)
from tapeline.catalog.views import with_views
from tapeline.functions import finance as fin
from tapeline.operators import (alerts, currency as cur, dividends as dv, planning as pl,
                                mixes, portfolio as pf, prices as px)
from tapeline.operators.ranking import numbered
from tapeline.plans import bot, health, outlook
from tapeline.session import cut_lineage
from tapeline.sources import accounts, market, reference

AS_OF = "2001-08-01"
START = "2000-08-01"
FUND = "5-LOW"              # the symbol that stands in for a fund and a benchmark
SECTORS = {"Urgent": ("1-URGENT", "2-HIGH"), "Calm": ("3-MEDIUM",)}
SECTOR_SQL = """SELECT * FROM (VALUES ('1-URGENT', 'Urgent'), ('2-HIGH', 'Urgent'), ('3-MEDIUM', 'Calm'))
    AS t(symbol, sector)"""


def year_closes(spark, sf):
    return v.order_closes(spark, sf).where(F.col("day") >= F.to_date(F.lit(START)))


YEAR = f"SELECT * FROM order_closes WHERE day >= DATE '{START}'"
WEIGHTS = "SELECT portfolio_id, symbol, value / sum(value) OVER (PARTITION BY portfolio_id) AS weight FROM holdings"
ANNUAL = f"sqrt({D.format(252)}) * 100"


@query("holdings_profit", with_views(f"""SELECT portfolio_id, symbol, {r('value', 2)} AS value,
    {r('value - profit', 3)} AS cost, {r('profit / (value - profit) * 100')} AS profit_pct,
    {r('value / sum(value) OVER (PARTITION BY portfolio_id) * 100')} AS share_pct FROM holdings""", "holdings"))
def holdings_profit(spark, sf):
    out = pf.profit_and_loss(v.holdings(spark, sf)).select("portfolio_id", "symbol", "value", "cost",
                                                           "profit_pct", "share_pct")
    return rounded(out, value=2, cost=3)


@query("normalised_weights", with_views(f"""SELECT portfolio_id, symbol,
    {r('profit / sum(profit) OVER (PARTITION BY portfolio_id)')} AS weight FROM holdings WHERE profit > 0""",
    "holdings"))
def normalised_weights(spark, sf):
    weights = v.holdings(spark, sf).select("portfolio_id", "symbol", F.col("profit").alias("weight"))
    return rounded(pf.normalise(weights))


@query("portfolios_without_weight", with_views("""SELECT portfolio_id FROM holdings GROUP BY portfolio_id
    HAVING max(profit) <= 0""", "holdings"))
def portfolios_without_weight(spark, sf):
    return pf.without_positive_weight(v.holdings(spark, sf), "profit").select("portfolio_id")


@query("positions_table", """SELECT o_orderkey AS portfolio_id, o_orderpriority AS symbol,
    {value} AS value, {profit} AS profit_pct
    FROM orders WHERE o_orderstatus = 'O'""".format(value=r("o_totalprice"), profit=r("o_totalprice / 1000")))
def positions_table(spark, sf):
    raw = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("portfolio_id"), F.col("o_orderpriority").alias("symbol"),
        F.when(F.col("o_orderstatus") == "O", "us_equity").otherwise("crypto").alias("asset_class"),
        F.lit("1").alias("qty"), F.col("o_totalprice").cast("string").alias("market_value"),
        (F.col("o_totalprice") / 100000.0).cast("string").alias("unrealized_plpc"))
    return rounded(pf.equities(accounts.positions(raw)).select("portfolio_id", "symbol", "value", "profit_pct"))


BOOK = {"complete": complete_sql("(SELECT * FROM order_closes)"), "steps": returns_sql("complete"),
        "weights": WEIGHTS,
        "book": "SELECT portfolio_id, symbol, weight, day, r FROM weights JOIN steps USING (symbol)",
        "daily": "SELECT portfolio_id, day, sum(weight * r) AS r FROM book GROUP BY portfolio_id, day"}


def _parts(spark, sf):
    return px.complete_returns(v.order_closes(spark, sf)), pf.held_weights(v.holdings(spark, sf))


@query("mix_evaluation", with_views(f"""SELECT portfolio_id, {r('ln(product(1 + r))')} AS grown_100,
    {r(f'stddev_samp(r) * {ANNUAL}')} AS volatility_pct, {r('100 * min(g / p - 1)')} AS biggest_drop_pct,
    count(*) AS days, {r('any_value(effective)')} AS effective FROM peaked
    JOIN (SELECT portfolio_id, 1 / sum(weight * weight) AS effective FROM weights GROUP BY 1) e
    USING (portfolio_id) GROUP BY portfolio_id""", "order_closes", "holdings", **BOOK,
    **path_steps("daily", "portfolio_id")))
def mix_evaluation(spark, sf):
    out = mixes.evaluate_mixes(*_parts(spark, sf))
    return rounded(out.withColumn("grown_100", F.log(F.col("grown_100") / 100.0)))


@query("risk_shares", with_views(f"""SELECT portfolio_id, symbol, {r('weight')} AS weight,
    {r('100 * weight * covar_samp(b.r, d.r) / var_samp(d.r)')} AS risk_pct,
    {r(f'stddev_samp(b.r) * {ANNUAL}')} AS own_volatility_pct,
    coalesce(100 * weight * covar_samp(b.r, d.r) / var_samp(d.r) > weight * 150, false) AS flagged
    FROM book b JOIN daily d USING (portfolio_id, day) GROUP BY portfolio_id, symbol, weight""",
    "order_closes", "holdings", **BOOK))
def risk_shares(spark, sf):
    out = mixes.mix_risk_shares(*_parts(spark, sf))
    flag = F.coalesce(fin.risk_flag(F.col("risk_pct"), F.col("weight") * 100.0), F.lit(False))
    return rounded(out.withColumn("flagged", flag))


@query("yearly_portfolio_stats", with_views(f"""SELECT portfolio_id, year,
    {r('100 * product(1 + r) - 100')} AS return_pct, {r(f'stddev_samp(r) * {ANNUAL}')} AS volatility_pct,
    {r('100 * min(g / p - 1)')} AS biggest_drop_pct, count(*) AS days FROM peaked
    GROUP BY portfolio_id, year""", "order_closes", "holdings", **BOOK,
    years="SELECT *, CAST(year(day) AS BIGINT) AS year FROM daily", **path_steps("years", "portfolio_id, year")))
def yearly_portfolio_stats(spark, sf):
    return rounded(mixes.yearly_mixes(*_parts(spark, sf)))


_SWAPPED = {
    "moved": """SELECT portfolio_id, coalesce(max(weight) FILTER (WHERE symbol = '1-URGENT'),
        CAST(0.20 AS DOUBLE)) AS weight FROM weights GROUP BY 1""",
    "raw": f"""SELECT portfolio_id, symbol, sum(weight) AS weight FROM (
        SELECT portfolio_id, symbol, weight FROM weights WHERE symbol <> '1-URGENT'
        UNION ALL SELECT portfolio_id, '{FUND}', weight FROM moved) t GROUP BY 1, 2""",
    "what_if": """SELECT portfolio_id, symbol,
        weight / sum(weight) OVER (PARTITION BY portfolio_id) AS weight FROM raw""",
    "both_daily": """SELECT portfolio_id, 'now' AS mix, day, sum(weight * r) AS r
        FROM weights JOIN steps USING (symbol) GROUP BY 1, 2, 3
        UNION ALL SELECT portfolio_id, 'if', day, sum(weight * r) FROM what_if JOIN steps USING (symbol)
        GROUP BY 1, 2, 3""",
    "both_years": f"""SELECT portfolio_id, mix, year(day) AS year, stddev_samp(r) * {ANNUAL} AS vol,
        product(1 + r) AS g FROM both_daily GROUP BY 1, 2, 3"""}


@query("swap_what_if", with_views("""SELECT portfolio_id, count(*) FILTER (WHERE round(b.vol, 6) < round(a.vol, 6)) AS calmer_years,
    count(*) FILTER (WHERE round(100 * b.g, 6) > round(100 * a.g, 6)) AS richer_years, count(*) AS years FROM both_years a
    JOIN both_years b USING (portfolio_id, year) WHERE a.mix = 'now' AND b.mix = 'if' GROUP BY portfolio_id""",
    "order_closes", "holdings", **{k: BOOK[k] for k in ("complete", "steps", "weights")}, **_SWAPPED))
def swap_what_if(spark, sf):
    returns = px.complete_returns(v.order_closes(spark, sf))
    weights = pf.held_weights(v.holdings(spark, sf))
    changed = pf.normalise(pf.swap(weights, "1-URGENT", FUND, 0.20))
    return pf.compare_years(mixes.yearly_mixes(returns, weights), mixes.yearly_mixes(returns, changed))


# --- health check -------------------------------------------------------------------------------

HEALTH = {
    "recent": YEAR,
    "usable": "SELECT symbol FROM recent GROUP BY symbol HAVING count(close) >= 20",
    "held": "SELECT portfolio_id, symbol, value FROM holdings WHERE symbol IN (SELECT symbol FROM usable)",
    "members": f"""SELECT portfolio_id, symbol, max(value) AS value, bool_or(bench) AS bench FROM (
        SELECT portfolio_id, symbol, value, false AS bench FROM held
        UNION ALL SELECT DISTINCT portfolio_id, '{FUND}', CAST(NULL AS DOUBLE), true FROM held) t GROUP BY 1, 2""",
    "shares": """SELECT *, value / sum(value) OVER (PARTITION BY portfolio_id) AS weight,
        count(*) OVER (PARTITION BY portfolio_id) AS n FROM members""",
    "priced": """SELECT s.*, day, close, count(*) OVER (PARTITION BY portfolio_id, day) AS present
        FROM shares s JOIN recent USING (symbol)""",
    "hbook": """SELECT * FROM (SELECT *, close / lag(close) OVER (PARTITION BY portfolio_id, symbol ORDER BY day)
        - 1 AS r FROM priced WHERE present = n) t WHERE r IS NOT NULL""",
    "hdaily": """SELECT portfolio_id, day, sum(weight * r) AS r FROM hbook WHERE weight IS NOT NULL
        GROUP BY portfolio_id, day""",
    "hpositions": f"""SELECT b.portfolio_id, b.symbol, any_value(coalesce(sector, 'Other')) AS sector, value,
        weight, 100 * weight * covar_samp(b.r, d.r) / var_samp(d.r) AS risk_pct,
        stddev_samp(b.r) * {ANNUAL} AS own_volatility_pct FROM hbook b JOIN hdaily d USING (portfolio_id, day)
        LEFT JOIN sectors s ON s.symbol = b.symbol WHERE weight IS NOT NULL
        GROUP BY b.portfolio_id, b.symbol, value, weight""",
}


def _health(spark, sf):
    return health.health_check(year_closes(spark, sf), v.holdings(spark, sf),
                               reference.sectors(spark, SECTORS), benchmarks=(FUND,), min_days=20)


@query("health_positions", with_views(f"""SELECT portfolio_id, symbol, sector, {r('value', 2)} AS value,
    {r('weight')} AS weight, {r('weight * 100')} AS money_pct, {r('risk_pct')} AS risk_pct,
    {r('own_volatility_pct')} AS own_volatility_pct FROM hpositions""", "order_closes", "holdings",
    sectors=SECTOR_SQL, **HEALTH))
def health_positions(spark, sf):
    return rounded(_health(spark, sf).positions, value=2)


@query("health_sectors", with_views(f"""SELECT portfolio_id, sector, {r('sum(weight * 100)')} AS money_pct
    FROM hpositions GROUP BY portfolio_id, sector""", "order_closes", "holdings", sectors=SECTOR_SQL, **HEALTH))
def health_sectors(spark, sf):
    return rounded(_health(spark, sf).by_sector)


_NAMED = {"named": f"""SELECT portfolio_id, 'Your mix' AS name, day, r FROM hdaily
    UNION ALL SELECT portfolio_id, 'Just ' || symbol, day, r FROM hbook WHERE bench"""}


@query("health_comparison", with_views(f"""SELECT portfolio_id, name,
    {r('100 * product(1 + r)')} AS grown_100, {r(f'stddev_samp(r) * {ANNUAL}')} AS volatility_pct,
    {r('100 * min(g / p - 1)')} AS biggest_drop_pct FROM peaked GROUP BY portfolio_id, name""",
    "order_closes", "holdings", **{k: s for k, s in HEALTH.items() if k != "hpositions"}, **_NAMED,
    **path_steps("named", "portfolio_id, name")))
def health_comparison(spark, sf):
    return rounded(_health(spark, sf).comparison)


@query("health_growth", with_views(f"""SELECT portfolio_id, name, day, {r('r')} AS r,
    {r('100 * g')} AS growth FROM peaked""", "order_closes", "holdings",
    **{k: s for k, s in HEALTH.items() if k != "hpositions"}, **_NAMED,
    **path_steps("named", "portfolio_id, name")))
def health_growth(spark, sf):
    return rounded(_health(spark, sf).growth)


@query("health_correlations", with_views(f"""SELECT a.portfolio_id, a.symbol AS sym_a, b.symbol AS sym_b,
    {r('corr(a.r, b.r)')} AS corr, count(*) AS n_days FROM hbook a JOIN hbook b
    ON a.portfolio_id = b.portfolio_id AND a.day = b.day AND a.symbol < b.symbol
    WHERE a.weight IS NOT NULL AND b.weight IS NOT NULL GROUP BY 1, 2, 3""",
    "order_closes", "holdings", **{k: s for k, s in HEALTH.items() if k != "hpositions"}))
def health_correlations(spark, sf):
    return rounded(_health(spark, sf).correlations)


@query("health_effective", with_views(f"""SELECT portfolio_id, {r('1 / sum(weight * weight)')} AS effective
    FROM (SELECT DISTINCT portfolio_id, symbol, weight FROM hbook WHERE weight IS NOT NULL) t
    GROUP BY portfolio_id""", "order_closes", "holdings",
    **{k: s for k, s in HEALTH.items() if k != "hpositions"}))
def health_effective(spark, sf):
    return rounded(_health(spark, sf).effective)


_SHORT = {"recent": YEAR,
          "left_out": """SELECT h.* FROM holdings h WHERE symbol NOT IN
              (SELECT symbol FROM recent GROUP BY symbol HAVING count(close) >= (SELECT floor(avg(n))
               FROM (SELECT count(*) AS n FROM recent GROUP BY symbol) t))"""}


@query("excluded_money", with_views(f"""SELECT portfolio_id, {r('total', 2)} AS total,
    {r('coalesce(excluded, 0)', 2)} AS excluded, {r('coalesce(excluded, 0) / total * 100')} AS excluded_pct
    FROM (SELECT portfolio_id, sum(value) AS total FROM holdings GROUP BY 1) t LEFT JOIN
    (SELECT portfolio_id, sum(value) AS excluded FROM left_out GROUP BY 1) x USING (portfolio_id)""",
    "order_closes", "holdings", **_SHORT))
def excluded_money(spark, sf):
    closes, held = year_closes(spark, sf), v.holdings(spark, sf)
    counts = closes.groupBy("symbol").agg(F.count("close").alias("n"))
    typical = counts.agg(F.floor(F.avg("n")).alias("n")).scalar()
    short = counts.where(F.col("n") < typical).select("symbol")
    return rounded(pf.excluded_money(held, held.join(short, "symbol", "left_semi")), total=2, excluded=2)


# --- plans --------------------------------------------------------------------------------------

_TWO = {"now": """SELECT o_custkey AS portfolio_id, o_orderpriority AS symbol, sum(o_totalprice) AS value
            FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2""",
        "goal": """SELECT o_custkey AS portfolio_id, o_orderpriority AS symbol, sum(o_totalprice) AS value
            FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2""",
        "both_": """SELECT coalesce(n.portfolio_id, g.portfolio_id) AS portfolio_id,
            coalesce(n.symbol, g.symbol) AS symbol, coalesce(n.value, 0) AS now_, coalesce(g.value, 0) AS goal_
            FROM now n FULL JOIN goal g ON n.portfolio_id = g.portfolio_id AND n.symbol = g.symbol"""}


@query("rebalance_orders", with_views(f"""SELECT portfolio_id, symbol, {r('now_', 2)} AS now,
    {r('goal_', 2)} AS target, {r('goal_ - now_', 2)} AS change, CASE WHEN goal_ = 0 THEN 'SELL ALL'
    WHEN goal_ < now_ THEN 'SELL' ELSE 'BUY' END AS side FROM both_ WHERE abs(goal_ - now_) >= 20000""", **_TWO))
def rebalance_orders(spark, sf):
    return rounded(pl.rebalance_orders(v.holdings_by_status(spark, sf, "F"),
                                       v.holdings_by_status(spark, sf, "O"), 20000.0), 2)


_STATUS = """CASE WHEN now_ = 0 AND symbol = '2-HIGH' THEN 'can''t mirror' WHEN goal_ = 0 THEN 'extra'
    WHEN abs((now_ - goal_) / goal_ * 100) <= 30 THEN 'in sync' WHEN now_ > goal_ THEN 'too much'
    ELSE 'too little' END"""


def _mirror(spark, sf):
    real = v.holdings_by_status(spark, sf, "O")
    paper = v.holdings_by_status(spark, sf, "F")
    blocked = real.unionByName(paper).where(F.col("symbol") == "2-HIGH").select(
        "portfolio_id", "symbol").distinct()
    return pl.mirror_status(paper, real, 30.0, blocked)


@query("mirror_status", with_views(f"""SELECT portfolio_id, symbol, {r('goal_', 2)} AS real,
    {r('now_', 2)} AS paper, {r('now_ - goal_', 2)} AS difference, {_STATUS} AS status FROM both_""", **_TWO))
def mirror_status(spark, sf):
    return rounded(_mirror(spark, sf), 2)


@query("mirror_summary", with_views(f"""SELECT portfolio_id, count(*) FILTER (WHERE status = 'in sync') AS in_sync,
    count(*) FILTER (WHERE status NOT IN ('extra', 'can''t mirror')) AS mirrorable,
    count(*) FILTER (WHERE status = 'extra') AS extra
    FROM (SELECT portfolio_id, {_STATUS} AS status FROM both_) t GROUP BY portfolio_id""", **_TWO))
def mirror_summary(spark, sf):
    return rounded(pl.mirror_summary(_mirror(spark, sf)))


@query("scaled_targets", with_views(f"""SELECT portfolio_id, symbol,
    {r('3000 * value / sum(value) OVER (PARTITION BY portfolio_id)')} AS value FROM goal""", **_TWO))
def scaled_targets(spark, sf):
    return rounded(pl.scale_to_total(v.holdings_by_status(spark, sf, "O"), 3000.0))


@query("tradable_screen", with_views(f"""SELECT portfolio_id, symbol, {r('value', 2)} AS value,
    CASE WHEN n_regionkey IS NULL THEN 'not found' WHEN n_regionkey = 0 THEN 'not tradable'
    WHEN n_regionkey = 1 THEN 'whole shares only' END AS reason
    FROM supplier_holdings LEFT JOIN (SELECT 'S' || s_suppkey AS symbol, n_regionkey FROM supplier
    JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0) a USING (symbol)""", "supplier_holdings"))
def tradable_screen(spark, sf):
    assets = (v.table(spark, sf, "supplier").where(F.col("s_acctbal") > 0)
              .join(v.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
              .select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"),
                      (F.col("n_regionkey") != 0).alias("tradable"),
                      (F.col("n_regionkey") != 1).alias("fractionable")))
    return rounded(pl.screen_tradable(v.supplier_holdings(spark, sf), assets), value=2)


@query("plans_without_open_orders", with_views("""SELECT portfolio_id, symbol FROM now WHERE portfolio_id NOT IN
    (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""", **_TWO))
def plans_without_open_orders(spark, sf):
    waiting = v.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").alias("portfolio_id"))
    plan = v.holdings_by_status(spark, sf, "F").select("portfolio_id", "symbol")
    return pl.without_open_orders(plan, waiting)


_PLAN = {
    "flagged": f"""SELECT portfolio_id, symbol, value, symbol NOT IN ('{FUND}', '2-HIGH') AS sold
        FROM holdings""",
    "slices": """SELECT portfolio_id, coalesce(sum(value) FILTER (WHERE sold), 0) / 12 AS slice
        FROM flagged GROUP BY 1""",
    "split": f"""SELECT portfolio_id, unnest(['{FUND}', 'FUND']) AS symbol,
        unnest([CAST(0.75 AS DOUBLE), CAST(0.25 AS DOUBLE)]) AS weight FROM slices""",
    "lines": """SELECT coalesce(f.portfolio_id, s.portfolio_id) AS portfolio_id,
        coalesce(f.symbol, s.symbol) AS symbol, coalesce(value, 0) AS value, coalesce(weight, 0) AS weight,
        coalesce(sold, false) AS sold FROM flagged f FULL JOIN split s
        ON f.portfolio_id = s.portfolio_id AND f.symbol = s.symbol""",
    "plan": """SELECT portfolio_id, month, symbol, greatest(0, value + month * (slice * weight
        - CASE WHEN sold THEN value / 12 ELSE 0 END)) AS value, sold FROM lines
        JOIN slices USING (portfolio_id) CROSS JOIN (SELECT unnest(generate_series(0, 12)) AS month) m""",
    "morders": """SELECT portfolio_id, symbol, CAST(round(CAST(round(sum(CASE month WHEN 1 THEN value ELSE -value END), 6)
        AS DECIMAL(18, 6)), 2) AS DOUBLE) AS change
        FROM plan WHERE month IN (0, 1) GROUP BY 1, 2""",
}


def _plan(spark, sf):
    held = cut_lineage(v.holdings(spark, sf).select("portfolio_id", "symbol", "value"))      # read five times by the plan
    split = held.select("portfolio_id").distinct().select("portfolio_id", F.explode(F.array(
        F.struct(F.lit(FUND).alias("symbol"), F.lit(3.0).alias("weight")),
        F.struct(F.lit("FUND").alias("symbol"), F.lit(1.0).alias("weight")))).alias("s"))
    return pl.transition_plan(held, split.select("portfolio_id", "s.symbol", "s.weight"),
                              reference.funds(spark, (FUND, "FUND")), 12, keep=("2-HIGH",))


@query("transition_plan", with_views(f"""SELECT portfolio_id, CAST(month AS BIGINT) AS month, symbol,
    {r('value', 4)} AS value, sold FROM plan""", "holdings", **_PLAN))
def transition_plan(spark, sf):
    return rounded(_plan(spark, sf), 4)


@query("monthly_orders", with_views("""SELECT portfolio_id, symbol, change + CAST(0 AS DOUBLE) AS change,
    CASE WHEN change < 0 THEN 'sell' ELSE 'buy' END AS side FROM morders WHERE change <> 0""",
    "holdings", **_PLAN))
def monthly_orders(spark, sf):
    return pl.monthly_orders(_plan(spark, sf))


@query("order_fees", with_views(f"""SELECT portfolio_id, CAST(steps AS BIGINT) AS steps, steps * n AS orders,
    {r('steps * n * CAST(1.5 AS DOUBLE)')} AS fees, {r('steps * n * CAST(1.5 AS DOUBLE) / total * 100')} AS fees_pct
    FROM (SELECT portfolio_id, count(*) AS n FROM morders WHERE change <> 0 GROUP BY 1) o
    JOIN (SELECT portfolio_id, sum(value) AS total FROM holdings GROUP BY 1) h USING (portfolio_id)
    CROSS JOIN (SELECT unnest([1, 4, 12]) AS steps) s""", "holdings", **_PLAN))
def order_fees(spark, sf):
    return rounded(pl.order_fees(v.holdings(spark, sf), pl.monthly_orders(_plan(spark, sf)), [1, 4, 12], 1.5))


@query("plan_risk", with_views(f"""SELECT portfolio_id, CAST(month AS BIGINT) AS month,
    {r('100 * product(1 + r)')} AS grown_100, {r(f'stddev_samp(r) * {ANNUAL}')} AS volatility_pct,
    {r('100 * min(g / p - 1)')} AS biggest_drop_pct, count(*) AS days FROM peaked GROUP BY portfolio_id, month""",
    "order_closes", "holdings", **{k: s for k, s in _PLAN.items() if k != "morders"},
    recent=YEAR, usable="SELECT symbol FROM recent GROUP BY symbol HAVING count(close) >= 20",
    members="SELECT DISTINCT portfolio_id, symbol FROM plan WHERE symbol IN (SELECT symbol FROM usable)",
    counted="SELECT *, count(*) OVER (PARTITION BY portfolio_id) AS n FROM members",
    priced="""SELECT c.*, day, close, count(*) OVER (PARTITION BY portfolio_id, day) AS present
        FROM counted c JOIN recent USING (symbol)""",
    pbook="""SELECT * FROM (SELECT *, close / lag(close) OVER (PARTITION BY portfolio_id, symbol ORDER BY day)
        - 1 AS r FROM priced WHERE present = n) t WHERE r IS NOT NULL""",
    pdaily="""SELECT portfolio_id, month, day, sum(value * r) / sum(value) AS r FROM pbook
        JOIN plan USING (portfolio_id, symbol) WHERE month IN (0, 3, 6, 9, 12) AND value > 0 GROUP BY 1, 2, 3""",
    **path_steps("pdaily", "portfolio_id, month")))
def plan_risk(spark, sf):
    out = outlook.plan_risk(year_closes(spark, sf), _plan(spark, sf), pl.plan_checkpoints(12), 20)
    return rounded(out)


_BOT = {
    "sig": f"""SELECT symbol, days, close AS price, average, coalesce(close > average, false) AS own FROM (
        SELECT symbol, close, {full_sql('avg', 'close', 20)} AS average,
        count(*) OVER (PARTITION BY symbol) AS days,
        row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM order_closes) t WHERE k = 1""",
    "now": _TWO["now"],
    "rows_": """SELECT h.portfolio_id, dense_rank() OVER (ORDER BY h.symbol) AS pos, h.symbol,
        coalesce(days, 0) AS days, coalesce(own, false) AS own, price, average,
        CASE WHEN n.value IS NOT NULL AND h.symbol <> '4-NOT SPECIFIED' THEN CAST(floor(n.value / 50000) AS BIGINT)
        ELSE 0 END AS held,
        EXISTS (SELECT 1 FROM orders o WHERE o_orderstatus = 'P' AND o.o_custkey = h.portfolio_id
                AND o.o_orderpriority = h.symbol) AS pending
        FROM holdings h LEFT JOIN sig USING (symbol)
        LEFT JOIN now n ON n.portfolio_id = h.portfolio_id AND n.symbol = h.symbol""",
    "acts": """SELECT *, CASE WHEN days < 20 THEN 'SHORT' WHEN pending THEN 'WAIT' WHEN own AND held > 0 THEN 'HOLD'
        WHEN own THEN 'BUY' WHEN held > 0 THEN 'SELL' ELSE 'STAY OUT' END AS action,
        CASE WHEN price > 0 THEN CAST(floor(1000 / price) AS BIGINT) ELSE 0 END AS wanted FROM rows_""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY pos) AS i FROM acts
        WHERE action = 'BUY' AND wanted > 0""",
    "walk": """SELECT c_custkey AS portfolio_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS pos,
        greatest(c_acctbal, 0) / 3 AS cash, false AS fits FROM customer
        UNION ALL SELECT w.portfolio_id, n.i, n.pos,
        CASE WHEN wanted * price <= cash THEN cash - wanted * price ELSE cash END, wanted * price <= cash
        FROM walk w JOIN numbered n ON n.portfolio_id = w.portfolio_id AND n.i = w.i + 1""",
    "finals": """SELECT a.portfolio_id, a.pos, a.symbol, price, average, held, wanted, action AS first_action,
        CASE WHEN action = 'SHORT' OR (action = 'BUY' AND NOT coalesce(fits, false)) THEN 'SKIPPED'
        ELSE action END AS action FROM acts a LEFT JOIN walk w
        ON w.portfolio_id = a.portfolio_id AND w.pos = a.pos""",
}


def _decisions(spark, sf):
    held = v.holdings(spark, sf)
    names = numbered(held, "symbol").withColumn("pos", F.col("pos") + 1)
    watch = held.select("portfolio_id", "symbol").join(names, "symbol")
    # one symbol is taken out of the positions, so that some watched entries are not held
    positions = (v.holdings_by_status(spark, sf, "F").where(F.col("symbol") != "4-NOT SPECIFIED")
                 .withColumn("qty", F.floor(F.col("value") / 50000.0)))
    cash = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("portfolio_id"), (F.greatest("c_acctbal", F.lit(0.0)) / 3.0).alias("cash"))
    waiting = v.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").alias("portfolio_id"), F.col("o_orderpriority").alias("symbol"))
    return bot.decide_all(v.order_closes(spark, sf), watch, positions, cash, waiting, 20, 1000.0)


def _bot_sql(body: str) -> str:
    return with_views(body, "order_closes", "holdings", **_BOT).replace("WITH ", "WITH RECURSIVE ", 1)


@query("purchase_decisions", _bot_sql(f"""SELECT portfolio_id, pos, symbol, action, CAST(CASE WHEN action = 'BUY'
    THEN wanted WHEN action IN ('SELL', 'HOLD') THEN held ELSE 0 END AS BIGINT) AS shares,
    {r("CASE WHEN first_action = 'SHORT' THEN 0 ELSE price END")} AS price,
    {r("CASE WHEN first_action = 'SHORT' THEN 0 ELSE average END")} AS average,
    CASE WHEN first_action = 'SHORT' THEN 'not enough price history' WHEN action = 'SKIPPED' AND wanted = 0
    THEN 'one share costs more than the budget' WHEN action = 'SKIPPED' THEN 'not enough cash' ELSE '' END AS note
    FROM finals"""))
def purchase_decisions(spark, sf):
    return rounded(_decisions(spark, sf))


@query("decision_counts", _bot_sql("SELECT portfolio_id, action, count(*) AS n FROM finals GROUP BY 1, 2"))
def decision_counts(spark, sf):
    return pl.decision_counts(_decisions(spark, sf))


# --- outlook and currency -----------------------------------------------------------------------

def _outlook_steps(euros: bool) -> dict[str, str]:
    r_ = "(1 + r) / (1 + coalesce(fx, 0)) - 1" if euros else "r"
    return {
        "recent": YEAR,
        "usable": "SELECT symbol FROM recent GROUP BY symbol HAVING count(close) >= 20",
        "shares": """SELECT portfolio_id, symbol, value, value / sum(value) OVER (PARTITION BY portfolio_id)
            AS weight, count(*) OVER (PARTITION BY portfolio_id) AS n FROM holdings
            WHERE symbol IN (SELECT symbol FROM usable)""",
        "priced": HEALTH["priced"],
        "fx": "SELECT day, rate / lag(rate) OVER (ORDER BY day) - 1 AS fx FROM rates",
        "obook": f"""SELECT portfolio_id, symbol, weight, day, {r_} AS r FROM ({HEALTH['hbook']}) b
            LEFT JOIN fx USING (day)""",
        "smoothed": ewma_sql("obook", "portfolio_id, symbol"),
        "measured": f"""SELECT *, CASE WHEN count(r) OVER f = 30 THEN stddev_samp(r) OVER f END * {ANNUAL} AS m
            FROM smoothed WINDOW f AS (PARTITION BY portfolio_id, symbol ORDER BY day
            ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
        "lasts": """SELECT portfolio_id, symbol, arg_max(ewma, day) AS e,
            max(day) AS d FROM measured GROUP BY 1, 2""",
        "chosen": """SELECT l.portfolio_id, l.symbol, CASE WHEN count(*) FILTER (WHERE m IS NULL) OVER
            (PARTITION BY l.portfolio_id) > 0 THEN e ELSE m END AS vol FROM lasts l JOIN measured x
            ON x.portfolio_id = l.portfolio_id AND x.symbol = l.symbol AND x.day = l.d""",
        "odaily": "SELECT portfolio_id, day, sum(weight * r) AS r FROM obook GROUP BY 1, 2",
        "msmoothed": ewma_sql("odaily", "portfolio_id"),
        "mixes": "SELECT portfolio_id, arg_max(ewma, day) AS vol FROM msmoothed GROUP BY 1",
    }


def _outlook(spark, sf, euros=False):
    fx = None
    if euros:
        rates = v.rates(spark, sf).withColumn("symbol", F.lit("FX"))
        fx = px.daily_returns(rates, value="rate").where(F.col("r").isNotNull()).select("day", "r")
    return outlook.forecast_holdings(year_closes(spark, sf), v.holdings(spark, sf), "month", 20, fx, {"month": 30})


_RANGES = f"""{r('vol')} AS volatility_pct, {r(f"vol / sqrt({D.format(12)})")} AS typical_pct,
    {r(f"-{D.format(1.65)} * vol / sqrt({D.format(12)})")} AS bad_pct"""


@query("holdings_outlook", with_views(f"SELECT portfolio_id, symbol, {_RANGES} FROM chosen",
       "order_closes", "holdings", "rates", **_outlook_steps(False)))
def holdings_outlook(spark, sf):
    return rounded(_outlook(spark, sf).holdings)


@query("mix_outlook_in_euros", with_views(f"SELECT portfolio_id, {_RANGES} FROM mixes",
       "order_closes", "holdings", "rates", **_outlook_steps(True)))
def mix_outlook_in_euros(spark, sf):
    return rounded(_outlook(spark, sf, True).mix)


def _two_outlooks() -> dict[str, str]:
    usd = _outlook_steps(False)
    eur = _outlook_steps(True)
    steps = {k: usd[k] for k in ("recent", "usable", "shares", "priced", "fx")}
    for tag, source in (("u", usd), ("e", eur)):
        steps[f"{tag}book"] = source["obook"]
        steps[f"{tag}daily"] = source["odaily"].replace("obook", f"{tag}book")
        steps[f"{tag}mix"] = (f"SELECT portfolio_id, arg_max(ewma, day) AS vol FROM "
                              f"({ewma_sql(f'{tag}daily', 'portfolio_id')}) t GROUP BY 1")
    return steps


@query("usd_against_eur_risk", with_views(f"""SELECT portfolio_id, {r('u.vol')} AS usd_pct, {r('e.vol')} AS eur_pct,
    CASE WHEN e.vol - u.vol > 0.5 THEN 'adds risk' WHEN e.vol - u.vol < -0.5 THEN 'lowers risk'
    ELSE 'about the same' END AS effect FROM umix u JOIN emix e USING (portfolio_id)""",
    "order_closes", "holdings", "rates", **_two_outlooks()))
def usd_against_eur_risk(spark, sf):
    return rounded(outlook.usd_against_eur(_outlook(spark, sf).mix, _outlook(spark, sf, True).mix))


@query("euro_prices", with_views(f"""SELECT symbol, day, {r('close')} AS close, {r('rate')} AS rate,
    {r('close / rate')} AS close_eur FROM (SELECT symbol, c.day, close, last_value(x.rate IGNORE NULLS) OVER
    (PARTITION BY symbol ORDER BY c.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate
    FROM supplier_closes c LEFT JOIN rates x ON x.day = c.day) t""", "supplier_closes", "rates"))
def euro_prices(spark, sf):
    return rounded(cur.to_euro_prices(v.supplier_closes(spark, sf), v.rates(spark, sf)))


@query("euro_returns", with_views(f"""SELECT symbol, day, {r('r')} AS r,
    {r('(1 + r) / (1 + coalesce(fx, 0)) - 1')} AS r_eur FROM steps LEFT JOIN fx USING (day)""",
    "supplier_closes", "rates", steps=returns_sql("supplier_closes"),
    fx="SELECT day, rate / lag(rate) OVER (ORDER BY day) - 1 AS fx FROM rates"))
def euro_returns(spark, sf):
    rates = v.rates(spark, sf).withColumn("symbol", F.lit("FX"))
    fx = px.daily_returns(rates, value="rate").where(F.col("r").isNotNull())
    returns = px.daily_returns(v.supplier_closes(spark, sf)).where(F.col("r").isNotNull())
    return rounded(cur.to_euro_returns(returns.select("symbol", "day", "r"), fx))


@query("mix_result_in_both", with_views(f"""SELECT portfolio_id, {r('usd')} AS usd_pct, {r('fx')} AS fx_pct,
    {r('((1 + usd / 100) / (1 + fx / 100) - 1) * 100')} AS total_eur_pct,
    {r('((1 + usd / 100) / (1 + fx / 100) - 1) * 100 - usd')} AS currency_pct FROM (
    SELECT portfolio_id, sum(value * usd_pct) / sum(value) AS usd, max(fx_pct) AS fx FROM supplier_holdings
    JOIN changed USING (symbol) CROSS JOIN fxc GROUP BY portfolio_id) t""",
    "supplier_closes", "supplier_holdings", "rates",
    changed="""SELECT symbol, (close / base - 1) * 100 AS usd_pct FROM (SELECT symbol, close,
        lag(close, 21) OVER (PARTITION BY symbol ORDER BY day) AS base,
        lead(day) OVER (PARTITION BY symbol ORDER BY day) AS nxt FROM supplier_closes) t
        WHERE nxt IS NULL AND base IS NOT NULL""",
    fxc="""SELECT (rate / base - 1) * 100 AS fx_pct FROM (SELECT rate, lag(rate, 21) OVER (ORDER BY day) AS base,
        lead(day) OVER (ORDER BY day) AS nxt FROM rates) t WHERE nxt IS NULL"""))
def mix_result_in_both(spark, sf):
    rate = px.change_over_rows(v.rates(spark, sf).select(F.lit("FX").alias("symbol"), "day",
                                                         F.col("rate").alias("close")), 21)
    changes = px.change_over_rows(v.supplier_closes(spark, sf), 21).select(
        "symbol", (F.col("change") * 100.0).alias("usd_pct"))
    fx = rate.select((F.col("change") * 100.0).alias("fx_pct")).scalar()
    return rounded(cur.mix_in_both(v.supplier_holdings(spark, sf), changes.withColumn("fx_pct", fx)))


# --- dividends ----------------------------------------------------------------------------------

_DIV = {
    "own": """SELECT symbol, ex_date, rate, date_diff('day', lag(ex_date) OVER (PARTITION BY symbol
        ORDER BY ex_date), ex_date) AS gap FROM dividends WHERE NOT special""",
    "facts": f"""SELECT symbol, count(*) FILTER (WHERE ex_date <= DATE '{AS_OF}'
            AND ex_date > DATE '{AS_OF}' - 365) AS payments_12m,
        coalesce(sum(rate) FILTER (WHERE ex_date <= DATE '{AS_OF}' AND ex_date > DATE '{AS_OF}' - 365), 0)
            AS per_share_12m, min(ex_date) FILTER (WHERE ex_date > DATE '{AS_OF}') AS announced,
        max(ex_date) AS last_, count(*) AS n, CAST(floor(median(gap)) AS INTEGER) AS g FROM own GROUP BY symbol""",
    "dated": f"""SELECT *, CASE WHEN n >= 2 AND g >= 1 THEN last_ + CAST(g * greatest(1,
        floor(date_diff('day', last_, DATE '{AS_OF}') / g) + 1) AS INTEGER) END AS estimate FROM facts""",
    "prices": """SELECT symbol, arg_max(close, day) AS price FROM supplier_closes GROUP BY symbol""",
    "summary": """SELECT portfolio_id, symbol, value, coalesce(payments_12m, 0) AS payments_12m,
        coalesce(per_share_12m, 0) AS per_share_12m, coalesce(announced, estimate) AS next_date,
        CASE WHEN announced IS NOT NULL THEN 'announced' WHEN estimate IS NOT NULL THEN 'estimate' ELSE '-' END
        AS next_is, CASE WHEN price IS NOT NULL THEN coalesce(per_share_12m, 0) / price * 100
        WHEN coalesce(per_share_12m, 0) = 0 THEN 0 END AS yield_pct
        FROM supplier_holdings LEFT JOIN dated USING (symbol) LEFT JOIN prices USING (symbol)""",
}
_DIV_VIEWS = ("supplier_closes", "supplier_holdings", "dividends")


def _dividends(spark, sf):
    prices = (v.supplier_closes(spark, sf).groupBy("symbol")
              .agg(F.max_by("close", "day").alias("price")))
    return dv.summarise(v.dividends(spark, sf), prices, v.supplier_holdings(spark, sf), AS_OF)


@query("dividend_summary", with_views(f"""SELECT portfolio_id, symbol, {r('value', 2)} AS value, payments_12m,
    {r('per_share_12m')} AS per_share_12m, next_date, next_is, {r('yield_pct')} AS yield_pct,
    {r('value * yield_pct / 100')} AS income_year FROM summary""", *_DIV_VIEWS, **_DIV))
def dividend_summary(spark, sf):
    return rounded(_dividends(spark, sf), value=2)


@query("dividend_income", with_views(f"""SELECT portfolio_id,
    {r('coalesce(sum(value * yield_pct / 100), 0)')} AS income_year,
    count(*) FILTER (WHERE value * yield_pct > 0) AS payers, {r('sum(value)', 2)} AS value,
    {r('coalesce(sum(value * yield_pct / 100), 0) / sum(value) * 100')} AS portfolio_yield_pct
    FROM summary GROUP BY portfolio_id""", *_DIV_VIEWS, **_DIV))
def dividend_income(spark, sf):
    return rounded(dv.income_totals(_dividends(spark, sf)), value=2)


@query("upcoming_dividends", with_views(f"""SELECT portfolio_id, symbol, next_date, next_is FROM summary
    WHERE next_date <= DATE '{AS_OF}' + 183""", *_DIV_VIEWS, **_DIV))
def upcoming_dividends(spark, sf):
    return dv.upcoming(_dividends(spark, sf), AS_OF).select("portfolio_id", "symbol", "next_date", "next_is")


@query("next_dividend", with_views("""SELECT portfolio_id, symbol, next_date, next_is FROM (SELECT *,
    row_number() OVER (PARTITION BY portfolio_id ORDER BY next_date, symbol) AS k FROM summary
    WHERE next_date IS NOT NULL) t WHERE k = 1""", *_DIV_VIEWS, **_DIV))
def next_dividend(spark, sf):
    return dv.next_payment(_dividends(spark, sf))


@query("dividend_window", with_views(f"""SELECT symbol, ex_date, {r('rate')} AS rate, special FROM dividends
    WHERE ex_date BETWEEN DATE '{AS_OF}' - 400 AND DATE '{AS_OF}' + 90""", "dividends"))
def dividend_window(spark, sf):
    return rounded(market.dividend_window(v.dividends(spark, sf), AS_OF))


# --- moves and rules ----------------------------------------------------------------------------

_MOVED = {
    "recent": """SELECT symbol, close, (close / prev - 1) * 100 AS day_pct, (close / base - 1) * 100 AS month_pct
        FROM (SELECT symbol, close, lag(close) OVER w AS prev, coalesce(lag(close, 21) OVER w,
        first(close) OVER w) AS base, lead(day) OVER w AS nxt FROM supplier_closes
        WINDOW w AS (PARTITION BY symbol ORDER BY day)) t WHERE nxt IS NULL AND prev IS NOT NULL""",
    "moved": """SELECT portfolio_id, symbol, value, value / sum(value) OVER (PARTITION BY portfolio_id) * 100
        AS share_pct, close, day_pct, month_pct FROM supplier_holdings LEFT JOIN recent USING (symbol)""",
}
_NATION_SECTOR = "SELECT 'S' || s_suppkey AS symbol, 'size ' || (s_suppkey % 3) AS sector FROM supplier WHERE s_acctbal > 1000"


def _moved(spark, sf):
    return alerts.holdings_moves(v.supplier_holdings(spark, sf), px.recent_moves(v.supplier_closes(spark, sf)))


@query("holdings_moves", with_views(f"""SELECT portfolio_id, symbol, {r('value', 2)} AS value,
    {r('share_pct')} AS share_pct, {r('close')} AS close, {r('day_pct')} AS day_pct,
    {r('month_pct')} AS month_pct FROM moved""", "supplier_closes", "supplier_holdings", **_MOVED))
def holdings_moves(spark, sf):
    return rounded(_moved(spark, sf), value=2)


@query("portfolio_day", with_views(f"""SELECT portfolio_id,
    {r('sum(day_pct * share_pct) / sum(share_pct) FILTER (WHERE day_pct IS NOT NULL)')} AS day_pct,
    count(*) FILTER (WHERE day_pct IS NULL) AS missing FROM moved GROUP BY portfolio_id""",
    "supplier_closes", "supplier_holdings", **_MOVED))
def portfolio_day(spark, sf):
    return rounded(alerts.portfolio_day(_moved(spark, sf)))


@query("rule_alerts", with_views(f"""SELECT portfolio_id, rule, subject, {r('value')} AS value, "limit" FROM (
    SELECT portfolio_id, 'single stock' AS rule, symbol AS subject, share_pct AS value, CAST(20 AS DOUBLE) AS "limit"
    FROM moved WHERE symbol NOT IN ('S1', 'S2') AND share_pct > 20
    UNION ALL SELECT portfolio_id, 'daily move', symbol, day_pct, CAST(5 AS DOUBLE) FROM moved WHERE abs(day_pct) > 5
    UNION ALL SELECT portfolio_id, 'sector', coalesce(sector, 'Other'), sum(share_pct), CAST(50 AS DOUBLE)
    FROM moved LEFT JOIN sectors USING (symbol) WHERE symbol NOT IN ('S1', 'S2')
    GROUP BY portfolio_id, coalesce(sector, 'Other') HAVING sum(share_pct) > 50) t""",
    "supplier_closes", "supplier_holdings", **_MOVED, sectors=_NATION_SECTOR))
def rule_alerts(spark, sf):
    sectors = v.table(spark, sf, "supplier").where(F.col("s_acctbal") > 1000).select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"),
        F.concat(F.lit("size "), F.col("s_suppkey") % 3).alias("sector"))
    return rounded(alerts.check_rules(_moved(spark, sf), sectors, reference.funds(spark, ("S1", "S2")),
                                      20.0, 50.0, 5.0))


@query("account_changes", with_views(f"""SELECT portfolio_id, {r('equity', 2)} AS equity,
    {r('(equity / before - 1) * 100')} AS day_pct, {r('(equity / first_ - 1) * 100')} AS period_pct FROM (
    SELECT o_custkey AS portfolio_id, o_totalprice AS equity, lag(o_totalprice) OVER w AS before,
    first(o_totalprice) OVER w AS first_, lead(o_orderkey) OVER w AS nxt FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) t WHERE nxt IS NULL"""))
def account_changes(spark, sf):
    # an order is one equity reading; its key keeps readings of one day apart
    raw = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("portfolio_id"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000000 + F.col("o_orderkey")).alias("ts"),
        F.col("o_totalprice").alias("equity"))
    return rounded(alerts.account_changes(raw.where(F.col("equity") > 0)), equity=2)


@query("equity_history", """SELECT o_custkey AS portfolio_id, o_orderdate AS ts, o_totalprice AS equity
    FROM orders WHERE o_totalprice > 1000""")
def equity_history(spark, sf):
    raw = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("portfolio_id"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"),
        F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("equity"))
    return market.equity_history(raw).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("newest_decisions", """SELECT o_custkey AS portfolio_id, o_orderpriority AS symbol, o_orderdate AS time
    FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)""")
def newest_decisions(spark, sf):
    log = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("portfolio_id"), F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias("time"))
    return accounts.newest_run(log).select("portfolio_id", "symbol", "time")
