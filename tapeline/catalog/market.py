"""Prices, backtests, risk and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.catalog import query, r, rounded
from tapeline.catalog import views as v
from tapeline.catalog.views import with_views
from tapeline.functions import fixed
from tapeline.operators import backtest as bt, correlation as co, prices as px, ranking, risk
from tapeline.operators import significance as sig
from tapeline.operators.portfolio import basket_stats, symbol_years, year_pairs
from tapeline.sources import market

D = "CAST({} AS DOUBLE)"
W = "WINDOW w AS (PARTITION BY symbol ORDER BY day)"


def returns_sql(source: str) -> str:
    return f"""SELECT symbol, day, r FROM (SELECT symbol, day, close / lag(close) OVER w - 1 AS r
        FROM {source} {W}) t WHERE r IS NOT NULL"""


def complete_sql(source: str) -> str:
    return f"""SELECT symbol, day, close FROM {source} WHERE day IN (SELECT day FROM {source} GROUP BY day
        HAVING count(*) = (SELECT count(DISTINCT symbol) FROM {source}))"""


def full_sql(aggregate: str, value: str, rows: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY day ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) OVER {frame} = {rows} THEN {aggregate}({value}) OVER {frame} END"


def ahead_sql(aggregate: str, value: str, rows: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {rows} FOLLOWING)"
    return f"CASE WHEN count({value}) OVER {frame} = {rows} THEN {aggregate}({value}) OVER {frame} END"


def rule_steps(source: str, n: int, cost: float) -> dict[str, str]:
    """CTEs of the moving-average backtest."""
    return {
        "ma": f"SELECT symbol, day, close, {full_sql('avg', 'close', n)} AS average FROM {source}",
        "held": f"""SELECT *, coalesce(lag(coalesce(close > average, false)) OVER w, false) AS in_market,
            coalesce(close / lag(close) OVER w - 1, {D.format(0)}) AS r FROM ma {W}""",
        "switching": f"""SELECT *, in_market <> coalesce(lag(in_market) OVER w, false) AS switched
            FROM held {W}""",
        "tested": f"""SELECT *, CASE WHEN in_market THEN r ELSE {D.format(0)} END
            - CASE WHEN switched THEN {D.format(cost)} ELSE {D.format(0)} END AS strategy_r FROM switching""",
    }


def ewma_sql(source: str, part: str = "symbol") -> str:
    """Rows of `source` with EWMA volatility, by the closed form."""
    return f"""SELECT * EXCLUDE (rn), sqrt(252 * pow({D.format(0.94)}, rn) * sum(
        CASE WHEN rn = 0 THEN {D.format(1)} ELSE 1 - {D.format(0.94)} END * r * r
        * pow({D.format(0.94)}, -rn)) OVER (PARTITION BY {part} ORDER BY day)) * 100 AS ewma
        FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY day) - 1 AS rn FROM {source}) t"""


BOARD = """SELECT symbol, {hold} AS hold_100, {rule} AS rule_100, {hdd} AS hold_drop_pct,
    {rdd} AS rule_drop_pct, count(*) FILTER (WHERE switched) AS switches,
    {share} AS in_market_pct, count(*) AS days, CASE WHEN max(b) > max(a) THEN 'rule' ELSE 'hold' END AS winner
    FROM drops GROUP BY symbol"""


def board_steps(source: str, n: int) -> dict[str, str]:
    return {**rule_steps(source, n, 0.001),
            "paths": f"""SELECT *, product(1 + r) OVER w AS h, product(1 + strategy_r) OVER w AS s,
                product(1 + r) OVER a AS a, product(1 + strategy_r) OVER a AS b FROM tested
                WINDOW w AS (PARTITION BY symbol ORDER BY day), a AS (PARTITION BY symbol)""",
            "drops": """SELECT *, h / max(h) OVER w - 1 AS hd, s / max(s) OVER w - 1 AS sd FROM paths
                WINDOW w AS (PARTITION BY symbol ORDER BY day)"""}


def _board_sql(source: str, n: int, view: str, log: bool) -> str:
    grown = (lambda c: r(f"ln(max({c}))")) if log else (lambda c: r(f"100 * max({c})"))
    return with_views(BOARD.format(hold=grown("a"), rule=grown("b"), hdd=r("100 * min(hd)"),
                                   rdd=r("100 * min(sd)"),
                                   share=r("avg(CAST(in_market AS DOUBLE)) * 100")),
                      view, **board_steps(source, n))


def _logged(board):
    return (board.withColumn("hold_100", F.log(F.col("hold_100") / 100.0))
            .withColumn("rule_100", F.log(F.col("rule_100") / 100.0)))


@query("trend_leaderboard", _board_sql("bars", 5, "bars", True))
def trend_leaderboard(spark, sf):
    """Flagship: trades to daily bars to the moving-average rule to a leaderboard."""
    return rounded(_logged(bt.leaderboard(v.event_bars(spark, sf).select("symbol", "day", "close"), 5)))


@query("supplier_leaderboard", _board_sql("supplier_closes", 50, "supplier_closes", True))
def supplier_leaderboard(spark, sf):
    return rounded(_logged(bt.leaderboard(v.supplier_closes(spark, sf), 50)))


@query("daily_bars", with_views(f"""SELECT symbol, day, {r('open', 2)} AS open, {r('high', 2)} AS high,
    {r('low', 2)} AS low, {r('close', 2)} AS close, {r('volume')} AS volume FROM bars""", "bars"))
def daily_bars(spark, sf):
    return rounded(market.bars_view(v.event_bars(spark, sf)))


@query("daily_moves", with_views(f"""SELECT symbol, day, {r('move_pct')} AS move_pct,
    {r('abs(move_pct)')} AS size_pct, {r('lead(move_pct) OVER w')} AS next_move_pct,
    {r('100 * close / first(close) OVER w')} AS rebased FROM (SELECT symbol, day, close,
    (close / lag(close) OVER w - 1) * 100 AS move_pct FROM supplier_closes {W}) t {W}""", "supplier_closes"))
def daily_moves(spark, sf):
    return rounded(px.rebase(px.moves(v.supplier_closes(spark, sf))).drop("close"))


@query("complete_day_returns", with_views(f"SELECT symbol, day, {r('r')} AS r FROM steps", "order_closes",
       complete=complete_sql("order_closes"), steps=returns_sql("complete")))
def complete_day_returns(spark, sf):
    return rounded(px.complete_returns(v.order_closes(spark, sf)))


@query("gap_grid", with_views(f"""SELECT s.symbol, d.day, {r('c.close')} AS close
    FROM (SELECT DISTINCT day FROM order_closes) d CROSS JOIN (SELECT DISTINCT symbol FROM order_closes) s
    LEFT JOIN order_closes c ON c.symbol = s.symbol AND c.day = d.day""", "order_closes"))
def gap_grid(spark, sf):
    return rounded(px.gap_grid(v.order_closes(spark, sf)))


@query("wide_closes", with_views("SELECT day, " + ", ".join(
    r(f"max(close) FILTER (WHERE symbol = '{s}')") + f" AS {s}" for s in v.EVENT_TYPES) + " FROM bars GROUP BY day", "bars"))
def wide_closes(spark, sf):
    return rounded(px.wide(v.event_bars(spark, sf), v.EVENT_TYPES))


@query("wide_to_long", with_views(f"SELECT day, symbol, {r('close')} AS close FROM bars", "bars"))
def wide_to_long(spark, sf):
    return rounded(px.long(px.wide(v.event_bars(spark, sf), v.EVENT_TYPES), v.EVENT_TYPES))


LOCAL = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"


@query("latest_session_minutes", with_views(f"""SELECT symbol, minute_ts, local_ts, {r('open')} AS open,
    {r('close')} AS close, {r('volume')} AS volume FROM regular
    WHERE CAST(local_ts AS DATE) = last_session""", "trades",
    minutes="""SELECT symbol, date_trunc('minute', ts) AS ts, first(price ORDER BY ts, trade_id) AS open,
        last(price ORDER BY ts, trade_id) AS close, sum(size) AS volume FROM trades GROUP BY 1, 2""",
    regular=f"""SELECT symbol, ts AS minute_ts, {LOCAL} AS local_ts, open, close, volume,
        max(CAST({LOCAL} AS DATE)) OVER (PARTITION BY symbol) AS last_session FROM minutes
        WHERE strftime({LOCAL}, '%H:%M') BETWEEN '09:30' AND '15:59'"""))
def latest_session_minutes(spark, sf):
    minutes = px.trade_bars(v.trades(spark, sf), F.date_trunc("minute", "ts").cast("timestamp_ntz"), "ts")
    last = market.latest_session(minutes)
    return rounded(last.select("symbol", F.col("ts").alias("minute_ts"), "local_ts", "open", "close",
                               "volume"))


@query("latest_trade", with_views("""SELECT symbol, ts, price, size FROM (SELECT *, row_number() OVER
    (PARTITION BY symbol ORDER BY ts DESC, trade_id DESC) AS k FROM trades) t WHERE k = 1""", "trades"))
def latest_trade(spark, sf):
    return market.latest_trade(v.trades(spark, sf))


@query("session_summary", with_views(f"""SELECT symbol, trades, {r('shares')} AS shares, first_price,
    last_price, low, high, {r('(last_price / first_price - 1) * 100')} AS change_pct FROM (
    SELECT symbol, count(*) AS trades, sum(size) AS shares, first(price ORDER BY ts, trade_id) AS first_price,
    last(price ORDER BY ts, trade_id) AS last_price, min(price) AS low, max(price) AS high
    FROM trades GROUP BY symbol) t""", "trades"))
def session_summary(spark, sf):
    return rounded(px.session_summary(v.trades(spark, sf)))


@query("period_facts", with_views(f"""SELECT symbol, {r('first_close')} AS first_close,
    {r('last_close')} AS last_close, {r('highest')} AS highest, {r('lowest')} AS lowest,
    {r('(last_close / first_close - 1) * 100')} AS change_pct FROM (SELECT symbol,
    first(close ORDER BY day) AS first_close, last(close ORDER BY day) AS last_close,
    max(close) AS highest, min(close) AS lowest FROM supplier_closes GROUP BY symbol) t""", "supplier_closes"))
def period_facts(spark, sf):
    return rounded(px.period_facts(v.supplier_closes(spark, sf), "close", "close"))


@query("history_filter", with_views("""SELECT symbol, count(close) AS days, count(close) >= 600 AS usable
    FROM supplier_closes GROUP BY symbol""", "supplier_closes"))
def history_filter(spark, sf):
    return rounded(px.with_history(v.supplier_closes(spark, sf), 600))


@query("recent_moves", with_views(f"""SELECT symbol, day, {r('close')} AS close,
    {r('(close / prev - 1) * 100')} AS day_pct, {r('(close / base - 1) * 100')} AS month_pct FROM (
    SELECT symbol, day, close, lag(close) OVER w AS prev,
    coalesce(lag(close, 21) OVER w, first(close) OVER w) AS base, lead(day) OVER w AS nxt
    FROM supplier_closes {W}) t WHERE nxt IS NULL AND prev IS NOT NULL""", "supplier_closes"))
def recent_moves(spark, sf):
    return rounded(px.recent_moves(v.supplier_closes(spark, sf)))


@query("change_over_rows", with_views(f"""SELECT symbol, {r('close / base - 1')} AS change FROM (
    SELECT symbol, close, lag(close, 63) OVER w AS base, lead(day) OVER w AS nxt FROM supplier_closes {W}) t
    WHERE nxt IS NULL AND base IS NOT NULL""", "supplier_closes"))
def change_over_rows(spark, sf):
    return rounded(px.change_over_rows(v.supplier_closes(spark, sf), 63))


@query("finished_bars", with_views(f"""SELECT symbol, max(day) AS day, count(*) AS days FROM bars
    WHERE day <> DATE '2024-01-30' GROUP BY symbol""", "bars"))
def finished_bars(spark, sf):
    done = px.finished_bars(v.event_bars(spark, sf), True, "2024-01-30")
    return done.groupBy("symbol").agg(F.max("day").alias("day"), F.count(F.lit(1)).alias("days"))


_RULE_ROWS = f"""SELECT symbol, day, {r('average')} AS average, in_market, switched, {r('r')} AS r,
    {r('strategy_r')} AS strategy_r FROM tested"""


@query("moving_average_backtest", with_views(_RULE_ROWS, "supplier_closes",
                                             **rule_steps("supplier_closes", 20, 0.001)))
def moving_average_backtest(spark, sf):
    return rounded(bt.backtest(v.supplier_closes(spark, sf), 20).drop("close"))


def _warm_steps():
    steps = rule_steps("supplier_closes", 20, 0.0)
    steps["held"] = steps["held"].replace("FROM ma", "FROM (SELECT * FROM ma WHERE average IS NOT NULL) m")
    return steps


@query("backtest_after_warmup", with_views(_RULE_ROWS, "supplier_closes", **_warm_steps()))
def backtest_after_warmup(spark, sf):
    return rounded(bt.backtest(v.supplier_closes(spark, sf), 20, 0.0, drop_warmup=True).drop("close"))


@query("growth_paths", with_views(f"""SELECT symbol, day, {r('ln(g)')} AS log_growth,
    {r('100 * (g / max(g) OVER w - 1)')} AS drawdown_pct FROM (SELECT symbol, day,
    product(1 + r) OVER w AS g FROM steps {W}) t {W}""", "supplier_closes", steps=returns_sql("supplier_closes")))
def growth_paths(spark, sf):
    rows = px.daily_returns(v.supplier_closes(spark, sf)).where(F.col("r").isNotNull())
    path = bt.with_drawdown(bt.growth_path(rows))
    return rounded(path.select("symbol", "day", F.log(F.col("growth") / 100.0).alias("log_growth"),
                               "drawdown_pct"))


@query("cost_effect", with_views(f"""SELECT symbol,
    {r("ln(product(1 + CASE WHEN in_market THEN r ELSE 0 END))")} AS without_costs,
    {r("ln(product(1 + strategy_r))")} AS with_costs FROM (SELECT *, row_number() OVER
    (PARTITION BY symbol ORDER BY day) - 1 AS rn FROM tested) t WHERE rn >= 100 GROUP BY symbol""",
    "supplier_closes", **rule_steps("supplier_closes", 50, 0.001)))
def cost_effect(spark, sf):
    out = bt.cost_effect(v.supplier_closes(spark, sf), 50, 100)
    return rounded(out.select("symbol", *[F.log(F.col(c) / 100.0).alias(c)
                                          for c in ("without_costs", "with_costs")]))


def _split_sql(source: str, skip: int) -> str:
    return f"""SELECT *, CASE WHEN rn < {skip} THEN NULL WHEN rn < {skip} + floor((n - {skip}) * 2 / 3)
        THEN 'train' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER w - 1 AS rn,
        count(*) OVER (PARTITION BY symbol) AS n FROM {source} {W}) t"""


def _sweep_steps(skip: int) -> dict[str, str]:
    one = " UNION ALL ".join(
        f"SELECT symbol, day, close, {n} AS ma_rows, {full_sql('avg', 'close', n)} AS average"
        f" FROM supplier_closes" for n in fixed.SWEEP_WINDOWS)
    w = "WINDOW w AS (PARTITION BY symbol, ma_rows ORDER BY day)"
    return {
        "ma": one,
        "held": f"""SELECT *, coalesce(lag(coalesce(close > average, false)) OVER w, false) AS in_market,
            coalesce(close / lag(close) OVER w - 1, {D.format(0)}) AS r FROM ma {w}""",
        "tested": f"""SELECT *, CASE WHEN in_market THEN r ELSE {D.format(0)} END
            - CASE WHEN in_market <> coalesce(lag(in_market) OVER w, false) THEN {D.format(0.001)}
            ELSE {D.format(0)} END AS strategy_r, row_number() OVER w - 1 AS rn,
            count(*) OVER (PARTITION BY symbol, ma_rows) AS n FROM held {w}""",
        "labelled": f"""SELECT *, CASE WHEN rn < {skip} THEN NULL WHEN rn < {skip}
            + floor((n - {skip}) * 2 / 3) THEN 'train' ELSE 'test' END AS split FROM tested""",
        "swept": """SELECT symbol, ma_rows, 100 * product(1 + strategy_r) FILTER (WHERE split = 'train')
            AS train_100, 100 * product(1 + strategy_r) FILTER (WHERE split = 'test') AS test_100
            FROM labelled WHERE split IS NOT NULL GROUP BY symbol, ma_rows""",
        "hold": """SELECT symbol, 100 * product(1 + r) FILTER (WHERE split = 'train') AS hold_train_100,
            100 * product(1 + r) FILTER (WHERE split = 'test') AS hold_test_100
            FROM labelled WHERE ma_rows = 10 GROUP BY symbol""",
    }


@query("parameter_sweep", with_views(f"""SELECT symbol, CAST(ma_rows AS BIGINT) AS ma_rows,
    {r('ln(train_100)')} AS train_100, {r('ln(test_100)')} AS test_100 FROM swept""",
    "supplier_closes", **_sweep_steps(200)))
def parameter_sweep(spark, sf):
    out = bt.sweep(v.supplier_closes(spark, sf))
    return rounded(out.withColumns({c: F.log(F.col(c)) for c in ("train_100", "test_100")}))


@query("hold_by_split", with_views(f"""SELECT symbol, {r('ln(hold_train_100)')} AS hold_train_100,
    {r('ln(hold_test_100)')} AS hold_test_100 FROM hold""", "supplier_closes", **_sweep_steps(200)))
def hold_by_split(spark, sf):
    out = bt.hold_by_split(v.supplier_closes(spark, sf))
    return rounded(out.withColumns({c: F.log(F.col(c)) for c in ("hold_train_100", "hold_test_100")}))


@query("sweep_best_setting", with_views(f"""SELECT symbol, CAST(ma_rows AS BIGINT) AS best_ma_rows,
    {r('ln(train_100)')} AS best_train_100, {r('ln(test_100)')} AS best_test_100,
    CAST(floor(test_rank) AS BIGINT) AS test_rank, beating AS settings_beating_hold, settings FROM ranked
    WHERE pick = 1""", "supplier_closes", **_sweep_steps(200),
    levels="SELECT *, round(ln(train_100 / 100), 9) AS tr, round(ln(test_100 / 100), 9) AS te FROM swept",
    ranked="""SELECT s.*, rank() OVER (PARTITION BY s.symbol ORDER BY te DESC)
        + (count(*) OVER (PARTITION BY s.symbol, te) - 1) / CAST(2 AS DOUBLE) AS test_rank,
        count(*) FILTER (WHERE te > round(ln(hold_test_100 / 100), 9)) OVER (PARTITION BY s.symbol) AS beating,
        count(*) OVER (PARTITION BY s.symbol) AS settings,
        row_number() OVER (PARTITION BY s.symbol ORDER BY tr DESC, ma_rows) AS pick
        FROM levels s JOIN hold h ON h.symbol = s.symbol"""))
def sweep_best_setting(spark, sf):
    closes = v.supplier_closes(spark, sf)
    out = bt.best_setting(bt.sweep(closes), bt.hold_by_split(closes))
    return rounded(out.withColumns({c: F.log(F.col(c)) for c in ("best_train_100", "best_test_100")}))


@query("latest_signal", with_views(f"""SELECT symbol, days, {r('close')} AS price, {r('average')} AS average,
    coalesce(close > average, false) AS own FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS days,
    row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM ma) t WHERE k = 1""",
    "supplier_closes", ma=rule_steps("supplier_closes", 50, 0)["ma"]))
def latest_signal(spark, sf):
    return rounded(bt.latest_signal(v.supplier_closes(spark, sf), 50))


# --- risk -------------------------------------------------------------------------------------

def _vol_sql(n: int) -> str:
    return f"{full_sql('stddev_samp', 'r', n)} * sqrt({D.format(252)}) * 100"


_FORECASTS = {"steps": returns_sql("supplier_closes"), "smoothed": ewma_sql("steps"),
              "made": f"""SELECT symbol, day, r, ewma, {_vol_sql(21)} AS vol_last_month,
                  {_vol_sql(63)} AS vol_3_months, {_vol_sql(252)} AS vol_1_year,
                  {ahead_sql('stddev_samp', 'r', 21)} * sqrt({D.format(252)}) * 100 AS actual
                  FROM smoothed"""}
_PAIRS = {**_FORECASTS,
          "checked": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS rn,
              count(*) OVER (PARTITION BY symbol) AS n FROM made) t
              WHERE rn >= 252 AND (rn - 252) % 21 = 0 AND rn < n - 21""",
          "pairs": """SELECT symbol, day, method, forecast, actual FROM (
              SELECT symbol, day, actual, 'EWMA' AS method, ewma AS forecast FROM checked
              UNION ALL SELECT symbol, day, actual, 'last month', vol_last_month FROM checked
              UNION ALL SELECT symbol, day, actual, '3 months', vol_3_months FROM checked
              UNION ALL SELECT symbol, day, actual, '1 year', vol_1_year FROM checked) t
              WHERE forecast IS NOT NULL AND actual IS NOT NULL"""}


def _returns(spark, sf):
    return (px.daily_returns(v.supplier_closes(spark, sf)).where(F.col("r").isNotNull())
            .select("symbol", "day", "r"))


@query("volatility_forecasts", with_views(f"""SELECT symbol, day, {r('r')} AS r, {r('ewma')} AS ewma,
    {r('vol_last_month')} AS vol_last_month, {r('vol_3_months')} AS vol_3_months,
    {r('vol_1_year')} AS vol_1_year FROM made""", "supplier_closes", **_FORECASTS))
def volatility_forecasts(spark, sf):
    return rounded(risk.volatility_forecasts(_returns(spark, sf)))


@query("forecast_pairs", with_views(f"""SELECT symbol, day, method, {r('forecast')} AS forecast,
    {r('actual')} AS actual FROM pairs""", "supplier_closes", **_PAIRS))
def forecast_pairs(spark, sf):
    return rounded(risk.forecast_pairs(_returns(spark, sf)))


@query("forecast_evaluation", with_views(f"""SELECT method, {r('avg(abs(forecast - actual))')} AS avg_error_pts,
    {r('corr(ra, rb)')} AS rank_corr, count(*) AS checks FROM (SELECT *,
    rank() OVER (PARTITION BY method ORDER BY forecast)
        + (count(*) OVER (PARTITION BY method, forecast) - 1) / CAST(2 AS DOUBLE) AS ra,
    rank() OVER (PARTITION BY method ORDER BY actual)
        + (count(*) OVER (PARTITION BY method, actual) - 1) / CAST(2 AS DOUBLE) AS rb FROM pairs) t
    GROUP BY method""", "supplier_closes", **_PAIRS))
def forecast_evaluation(spark, sf):
    return rounded(risk.evaluate_forecasts(_returns(spark, sf)))


@query("return_persistence", with_views(f"""SELECT {r('corr(ra, rb)')} AS rank_corr, count(*) AS checks FROM (
    SELECT rank() OVER (ORDER BY past) + (count(*) OVER (PARTITION BY past) - 1) / CAST(2 AS DOUBLE) AS ra,
    rank() OVER (ORDER BY future) + (count(*) OVER (PARTITION BY future) - 1) / CAST(2 AS DOUBLE) AS rb
    FROM checked) t""", "supplier_closes", steps=returns_sql("supplier_closes"),
    sums=f"""SELECT symbol, day, {full_sql('sum', 'r', 21)} AS past, {ahead_sql('sum', 'r', 21)} AS future,
        row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS rn,
        count(*) OVER (PARTITION BY symbol) AS n FROM steps""",
    checked="""SELECT * FROM sums WHERE rn >= 252 AND (rn - 252) % 21 = 0 AND rn < n - 21
        AND past IS NOT NULL AND future IS NOT NULL"""))
def return_persistence(spark, sf):
    return rounded(risk.return_persistence(_returns(spark, sf)))


@query("top_performers", with_views(f"""SELECT symbol, {r('(close / base - 1) * 100')} AS return_pct,
    {r('vol')} AS volatility_pct, {r(f"vol / sqrt({D.format(12)})")} AS typical_pct,
    {r(f"-{D.format(1.65)} * vol / sqrt({D.format(12)})")} AS bad_pct FROM (SELECT s.*,
    coalesce({_vol_sql(63)}, ewma) AS vol, lead(s.day) OVER w AS nxt FROM smoothed s {W}) t
    WHERE nxt IS NULL AND base IS NOT NULL""", "supplier_closes",
    steps=f"""SELECT * FROM (SELECT symbol, day, close, close / lag(close) OVER w - 1 AS r,
        lag(close, 252) OVER w AS base FROM supplier_closes {W}) t WHERE r IS NOT NULL""",
    smoothed=ewma_sql("steps")))
def top_performers(spark, sf):
    return rounded(risk.top_performers(v.supplier_closes(spark, sf), fixed.PERIODS["1 year"]))


_YEARS = {"steps": returns_sql("supplier_closes"),
          "paths": """SELECT symbol, year(day) AS year, day, r, product(1 + r) OVER w AS g FROM steps
              WINDOW w AS (PARTITION BY symbol, year(day) ORDER BY day)""",
          "years": f"""SELECT symbol, year, stddev_samp(r) * sqrt({D.format(252)}) * 100 AS volatility_pct,
              sum(ln(1 + r)) AS log_return, count(*) AS days FROM paths GROUP BY symbol, year"""}


@query("year_rank_correlation", with_views(f"""SELECT CAST(year AS BIGINT) AS year, {r('corr(ra, rb)')} AS rank_corr, count(*) AS checks
    FROM (SELECT a.year, rank() OVER (PARTITION BY a.year ORDER BY a.volatility_pct)
    + (count(*) OVER (PARTITION BY a.year, a.volatility_pct) - 1) / CAST(2 AS DOUBLE) AS ra,
    rank() OVER (PARTITION BY a.year ORDER BY b.volatility_pct)
    + (count(*) OVER (PARTITION BY a.year, b.volatility_pct) - 1) / CAST(2 AS DOUBLE) AS rb
    FROM years a JOIN years b ON b.symbol = a.symbol AND b.year = a.year + 1
    WHERE a.volatility_pct IS NOT NULL AND b.volatility_pct IS NOT NULL) t GROUP BY year""",
    "supplier_closes", **_YEARS))
def year_rank_correlation(spark, sf):
    pairs = year_pairs(symbol_years(_returns(spark, sf)), "volatility_pct")
    return rounded(ranking.spearman(pairs, "this", "next", ["year"]))


# --- correlation and baskets --------------------------------------------------------------------

_CORR = {"steps": returns_sql("supplier_closes"),
         "pairs": """SELECT a.symbol AS sym_a, b.symbol AS sym_b, corr(a.r, b.r) AS corr, count(*) AS n_days
             FROM steps a JOIN steps b ON a.day = b.day AND a.symbol < b.symbol GROUP BY 1, 2"""}


@query("correlation_pairs", with_views(f"""SELECT sym_a, sym_b, {r('corr')} AS corr, n_days
    FROM pairs""", "supplier_closes", **_CORR))
def correlation_pairs(spark, sf):
    return rounded(co.correlation_pairs(_returns(spark, sf)))


@query("covariance_pairs", with_views(f"""SELECT a.symbol AS sym_a, b.symbol AS sym_b, {r('covar_samp(a.r, b.r)', 8)} AS cov,
    count(*) AS n_days FROM ret a JOIN ret b ON a.day = b.day AND a.symbol <= b.symbol
    GROUP BY 1, 2 HAVING count(*) > 1""", "supplier_closes",
    ret="""SELECT * FROM (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS r
        FROM supplier_closes) t WHERE r IS NOT NULL"""))
def covariance_pairs(spark, sf):
    return rounded(co.covariance_pairs(_returns(spark, sf)), cov=8)


_COMPLETE_PAIRS = {"complete": complete_sql("order_closes"), "steps": returns_sql("complete"),
                   "pairs": _CORR["pairs"]}


@query("close_pairs", with_views(f"""SELECT sym_a, sym_b, {r('corr')} AS corr, n_days FROM pairs
    WHERE corr > CAST(0.02 AS DOUBLE)""", "order_closes", **_COMPLETE_PAIRS))
def close_pairs(spark, sf):
    return rounded(co.pairs_above(px.complete_returns(v.order_closes(spark, sf)), 0.02))


@query("close_supplier_pairs", with_views(f"""SELECT sym_a, sym_b, {r('corr')} AS corr, n_days FROM pairs
    WHERE corr > CAST(0.7 AS DOUBLE)""", "supplier_closes", **_CORR))
def close_supplier_pairs(spark, sf):
    return rounded(co.pairs_above(_returns(spark, sf), 0.7))


@query("sector_correlations", with_views(f"""SELECT sa.n_regionkey = sb.n_regionkey AS same_sector,
    {r('avg(corr)')} AS mean_corr, count(*) AS pairs FROM pairs
    JOIN sectors sa ON sa.symbol = sym_a JOIN sectors sb ON sb.symbol = sym_b WHERE corr IS NOT NULL
    GROUP BY 1""", "supplier_closes", **_CORR,
    sectors="""SELECT 'S' || s_suppkey AS symbol, n_regionkey FROM supplier
        JOIN nation ON n_nationkey = s_nationkey"""))
def sector_correlations(spark, sf):
    sectors = (v.table(spark, sf, "supplier").join(v.table(spark, sf, "nation"),
                                                   F.col("n_nationkey") == F.col("s_nationkey"))
               .select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"),
                       F.col("n_regionkey").alias("sector")))
    return rounded(co.sector_correlations(_returns(spark, sf), sectors))


_PATH_STATS = f"""{r('ln(product(1 + r))')} AS grown_100,
    {r(f"stddev_samp(r) * sqrt({D.format(252)}) * 100")} AS volatility_pct,
    {r('100 * min(g / p - 1)')} AS biggest_drop_pct, count(*) AS days"""


def path_steps(source: str, keys: str) -> dict[str, str]:
    """CTEs giving each series its growth path and peak."""
    return {"grown": f"""SELECT *, product(1 + r) OVER w AS g FROM {source}
                WINDOW w AS (PARTITION BY {keys} ORDER BY day)""",
            "peaked": f"""SELECT *, max(g) OVER w AS p FROM grown
                WINDOW w AS (PARTITION BY {keys} ORDER BY day)"""}


@query("basket_comparison", with_views(f"SELECT basket, {_PATH_STATS} FROM peaked GROUP BY basket",
    "supplier_closes", steps=returns_sql("supplier_closes"),
    members="SELECT 'nation ' || s_nationkey AS basket, 'S' || s_suppkey AS symbol FROM supplier",
    daily="""SELECT basket, day, avg(r) AS r FROM members JOIN steps USING (symbol) GROUP BY basket, day""",
    **path_steps("daily", "basket")))
def basket_comparison(spark, sf):
    baskets = v.table(spark, sf, "supplier").select(
        F.concat(F.lit("nation "), F.col("s_nationkey")).alias("basket"),
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"))
    out = basket_stats(_returns(spark, sf), baskets)
    return rounded(out.withColumn("grown_100", F.log(F.col("grown_100") / 100.0)))


_SIZES = [1, 2, 5, 10, 20]
_RANDOM = {
    "steps": f"SELECT * FROM ({returns_sql('supplier_closes')}) t WHERE r IS NOT NULL",
    "names": """SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS pos, count(*) OVER () AS n
        FROM (SELECT DISTINCT symbol FROM supplier_closes) u""",
    "walk": f"""SELECT size, sample, 0 AS i, least(size, n) AS k, n, CAST([] AS BIGINT[]) AS taken
        FROM (SELECT unnest({_SIZES}) AS size) s CROSS JOIN (SELECT unnest(generate_series(0, 1999)) AS sample) m
        CROSS JOIN (SELECT max(n) AS n FROM names) c
        UNION ALL SELECT size, sample, i + 1, k, n, list_append(taken, CASE WHEN list_contains(taken, drawn)
            THEN n - k + i ELSE drawn END)
        FROM (SELECT *, CAST('0x' || substr(md5(concat_ws('#', '0', size, sample, i)), 1, 13) AS BIGINT) % (n - k + i + 1)
              AS drawn FROM walk WHERE i < k) w""",
    "picks": """SELECT size, sample, symbol FROM (SELECT size, sample, unnest(taken) AS pos FROM walk WHERE i = k) t
        JOIN names USING (pos)""",
    "daily": """SELECT size, sample, day, avg(r) AS r FROM picks JOIN steps USING (symbol)
        GROUP BY size, sample, day""",
    **path_steps("daily", "size, sample"),
    "stats": f"""SELECT size, sample, (product(1 + r) - 1) * 100 AS return_pct,
        stddev_samp(r) * sqrt({D.format(252)}) * 100 AS volatility_pct,
        100 * min(g / p - 1) AS biggest_drop_pct FROM peaked GROUP BY size, sample"""}


def _random_stats(spark, sf):
    picks = sig.random_portfolios(v.supplier_closes(spark, sf).select("symbol"), _SIZES, 2000)
    return sig.random_portfolio_stats(_returns(spark, sf), picks)


def _random_sql(body: str) -> str:
    return with_views(body, "supplier_closes", **_RANDOM).replace("WITH ", "WITH RECURSIVE ", 1)


@query("random_portfolios", _random_sql(f"""SELECT CAST(size AS BIGINT) AS size,
    {r('median(volatility_pct)')} AS typical_volatility, {r('median(biggest_drop_pct)')} AS typical_drop,
    {r('min(biggest_drop_pct)')} AS worst_drop, {r('ln(1 + median(return_pct) / 100)')} AS typical_return,
    {r('ln(1 + min(return_pct) / 100)')} AS worst_return FROM stats GROUP BY size"""))
def random_portfolios(spark, sf):
    out = sig.diversification(_random_stats(spark, sf))     # growth over 2 400 wild days: compared by its log
    return rounded(out.withColumns({c: F.log1p(F.col(c) / 100.0) for c in ("typical_return", "worst_return")}))


@query("random_portfolio_quartiles", _random_sql(f"""SELECT CAST(size AS BIGINT) AS size,
    {r('quantile_cont(volatility_pct, 0.25)')} AS q25, {r('quantile_cont(volatility_pct, 0.5)')} AS q50,
    {r('quantile_cont(volatility_pct, 0.75)')} AS q75 FROM stats GROUP BY size"""))
def random_portfolio_quartiles(spark, sf):
    return rounded(sig.box_stats(_random_stats(spark, sf)))
