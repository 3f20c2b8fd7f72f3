"""Report tables, and round trips of scans and sinks through the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeline import schema
from tapeline.catalog import QUERIES, SQL, query, r, rounded, views as v
from tapeline.catalog.market import D, W, _CORR, _YEARS, ewma_sql, full_sql, ahead_sql, path_steps, returns_sql
from tapeline.catalog.portfolios import _MOVED
from tapeline.catalog.stories import _PROBS, _judged, _reader_holdings, _scored_docs
from tapeline.catalog.views import with_views
from tapeline.functions import finance, fixed
from tapeline.operators import backtest as bt, correlation as co, portfolio as pf, prices as px, risk, scoring as sc
from tapeline.plans.digest import digest as daily_digest, digest_lines, market_overview as overview
from tapeline.session import shared_dir
from tapeline.sources import accounts, market, reference, sinks, stories as st


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return px.daily_returns(v.supplier_closes(spark, sf)).where(F.col("r").isNotNull())


# --- reports ------------------------------------------------------------------------------------

@query("describe_symbols", with_views(f"""SELECT symbol, {r('ln(arg_max(g, day))')} AS log_growth,
    {r('stddev_samp(r) * 100')} AS daily_std_pct, {r('100 * min(g / p - 1)')} AS biggest_drop_pct, count(*) AS days
    FROM peaked GROUP BY symbol""", "supplier_closes", steps=returns_sql("supplier_closes"), **path_steps("steps", "symbol")))
def describe_symbols(spark, sf):
    """The final sum and the return are one number; it is compared by its log."""
    out = bt.describe(v.supplier_closes(spark, sf))
    return rounded(out.select("symbol", F.log1p(F.col("return_pct") / 100.0).alias("log_growth"), "daily_std_pct", "biggest_drop_pct", "days"))


_TOP = SQL["top_performers"]


@query("best_and_worst_performers", f"""WITH t AS ({_TOP}),
    p AS (SELECT *, row_number() OVER (ORDER BY return_pct DESC NULLS LAST, symbol) AS up,
          row_number() OVER (ORDER BY return_pct NULLS LAST, symbol) AS down FROM t)
    SELECT symbol, return_pct, volatility_pct, typical_pct, bad_pct, 'best' AS "end", up AS place FROM p WHERE up <= 5
    UNION ALL SELECT symbol, return_pct, volatility_pct, typical_pct, bad_pct, 'worst', down FROM p WHERE down <= 5""")
def best_and_worst_performers(spark, sf):
    return rounded(risk.best_and_worst(QUERIES["top_performers"](spark, sf)))


_BEST = """best AS (SELECT symbol FROM (SELECT symbol, row_number() OVER (ORDER BY return_pct DESC NULLS LAST, symbol) AS up
    FROM top) t WHERE up <= 5)"""


@query("best_performers_rebased", with_views(f"""SELECT symbol, day, {r('close / first_value(close) OVER w * 100')} AS rebased
    FROM supplier_closes JOIN best USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY day)""", "supplier_closes",
    top=_TOP, best=_BEST[len("best AS ("):-1]))
def best_performers_rebased(spark, sf):
    best = risk.best_and_worst(QUERIES["top_performers"](spark, sf)).where("end = 'best'")
    closes = v.supplier_closes(spark, sf).join(best.select("symbol"), "symbol", "left_semi")
    return rounded(px.rebase(closes).select("symbol", "day", "rebased"))


_RANKED = """SELECT a.year, rank() OVER (PARTITION BY a.year ORDER BY a.{0})
    + (count(*) OVER (PARTITION BY a.year, a.{0}) - 1) / CAST(2 AS DOUBLE) AS ra,
    rank() OVER (PARTITION BY a.year ORDER BY b.{0})
    + (count(*) OVER (PARTITION BY a.year, b.{0}) - 1) / CAST(2 AS DOUBLE) AS rb
    FROM rounded_years a JOIN rounded_years b ON b.symbol = a.symbol AND b.year = a.year + 1
    WHERE a.{0} IS NOT NULL AND b.{0} IS NOT NULL"""


@query("rank_persistence_means", with_views(f"""SELECT measure, {r('avg(c)')} AS rank_corr, count(c) AS years FROM (
    SELECT 'volatility_pct' AS measure, year, corr(ra, rb) AS c FROM ({_RANKED.format('volatility_pct')}) v GROUP BY year
    UNION ALL SELECT 'return_log', year, corr(ra, rb) FROM ({_RANKED.format('return_log')}) q GROUP BY year) t
    WHERE NOT isnan(c) GROUP BY measure""", "supplier_closes", **_YEARS,
    rounded_years="SELECT symbol, year, round(volatility_pct, 9) AS volatility_pct, round(log_return, 9) AS return_log FROM years"))
def rank_persistence_means(spark, sf):
    """Ranks are those of the values rounded at nine decimals, so that noise of summation ties."""
    years = pf.symbol_years(_returns(spark, sf))
    years = years.withColumns({"volatility_pct": F.round("volatility_pct", 9),
                               "return_log": F.round(F.log1p(F.col("return_pct") / 100.0), 9)})
    return rounded(pf.mean_rank_persistence(years, ("volatility_pct", "return_log")))


@query("market_overview", f"""SELECT t.*, n_name AS name FROM ({SQL['recent_moves']}) t
    JOIN supplier ON symbol = 'S' || s_suppkey JOIN nation ON n_nationkey = s_nationkey""")
def market_overview(spark, sf):
    names = v.table(spark, sf, "supplier").join(v.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), F.col("n_name").alias("name"))
    return rounded(overview(v.supplier_closes(spark, sf), names))


_DIGEST_SECTORS = "SELECT * FROM (VALUES ('click', 'Web'), ('view', 'Web'), ('purchase', 'Shop')) t(symbol, sector)"
_DIGEST = {
    "supplier_closes": "SELECT symbol, day, close FROM bars",
    "supplier_holdings": "SELECT user_id AS portfolio_id, event_type AS symbol, sum(value) AS value FROM events GROUP BY 1, 2",
    **_MOVED, "sectors": _DIGEST_SECTORS,
    "alerts": """SELECT portfolio_id, 'single stock: ' || symbol AS subject, share_pct AS value FROM moved WHERE symbol <> 'view' AND share_pct > 20
        UNION ALL SELECT portfolio_id, 'daily move: ' || symbol, day_pct FROM moved WHERE abs(day_pct) > 5
        UNION ALL SELECT portfolio_id, 'sector: ' || coalesce(sector, 'Other'), sum(share_pct) FROM moved LEFT JOIN sectors USING (symbol)
            WHERE symbol <> 'view' GROUP BY portfolio_id, coalesce(sector, 'Other') HAVING sum(share_pct) > 50""",
    "headlines": SQL["portfolio_headlines"],
    "weights": """SELECT portfolio_id, symbol, value / sum(value) OVER (PARTITION BY portfolio_id) AS weight,
        count(*) OVER (PARTITION BY portfolio_id) AS n FROM supplier_holdings""",
    "common": """SELECT portfolio_id, day FROM weights JOIN supplier_closes USING (symbol) GROUP BY portfolio_id, day
        HAVING count(*) = max(n)""",
    "steps": """SELECT portfolio_id, symbol, weight, day, close / lag(close) OVER (PARTITION BY portfolio_id, symbol ORDER BY day) - 1 AS r
        FROM weights JOIN supplier_closes USING (symbol) JOIN common USING (portfolio_id, day)""",
    "daily": "SELECT portfolio_id, day, sum(weight * r) AS r FROM steps WHERE r IS NOT NULL GROUP BY 1, 2",
    "smoothed": ewma_sql("daily", "portfolio_id"),
    "mix": "SELECT portfolio_id, arg_max(ewma, day) AS vol FROM smoothed GROUP BY 1",
    "lines": """SELECT portfolio_id, 'alert' AS section, subject, value FROM alerts
        UNION ALL SELECT portfolio_id, 'holding', symbol, day_pct FROM moved
        UNION ALL SELECT portfolio_id, 'day', 'portfolio', sum(day_pct * share_pct) / sum(share_pct) FILTER (WHERE day_pct IS NOT NULL)
            FROM moved GROUP BY portfolio_id
        UNION ALL SELECT NULL, 'market', upper(symbol), day_pct FROM recent
        UNION ALL SELECT portfolio_id, 'headline', symbol || ' ' || url, rank FROM headlines
        UNION ALL SELECT portfolio_id, 'outlook', 'portfolio', vol FROM mix"""}


@query("digest", with_views(f"""SELECT CAST(portfolio_id AS BIGINT) AS portfolio_id, section, subject, {r('value')} AS value FROM lines""",
    "bars", "news", **_DIGEST))
def digest(spark, sf):
    closes = v.event_bars(spark, sf).select("symbol", "day", "close")
    names = closes.select("symbol").distinct().withColumn("name", F.upper("symbol"))
    report = daily_digest(closes, _reader_holdings(spark, sf), v.news(spark, sf), reference.sectors(spark, {"Web": ("click", "view"), "Shop": ("purchase",)}),
                          reference.funds(spark, ("view",)), names, "2024-01-20 00:00:00",
                          {"max_single_pct": 20.0, "max_sector_pct": 50.0, "daily_move_pct": 5.0}, min_days=10)
    return rounded(digest_lines(report))


@query("return_pairs", with_views(f"""SELECT symbol, day, {r('past')} AS past, {r('future')} AS future FROM sums
    WHERE rn >= 252 AND (rn - 252) % 21 = 0 AND rn < n - 21 AND past IS NOT NULL AND future IS NOT NULL""",
    "supplier_closes", steps=returns_sql("supplier_closes"),
    sums=f"""SELECT symbol, day, {full_sql('sum', 'r', 21)} AS past, {ahead_sql('sum', 'r', 21)} AS future,
        row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM steps"""))
def return_pairs(spark, sf):
    return rounded(risk.return_pairs(_returns(spark, sf)))


@query("alike_pairs", with_views(f"""SELECT sym_a, sym_b, {r('corr')} AS corr, n_days, 'most' AS "end" FROM (SELECT * FROM pairs
    WHERE corr IS NOT NULL AND NOT isnan(corr) ORDER BY round(corr, 9) DESC, sym_a, sym_b LIMIT 4) m
    UNION ALL SELECT sym_a, sym_b, {r('corr')}, n_days, 'least' FROM (SELECT * FROM pairs
    WHERE corr IS NOT NULL AND NOT isnan(corr) ORDER BY round(corr, 9), sym_a, sym_b LIMIT 4) l""", "supplier_closes", **_CORR))
def alike_pairs(spark, sf):
    return rounded(co.extreme_pairs(_returns(spark, sf)))


@query("cash_shares", with_views(f"""SELECT portfolio_id, {r('invested')} AS invested, {r('cash')} AS cash,
    {r('cash / (cash + invested) * 100')} AS cash_pct FROM (SELECT portfolio_id, sum(value) AS invested, greatest(any_value(c_acctbal), 0) AS cash
    FROM holdings JOIN customer ON c_custkey = portfolio_id GROUP BY portfolio_id) t""", "holdings"))
def cash_shares(spark, sf):
    cash = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("portfolio_id"), F.greatest("c_acctbal", F.lit(0.0)).alias("cash"))
    return rounded(pf.cash_share(v.holdings(spark, sf), cash))


@query("swing_money", with_views(f"""SELECT portfolio_id, symbol, {r('value * typical_pct / 100')} AS typical_money,
    {r('value * bad_pct / 100')} AS bad_money FROM supplier_holdings JOIN top USING (symbol)""", "supplier_holdings", top=_TOP))
def swing_money(spark, sf):
    return rounded(pf.swing_money(v.supplier_holdings(spark, sf), QUERIES["top_performers"](spark, sf)))


@query("simple_decisions", """SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'P' THEN 'WAIT'
    WHEN own AND held = 0 THEN 'BUY' WHEN NOT own AND held > 0 THEN 'SELL' ELSE 'HOLD' END AS action
    FROM (SELECT *, o_totalprice > 150000 AS own, o_custkey % 3 AS held FROM orders) t""")
def simple_decisions(spark, sf):
    """The bot's variant without STAY OUT, for every order as one entry."""
    action = finance.simple_decision(F.col("o_totalprice") > 150000, F.col("o_custkey") % 3, F.col("o_orderstatus") == "P")
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), action.alias("action"))


# --- words beside labels ------------------------------------------------------------------------

@query("daily_moods_side_by_side", with_views(f"""SELECT day, {r('avg(label_score)')} AS word_mood, {r('avg(judged)')} AS judged_mood,
    count(judged) AS judged_stories, count(*) AS stories FROM (SELECT CAST(n.published AS DATE) AS day,
    CASE l.label WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS label_score,
    CASE j.truth WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 END AS judged
    FROM news n JOIN labelled l USING (doc_id) LEFT JOIN judged j USING (doc_id)) t GROUP BY day""", "news", **_PROBS))
def daily_moods_side_by_side(spark, sf):
    """Every day's mood by words beside the mood by given labels, where there are any."""
    truth = _judged(spark, sf).select("doc_id", sc.label_score(F.col("truth")).alias("judged"))
    words = _scored_docs(spark, sf).select("doc_id", "label_score")
    rows = v.news(spark, sf).select("doc_id", F.to_date("published").alias("day")).join(words, "doc_id").join(truth, "doc_id", "left")
    return rounded(rows.groupBy("day").agg(
        F.avg("label_score").alias("word_mood"), F.avg("judged").alias("judged_mood"),
        F.count("judged").alias("judged_stories"), F.count(F.lit(1)).alias("stories")))


@query("headline_and_article_labels", with_views("""SELECT h.doc_id, h.label AS headline_label, j.truth AS article_label,
    h.label = j.truth AS same FROM labelled h JOIN judged j USING (doc_id)""", **_PROBS))
def headline_and_article_labels(spark, sf):
    headline = _scored_docs(spark, sf).select("doc_id", F.col("label").alias("headline_label"))
    article = _judged(spark, sf).select("doc_id", F.col("truth").alias("article_label"))
    return headline.join(article, "doc_id").withColumn("same", F.col("headline_label") == F.col("article_label"))


@query("score_cache", with_views(f"""SELECT md5(text) AS text_hash, {r('any_value(positive)')} AS positive,
    {r('any_value(negative)')} AS negative, {r('any_value(neutral)')} AS neutral FROM probs GROUP BY text""", **_PROBS))
def score_cache(spark, sf):
    """Scores of labelled texts are the cache; the rest is added to it."""
    docs, scorer = v.table(spark, sf, "documents"), sc.lexicon_scorer(v.GOOD, v.BAD)
    cache = sc.new_scores(docs.join(v.table(spark, sf, "labels"), "doc_id", "left_semi"), None, scorer)
    whole = sc.extended_cache(cache, sc.new_scores(docs, cache, scorer))
    return rounded(whole.select(F.md5("text").alias("text_hash"), *fixed.LABELS))


# --- scans and sinks, written and read again ----------------------------------------------------

@query("stored_closes", with_views(f"""SELECT symbol, day, {r('close')} AS close FROM bars
    WHERE day >= DATE '2024-01-31' - 20""", "bars"))
def stored_closes(spark, sf):
    """Daily bars written and scanned by day and symbol; every symbol trades on every day."""
    last = v.event_bars(spark, sf).select("symbol", "day", "close")
    path = f"{_folder(spark)}/bars"
    last.select("symbol", F.col("day").cast("timestamp").alias("ts"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")],
                F.lit(1.0).alias("volume")).write.parquet(path)
    return rounded(market.daily_closes(spark, path, "2024-01-31", days=20))


@query("holdings_from_csv", with_views(f"""SELECT 7 AS portfolio_id, symbol, name, {r('sum(value)', 2)} AS value,
    {r('sum(profit)', 2)} AS profit FROM holdings GROUP BY symbol, name""", "holdings"))
def holdings_from_csv(spark, sf):
    path = f"{_folder(spark)}/holdings"
    held = v.holdings(spark, sf).groupBy("symbol", "name").agg(F.sum("value").alias("value_eur"), F.sum("profit").alias("profit_eur"))
    sinks.save_csv(held.select("symbol", "name", "value_eur", "profit_eur"), path)
    return rounded(accounts.read_holdings_csv(spark, path, 7), value=2, profit=2)


@query("prices_from_csv", with_views(f"""SELECT symbol, day, {r('close', 4)} AS close, {r('ln(close)', 4)} AS log_close
    FROM order_closes""", "order_closes"))
def prices_from_csv(spark, sf):
    path = f"{_folder(spark)}/prices"
    sinks.save_csv(v.order_closes(spark, sf).select("symbol", "day", "close", F.log("close").alias("log_close")), path)
    return rounded(spark.read.schema("symbol string, day date, close double, log_close double").option("header", True).csv(path), 4)


@query("plan_from_csv", f"""SELECT o_orderpriority AS symbol, {r('round(sum(o_totalprice), 2)', 2)} AS money FROM orders GROUP BY 1""")
def plan_from_csv(spark, sf):
    path = f"{_folder(spark)}/plan"
    plan = v.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.sum("o_totalprice").alias("money"))
    sinks.save_csv(plan, path, 2)
    return rounded(spark.read.schema("symbol string, money double").option("header", True).csv(path), 2)


_LOG = """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS time, o_custkey AS portfolio_id, o_orderpriority AS symbol, o_orderstatus AS action, o_orderkey AS shares,
    o_totalprice AS price FROM orders"""


@query("decision_log_newest_rows", f"""SELECT * FROM ({_LOG}) t ORDER BY time DESC, portfolio_id, symbol, shares LIMIT 20""")
def decision_log_newest_rows(spark, sf):
    """All orders as a log of one run a month, written twice; the newest rows are a report of a set length."""
    path = f"{_folder(spark)}/log"
    log = v.table(spark, sf, "orders").select(
        F.date_trunc("month", "o_orderdate").cast("date").alias("time"), F.col("o_custkey").alias("portfolio_id"), F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderstatus").alias("action"), F.col("o_orderkey").alias("shares"), F.col("o_totalprice").alias("price"),
        F.date_trunc("year", "o_orderdate").cast("date").alias("run_date"))
    for run in (log, log):
        sinks.append_decisions(run, path)
    return accounts.newest_rows(spark.read.parquet(path), 20, ["shares"]).select("time", "portfolio_id", "symbol", "action", "shares", "price")


@query("archive_version", with_views("SELECT md5(headline) AS headline_hash, url, published, len(symbols) AS n_symbols FROM news", "news"))
def archive_version(spark, sf):
    news = v.news(spark, sf).withColumn("text_status", F.lit(""))
    path = sinks.save_version(news.select(*[f.split()[0] for f in schema.ARCHIVE.split(", ")]).withColumn("published", F.col("published").cast("timestamp")), _folder(spark))
    back = st.load_archive(spark, path)
    return back.select(F.md5("headline").alias("headline_hash"), "url", F.col("published").cast("timestamp_ntz").alias("published"),
                       F.size("symbols").cast("bigint").alias("n_symbols"))


_SAVED = SQL["page_articles"]


@query("saved_articles", f"""SELECT substr(sha1(url), 1, 16) AS article_id, url, text_hash, n_chars FROM ({_SAVED}) t
    WHERE text_status = 'saved'""")
def saved_articles(spark, sf):
    """Saved twice: the second time adds nothing."""
    from tapeline.operators.news import extract_articles
    path = f"{_folder(spark)}/articles"
    texts = extract_articles(v.table(spark, sf, "pages"))
    for _ in range(2):
        sinks.save_articles(texts, path)
    return sinks.read_articles(spark, path).select("article_id", "url", F.md5("text").alias("text_hash"), F.col("n_chars").cast("bigint").alias("n_chars"))


@query("rss_items", """SELECT page_id, 'pages' AS symbol, url AS link, TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id % 40000 AS INTEGER)) AS published FROM pages""")
def rss_items(spark, sf):
    """Pages written as feed items and read again."""
    path = f"{_folder(spark)}/rss"
    stamp = F.date_format(F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(page_id % 40000 as int), 0)"), "EEE, d MMM yyyy HH:mm:ss")
    v.table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("title"), F.col("url").alias("link"), F.concat(stamp, F.lit(" GMT")).alias("pubDate"),
        F.lit("a page").alias("description")).write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    back = st.read_rss(spark, path, "pages")
    return back.select(F.col("headline").cast("bigint").alias("page_id"), "symbol", F.col("url").alias("link"),
                       F.col("published").cast("timestamp_ntz").alias("published"))
