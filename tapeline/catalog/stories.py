"""News, archive, crawl, scoring, luck-test and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeline.catalog import query, r, rounded
from tapeline.catalog import views as v
from tapeline.catalog.market import D, W
from tapeline.catalog.views import with_views
from tapeline.functions import fixed, textual as tx
from tapeline.operators import archive as ar, news as nw, scoring as sc, significance as sig, prices as px
from tapeline.plans import luck
from tapeline.session import shared_dir
from tapeline.sources import stories as st
from tapeline.streaming import stories as live_stories, trades as live

KEY_SQL = r"regexp_replace(lower(coalesce({}, 'None')), '[^\p{{L}}\p{{N}}]', '', 'g')"
HOST_SQL = "regexp_extract({}, '^[a-z]+://([^/?#]*)', 1)"
SITE_SQL = "regexp_replace(" + HOST_SQL + r", '^www\.', '')"


def _hits(text: str, words) -> str:
    listed = ", ".join(f"'{w}'" for w in sorted(set(words)))
    return f"len(list_filter(regexp_extract_all(lower({text}), '[a-z]+'), lambda x: list_contains([{listed}], x)))"


SCORE = f"{_hits('headline', v.GOOD)} - {_hits('headline', v.BAD)}"
SIGN = "CASE WHEN {0} > 0 THEN 'positive' WHEN {0} < 0 THEN 'negative' ELSE 'neutral' END"


def scored_news(spark, sf):
    return v.news(spark, sf).withColumn("score", tx.sentiment(F.col("headline"), v.GOOD, v.BAD))


# --- expressions over stories -------------------------------------------------------------------

@query("headline_facts", with_views(f"""SELECT doc_id, md5({KEY_SQL.format('headline')}) AS key_hash,
    {SITE_SQL.format('url')} AS site, substr(sha1(url), 1, 16) AS article_id,
    CASE WHEN length(headline) <= 140 THEN headline
    ELSE regexp_replace(substr(headline, 1, 140), ' [^ ]*$', '') || '…' END AS short FROM news""", "news"))
def headline_facts(spark, sf):
    h, u = F.col("headline"), F.col("url")
    return v.news(spark, sf).select("doc_id", F.md5(tx.headline_key(h)).alias("key_hash"),
                                    tx.site_of(u).alias("site"), tx.article_id(u).alias("article_id"),
                                    tx.shorten(h).alias("short"))


@query("headline_sentiment", with_views(f"""SELECT doc_id, score, {SIGN.format('score')} AS label,
    CAST({_hits('headline', fixed.POSITIVE_WORDS)} - {_hits('headline', fixed.NEGATIVE_WORDS)} AS BIGINT) AS listed
    FROM (SELECT doc_id, headline, CAST({SCORE} AS BIGINT) AS score FROM news) t""", "news"))
def headline_sentiment(spark, sf):
    out = scored_news(spark, sf)
    return out.select("doc_id", F.col("score").cast("bigint").alias("score"),
                      tx.sign_label(F.col("score")).alias("label"),
                      tx.sentiment(F.col("headline")).cast("bigint").alias("listed"))


@query("label_counts", with_views(f"""SELECT {SIGN.format('score')} AS label, count(*) AS n
    FROM (SELECT {SCORE} AS score FROM news) t GROUP BY 1""", "news"))
def label_counts(spark, sf):
    return sc.label_counts(scored_news(spark, sf).withColumn("label", tx.sign_label(F.col("score"))))


@query("focused_news", with_views("""SELECT doc_id, published, len(symbols) AS n_symbols FROM news
    WHERE len(symbols) <= 3 AND list_contains(symbols, 'view') AND published >= TIMESTAMP '2024-01-10'""", "news"))
def focused_news(spark, sf):
    return (st.news_for(nw.focused(v.news(spark, sf)), "view", "2024-01-10 00:00:00")
            .select("doc_id", F.col("published").cast("timestamp_ntz").alias("published"),
                    F.size("symbols").cast("bigint").alias("n_symbols")))


NY = "({} AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
EFF = f"CAST({NY.format('published')} AS DATE) + CASE WHEN hour({NY.format('published')}) < 16 THEN 0 ELSE 1 END"
# a market calendar with gaps: weekdays of the first 26 days
CAL = "SELECT DISTINCT day FROM bars WHERE isodow(day) <= 5 AND day <= DATE '2024-01-26'"


@query("story_trading_day", with_views(f"""SELECT doc_id, (SELECT min(day) FROM cal WHERE day >= {EFF})
    AS trading_day FROM news""", "bars", "news", cal=CAL))
def story_trading_day(spark, sf):
    days = v.event_bars(spark, sf).select("day").distinct().where(
        (F.weekday("day") < 5) & (F.col("day") <= F.to_date(F.lit("2024-01-26"))))
    return nw.assign_trading_day(v.news(spark, sf), days).select("doc_id", "trading_day")


@query("story_market_day", with_views(f"""SELECT doc_id, (SELECT min(day) FROM (SELECT DISTINCT day FROM bars) WHERE day >= {EFF})
    AS trading_day FROM news""", "bars", "news"))
def story_market_day(spark, sf):
    """On the whole calendar."""
    return nw.assign_trading_day(v.news(spark, sf), v.event_bars(spark, sf).select("day").distinct()).select("doc_id", "trading_day")


_TABLE = {
    "tagged": f"""SELECT unnest(symbols) AS symbol, doc_id, published, headline, url, {SCORE} AS score
        FROM news WHERE len(symbols) <= 3""",
    "placed": f"""SELECT t.*, (SELECT min(b.day) FROM bars b WHERE b.symbol = t.symbol AND b.day >= t.eff)
        AS trading_day FROM (SELECT *, {EFF} AS eff FROM tagged) t""",
    "per_day": """SELECT symbol, trading_day AS day, count(*) AS stories, CAST(sum(score) AS DOUBLE) / count(*) AS mood
        FROM placed WHERE trading_day IS NOT NULL GROUP BY 1, 2""",
    "moved": f"""SELECT symbol, day, move_pct, abs(move_pct) AS size_pct, lead(move_pct) OVER w AS next_move_pct
        FROM (SELECT symbol, day, (close / lag(close) OVER w - 1) * 100 AS move_pct FROM bars {W}) t {W}""",
    "joined": """SELECT m.*, stories, mood FROM moved m JOIN per_day USING (symbol, day)
        WHERE move_pct IS NOT NULL""",
    "quiet": """SELECT m.*, coalesce(stories, 0) AS stories, mood FROM moved m LEFT JOIN per_day USING (symbol, day)
        WHERE move_pct IS NOT NULL""",
}
_BASE = ("bars", "news")


def _table(spark, sf, keep_quiet=False):
    closes = v.event_bars(spark, sf).select("symbol", "day", "close")
    return luck.news_table(closes, scored_news(spark, sf), keep_quiet=keep_quiet)


def _placed(spark, sf):
    tagged = nw.by_tag(nw.focused(scored_news(spark, sf)))
    return nw.assign_trading_day(tagged, v.event_bars(spark, sf).select("symbol", "day"), ["symbol"])


@query("news_days", with_views(f"""SELECT symbol, day, {r('move_pct')} AS move_pct, {r('size_pct')} AS size_pct,
    {r('next_move_pct')} AS next_move_pct, stories, {r('mood')} AS mood FROM joined""", *_BASE, **_TABLE))
def news_days(spark, sf):
    return rounded(_table(spark, sf).drop("close"))


@query("busy_days", with_views(f"""SELECT symbol, busy, count(*) AS days, {r('avg(size_pct)')} AS mean_size_pct
    FROM (SELECT q.*, stories > c AS busy FROM quiet q JOIN (SELECT symbol, quantile_cont(stories, 0.8) AS c
    FROM quiet GROUP BY symbol) k USING (symbol)) t GROUP BY 1, 2""", *_BASE, **_TABLE))
def busy_days(spark, sf):
    return rounded(nw.busy_summary(nw.busy_split(_table(spark, sf, True))))


@query("news_move_correlation", with_views(f"""SELECT symbol, {r('corr(stories, size_pct)')} AS stories_size_corr,
    {r('corr(mood, move_pct)')} AS mood_move_corr, {r('corr(mood, next_move_pct)')} AS mood_next_corr
    FROM quiet GROUP BY symbol""", *_BASE, **_TABLE))
def news_move_correlation(spark, sf):
    return rounded(nw.story_move_correlation(_table(spark, sf, True)))


@query("mood_summary", with_views(f"""SELECT symbol, CASE WHEN mood > -99 AND mood <= -0.001 THEN 'bad news'
    WHEN mood > -0.001 AND mood <= 0.001 THEN 'neutral' WHEN mood > 0.001 AND mood <= 99 THEN 'good news' END AS label,
    count(*) AS days, {r('avg(move_pct)')} AS same_day_avg,
    {r('avg(CASE WHEN move_pct > 0 THEN 1 ELSE 0 END) * 100')} AS same_day_up,
    {r('avg(next_move_pct)')} AS next_day_avg,
    {r('avg(CASE WHEN next_move_pct > 0 THEN 1 ELSE 0 END) * 100')} AS next_day_up
    FROM joined GROUP BY 1, 2""", *_BASE, **_TABLE))
def mood_summary(spark, sf):
    return rounded(nw.mood_summary(_table(spark, sf)))


@query("biggest_moves", with_views(f"""SELECT t.symbol, t.day, {r('size_pct')} AS size_pct,
    coalesce(headline, '(no focused stories)') AS headline FROM (SELECT *, row_number() OVER
    (PARTITION BY symbol ORDER BY size_pct DESC, day) AS k FROM quiet) t LEFT JOIN (
    SELECT symbol, trading_day, headline, row_number() OVER (PARTITION BY symbol, trading_day
    ORDER BY published DESC, url DESC) AS j FROM placed) h
    ON h.symbol = t.symbol AND h.trading_day = t.day AND j = 1 WHERE k <= 5""", *_BASE, **_TABLE))
def biggest_moves(spark, sf):
    out = nw.biggest_moves(_table(spark, sf, True), _placed(spark, sf))
    return rounded(out.select("symbol", "day", "size_pct", "headline"))


@query("extreme_headlines", with_views("""SELECT symbol, doc_id, CAST(score AS BIGINT) AS score, side FROM (
    SELECT *, 'best' AS side, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, url) AS k FROM tagged
    UNION ALL SELECT *, 'worst', row_number() OVER (PARTITION BY symbol ORDER BY score, url) FROM tagged) t
    WHERE k <= 3""", *_BASE, tagged=_TABLE["tagged"]))
def extreme_headlines(spark, sf):
    out = nw.extreme_headlines(nw.by_tag(nw.focused(scored_news(spark, sf))))
    return rounded(out.select("symbol", "doc_id", "score", "side"))


@query("fooled_headlines", with_views("""SELECT symbol, doc_id, trading_day FROM placed WHERE score > 0
    AND (symbol, trading_day) IN (SELECT (symbol, day) FROM (SELECT symbol, day, row_number() OVER
    (PARTITION BY symbol ORDER BY move_pct, day) AS k FROM joined) t WHERE k <= 3)""", *_BASE, **_TABLE))
def fooled_headlines(spark, sf):
    out = nw.fooled(_table(spark, sf), _placed(spark, sf))
    return out.select("symbol", "doc_id", "trading_day")


_POS = ", ".join(f"('{t}', {i})" for i, t in enumerate(v.EVENT_TYPES))


@query("newest_headlines", with_views(f"""SELECT symbol, doc_id, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY headline ORDER BY pos, rank) AS f FROM (SELECT symbol, doc_id, headline, pos, row_number() OVER
    (PARTITION BY symbol ORDER BY published DESC, url) AS rank FROM (SELECT *, unnest(symbols) AS symbol FROM news
    WHERE published >= TIMESTAMP '2024-01-20') n JOIN (SELECT * FROM (VALUES {_POS}) AS t(symbol, pos)) w
    USING (symbol)) t WHERE rank <= 2) u WHERE f = 1""", "news"))
def newest_headlines(spark, sf):
    watch = spark.createDataFrame([(t, i) for i, t in enumerate(v.EVENT_TYPES)], "symbol string, pos int")
    out = nw.newest_headlines(v.news(spark, sf), watch, "2024-01-20 00:00:00")
    return rounded(out.select("symbol", "doc_id", "rank"))


def _reader_holdings(spark, sf):
    """Readers holding event types, by what their events were worth."""
    return v.table(spark, sf, "events").groupBy(
        F.col("user_id").alias("portfolio_id"), F.col("event_type").alias("symbol")).agg(
        F.sum("value").alias("value"))


@query("portfolio_headlines", with_views("""SELECT portfolio_id, symbol, url, rank FROM (SELECT h.portfolio_id,
    h.symbol, n.url, n.rank, row_number() OVER (PARTITION BY h.portfolio_id, headline
    ORDER BY h.value DESC, h.symbol, rank) AS f FROM (SELECT user_id AS portfolio_id, event_type AS symbol,
    sum(value) AS value FROM events GROUP BY 1, 2) h JOIN (SELECT * FROM (SELECT symbol, headline, url,
    row_number() OVER (PARTITION BY symbol ORDER BY published DESC, url) AS rank FROM
    (SELECT *, unnest(symbols) AS symbol FROM news WHERE published >= TIMESTAMP '2024-01-20') n) t
    WHERE rank <= 2) n USING (symbol)) t WHERE f = 1""", "news"))
def portfolio_headlines(spark, sf):
    out = nw.portfolio_headlines(v.news(spark, sf), _reader_holdings(spark, sf), "2024-01-20 00:00:00")
    return rounded(out.select("portfolio_id", "symbol", "url", "rank"))


# --- archive ------------------------------------------------------------------------------------

def _archive_inputs(spark, sf):
    """Labelled documents are already archived; all documents arrive, one row per story."""
    news = v.news(spark, sf).withColumn("published", F.col("published").cast("timestamp"))
    old = (news.join(v.table(spark, sf, "labels"), "doc_id", "left_semi")
           .withColumn("text_status", F.lit("saved")).withColumn("pos", F.col("doc_id"))
           .withColumn("symbols", F.array("source")))
    new = news.withColumn("seq", F.col("doc_id")).withColumn("symbol", F.get("symbols", F.lit(0)))
    return old, new.drop("symbols")


_REPLAY = {
    "stories": f"""SELECT doc_id, url, md5({KEY_SQL.format('headline')}) AS hkey, symbols[1] AS symbol,
        row_number() OVER (ORDER BY doc_id) AS i FROM news""",
    "old": f"""SELECT doc_id, url, md5({KEY_SQL.format('headline')}) AS hkey, source FROM news
        WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "start": """SELECT map_from_entries(list((u, d))) AS us FROM (SELECT url AS u, max(doc_id) AS d FROM old GROUP BY 1) t""",
    "start_h": """SELECT map_from_entries(list((h, d))) AS hs FROM (SELECT hkey AS h, max(doc_id) AS d FROM old GROUP BY 1) t""",
    # one story per step; the state is the list of added links and headline keys
    "run": """SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS urls, CAST([] AS VARCHAR[]) AS keys,
        CAST([] AS BIGINT[]) AS ids, CAST(NULL AS BIGINT) AS owner, true AS hit
        UNION ALL SELECT s.i, CASE WHEN seen THEN urls ELSE list_append(urls, s.url) END,
        CASE WHEN seen THEN keys ELSE list_append(keys, s.hkey) END,
        CASE WHEN seen THEN ids ELSE list_append(ids, s.doc_id) END,
        coalesce(s.ou, ids[list_position(urls, s.url)], s.oh, ids[list_position(keys, s.hkey)]), seen
        FROM (SELECT r.*, s2.i AS ni, s2.url, s2.hkey, s2.doc_id, s2.ou, s2.oh,
              s2.ou IS NOT NULL OR s2.oh IS NOT NULL OR list_contains(r.urls, s2.url)
              OR list_contains(r.keys, s2.hkey) AS seen
              FROM run r JOIN known s2 ON s2.i = r.i + 1) s0,
        LATERAL (SELECT s0.ni AS i, s0.url, s0.hkey, s0.doc_id, s0.ou, s0.oh) s""",
}


def _archive_sql() -> str:
    steps = {
        "stories": _REPLAY["stories"], "old": _REPLAY["old"],
        "known": """SELECT s.*, u.d AS ou, h.d AS oh FROM stories s
            LEFT JOIN (SELECT url, max(doc_id) AS d FROM old GROUP BY 1) u ON u.url = s.url
            LEFT JOIN (SELECT hkey, max(doc_id) AS d FROM old GROUP BY 1) h ON h.hkey = s.hkey""",
        "run": _REPLAY["run"],
        "outcome": """SELECT s.doc_id, s.symbol, r.owner, r.hit, s.ou, s.oh FROM run r JOIN known s ON s.i = r.i""",
        # an owner is an archived row when the archive knew the link, or no added story had it
        "owned": """SELECT owner, owner IN (SELECT doc_id FROM outcome WHERE NOT hit) AS is_new, symbol
            FROM outcome WHERE hit""",
        "more": "SELECT owner, list(DISTINCT symbol) AS syms FROM owned GROUP BY 1",
        "rows_": """SELECT o.doc_id, [n.source] AS base, 'saved' AS text_status, false AS is_new
            FROM old o JOIN news n USING (doc_id)
            UNION ALL SELECT doc_id, [symbol], '', true FROM outcome WHERE NOT hit""",
    }
    body = """SELECT n.url, md5(n.headline) AS headline_hash, r.text_status, r.is_new,
        array_to_string(CASE WHEN syms IS NULL THEN base ELSE list_sort(list_distinct(base || syms)) END, ' ')
        AS symbols FROM rows_ r JOIN news n USING (doc_id) LEFT JOIN more m ON m.owner = r.doc_id"""
    return with_views(body, "news", **steps).replace("WITH ", "WITH RECURSIVE ", 1)


@query("archive_merge", _archive_sql())
def archive_merge(spark, sf):
    merged = ar.merge(*_archive_inputs(spark, sf))
    return merged.select("url", F.md5("headline").alias("headline_hash"), "text_status", "is_new",
                         F.array_join("symbols", " ").alias("symbols"))


@query("archive_stats", with_views("""SELECT count(*) AS stories, min(published) AS oldest,
    max(published) AS newest FROM news""", "news"))
def archive_stats(spark, sf):
    return rounded(nw.archive_stats(v.news(spark, sf)))


@query("feed_rows", with_views(f"""SELECT doc_id, unnest(symbols) AS symbol, {SITE_SQL.format('url')} AS source
    FROM news""", "news"))
def feed_rows(spark, sf):
    news = v.news(spark, sf)
    feed = st.feed_to_archive(news.withColumn("summary", F.col("doc_id").cast("string")))
    return feed.select(F.col("summary").cast("bigint").alias("doc_id"), "symbol", "source")


# --- crawl --------------------------------------------------------------------------------------

_ROBOTS = """SELECT DISTINCT 'www.' || source || '.example' AS host, unnest([1, 2, 3]) AS ord,
    unnest(['/en/1', '/en', '/' || substr(md5(source), 1, 1)]) AS path_prefix,
    unnest([true, false, false]) AS allow FROM documents"""
_CRAWL = {"robots": _ROBOTS,
          "paths": f"SELECT doc_id, url, source, {HOST_SQL.format('url')} AS host, "
                   "regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM news",
          "ruled": """SELECT p.doc_id, first(allow ORDER BY ord) AS allow FROM paths p JOIN robots b
              ON b.host = p.host AND starts_with(p.path, path_prefix) GROUP BY 1"""}


def _checked(spark, sf, hosts=None):
    docs = v.table(spark, sf, "documents")
    rules = F.array(*[F.struct(F.lit(i).alias("ord"), p.alias("path_prefix"), F.lit(a).alias("allow"))
                      for i, p, a in ((1, F.lit("/en/1"), True), (2, F.lit("/en"), False),
                                      (3, F.concat(F.lit("/"), F.substring(F.md5("source"), 1, 1)), False))])
    robots = (docs.select("source").distinct()
              .select(F.concat(F.lit("www."), F.col("source"), F.lit(".example")).alias("host"),
                      F.explode(rules).alias("r")).select("host", "r.*"))
    skip = ("src0.example", "src7.example")
    return nw.crawl_checks(v.news(spark, sf), robots, skip, hosts)


_CHECK = f"""CASE WHEN {SITE_SQL.format('p.url')} IN ('src0.example', 'src7.example')
    THEN 'skipped_site' WHEN NOT coalesce(allow, true) THEN 'blocked_by_robots' ELSE '' END"""


@query("crawl_checks", with_views(f"""SELECT p.doc_id, {_CHECK} AS "check" FROM paths p
    LEFT JOIN ruled USING (doc_id)""", "news", **_CRAWL))
def crawl_checks(spark, sf):
    return _checked(spark, sf).select("doc_id", "check")


@query("crawl_checks_by_answer", with_views(f"""SELECT p.doc_id, CASE WHEN {SITE_SQL.format('p.url')} IN ('src0.example', 'src7.example')
    THEN 'skipped_site' WHEN shut OR (NOT free AND NOT coalesce(allow, true)) THEN 'blocked_by_robots' ELSE '' END AS "check"
    FROM paths p JOIN answers a ON a.host = p.host LEFT JOIN ruled USING (doc_id)""", "news", **_CRAWL,
    answers="""SELECT DISTINCT 'www.' || source || '.example' AS host, substr(md5(source), 2, 1) IN ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') AS shut,
        substr(md5(source), 2, 1) IN ('4', '5', '6', '7') AS free FROM documents"""))
def crawl_checks_by_answer(spark, sf):
    """Hosts answer by their name: with rules, that there are none, with a fault, or not at all."""
    told = F.substring(F.md5("source"), 2, 1)
    status = F.when(told < "4", 200).when(told < "8", 404).when(told < "c", 503)
    hosts = v.table(spark, sf, "documents").select(F.concat(F.lit("www."), F.col("source"), F.lit(".example")).alias("host"), status.alias("status"))
    return _checked(spark, sf, hosts.distinct()).select("doc_id", "check")


@query("crawl_report", with_views(f"""SELECT source, count(*) FILTER (WHERE s = 'skipped_site') AS skipped_site,
    count(*) FILTER (WHERE s = 'blocked_by_robots') AS blocked_by_robots, count(*) FILTER (WHERE s = 'open') AS open
    FROM (SELECT p.source, CASE {_CHECK} WHEN '' THEN 'open' ELSE {_CHECK} END AS s FROM paths p
    LEFT JOIN ruled USING (doc_id)) t GROUP BY source""", "news", **_CRAWL))
def crawl_report(spark, sf):
    status = F.when(F.col("check") == "", "open").otherwise(F.col("check"))
    return rounded(nw.crawl_report(_checked(spark, sf).withColumn("text_status", status),
                                   ["skipped_site", "blocked_by_robots", "open"]))


@query("unfetched_stories", with_views("""SELECT doc_id, url FROM news
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY published DESC, url LIMIT 20""", "news"))
def unfetched_stories(spark, sf):
    done = v.table(spark, sf, "labels").select("doc_id", F.lit("saved").alias("_s"))
    archive = (v.news(spark, sf).join(done, "doc_id", "left")
               .withColumn("text_status", F.coalesce("_s", F.lit(""))))
    return nw.unfetched(archive, 20).select("doc_id", "url")


def _page_sql() -> str:
    out = "regexp_replace(html, '<!--.*?-->', ' ', 'gs')"
    for tag in "script|style|nav|header|footer|aside|form|noscript|template|svg|head".split("|"):
        out = rf"regexp_replace({out}, '<{tag}(\s[^>]*)?>.*?</{tag}\s*>', ' ', 'gsi')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'gs')"
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                          ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{plain}')"
    return rf"trim(regexp_replace({out}, '[ \t\r\n]+', ' ', 'g'))"


@query("page_articles", f"""SELECT page_id, url, md5(text) AS text_hash, CAST(length(text) AS BIGINT) AS n_chars,
    CASE WHEN length(text) >= 300 THEN 'saved' ELSE 'no_article_text' END AS text_status
    FROM (SELECT page_id, url, {_page_sql()} AS text FROM pages) t""")
def page_articles(spark, sf):
    out = nw.extract_articles(v.table(spark, sf, "pages"))
    return rounded(out.select("page_id", "url", F.md5("text").alias("text_hash"), "n_chars", "text_status"))


# --- scoring ------------------------------------------------------------------------------------

_PROBS = {"counted": f"""SELECT doc_id, text, {_hits('text', v.GOOD)} AS g, {_hits('text', v.BAD)} AS b
            FROM documents""",
          "probs": f"""SELECT doc_id, text, {D.format('g + 1')} / (g + b + 3) AS positive,
              {D.format('b + 1')} / (g + b + 3) AS negative, {D.format(1)} / (g + b + 3) AS neutral FROM counted""",
          "labelled": """SELECT *, CASE WHEN positive >= negative AND positive >= neutral THEN 'positive'
              WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END AS label FROM probs""",
          "judged": """SELECT p.*, CASE WHEN quality = 1 AND toxic = 0 THEN 'positive' WHEN toxic = 1 THEN 'negative'
              ELSE 'neutral' END AS truth FROM labelled p JOIN labels USING (doc_id)"""}


def _scored_docs(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    scores = sc.new_scores(docs, None, sc.lexicon_scorer(v.GOOD, v.BAD))
    return sc.attach_scores(docs, scores)


def _judged(spark, sf):
    truth = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "positive")
             .when(F.col("toxic") == 1, "negative").otherwise("neutral"))
    labels = v.table(spark, sf, "labels").select("doc_id", truth.alias("truth"))
    return _scored_docs(spark, sf).join(labels, "doc_id")


@query("text_scores", with_views(f"""SELECT doc_id, {r('positive')} AS positive, {r('negative')} AS negative,
    {r('neutral')} AS neutral, label, CAST(CASE label WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END
    AS BIGINT) AS label_score, {r('greatest(positive, negative, neutral)')} AS confidence FROM labelled""", **_PROBS))
def text_scores(spark, sf):
    return rounded(_scored_docs(spark, sf).drop("text"))


@query("new_text_scores", with_views(f"""SELECT md5(text) AS text_hash, {r('any_value(positive)')} AS positive,
    {r('any_value(negative)')} AS negative, {r('any_value(neutral)')} AS neutral FROM probs
    WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id)) GROUP BY text""", **_PROBS))
def new_text_scores(spark, sf):
    """Only texts without a labelled copy need the scorer."""
    docs = v.table(spark, sf, "documents")
    scorer = sc.lexicon_scorer(v.GOOD, v.BAD)
    cache = sc.new_scores(docs.join(v.table(spark, sf, "labels"), "doc_id", "left_semi"), None, scorer)
    fresh = sc.new_scores(docs, cache, scorer)
    return rounded(fresh.select(F.md5("text").alias("text_hash"), *fixed.LABELS))


@query("label_crosstab", with_views("""SELECT truth, count(*) FILTER (WHERE label = 'positive') AS positive,
    count(*) FILTER (WHERE label = 'negative') AS negative, count(*) FILTER (WHERE label = 'neutral') AS neutral
    FROM judged GROUP BY truth""", **_PROBS))
def label_crosstab(spark, sf):
    return rounded(sc.label_crosstab(_judged(spark, sf), "truth", "label"))


@query("label_agreement", with_views(f"""SELECT count(*) AS n, {r('avg(CAST(truth = label AS DOUBLE))')} AS agreement,
    {r("avg(CAST(truth = 'neutral' AS DOUBLE))")} AS neutral_a,
    {r("avg(CAST(label = 'neutral' AS DOUBLE))")} AS neutral_b FROM judged""", **_PROBS))
def label_agreement(spark, sf):
    return rounded(sc.agreement(_judged(spark, sf), "truth", "label"))


@query("confident_disagreements", with_views("""SELECT doc_id, truth, label FROM judged
    WHERE (truth = 'positive' AND label = 'negative') OR (truth = 'negative' AND label = 'positive')
    ORDER BY greatest(positive, negative, neutral) DESC, doc_id LIMIT 4""", **_PROBS))
def confident_disagreements(spark, sf):
    out = sc.opposite_labels(_judged(spark, sf), "truth", "label")
    return out.orderBy(F.desc("confidence"), "doc_id").limit(4).select("doc_id", "truth", "label")


# --- luck ---------------------------------------------------------------------------------------

def _luck_steps(flag: str, value: str, source: str) -> dict[str, str]:
    return {**_TABLE,
            "cut": "SELECT symbol, quantile_cont(stories, 0.8) AS c FROM joined GROUP BY symbol",
            "flags": f"SELECT j.symbol, j.day, {value} AS val, {flag} AS chosen FROM joined j JOIN cut USING (symbol) {source}",
            "sizes": """SELECT symbol, avg(val) FILTER (WHERE chosen) AS ours, count(*) FILTER (WHERE chosen) AS k,
                count(*) AS n FROM flags GROUP BY symbol""",
            "means": """SELECT symbol, trial, avg(val) AS mean, any_value(ours) AS ours FROM (SELECT f.symbol, trial, val,
                ours, k, row_number() OVER (PARTITION BY f.symbol, trial ORDER BY
                md5(concat_ws('#', '0', trial, f.symbol, f.day)), f.day) AS o FROM flags f JOIN sizes USING (symbol)
                CROSS JOIN (SELECT unnest(generate_series(0, 9999)) AS trial) t) u WHERE o <= k GROUP BY 1, 2""",
            "tests": """SELECT s.symbol, s.ours, s.k, s.n, p AS p_value FROM sizes s LEFT JOIN (SELECT symbol,
                avg(CAST(mean >= ours - abs(ours) * 1e-9 AS DOUBLE)) AS p FROM means GROUP BY symbol) m USING (symbol)"""}


_VERDICT = """CASE WHEN p_value < 0.01 THEN 'very unlikely to be luck' WHEN p_value < 0.05 THEN 'unlikely to be luck'
    WHEN p_value < 0.20 THEN 'weak - could be luck' WHEN p_value IS NOT NULL THEN 'looks like luck' END"""
_TEST = f"SELECT symbol, {r('ours')} AS ours, k, n, {r('p_value')} AS p_value, {_VERDICT} AS verdict FROM tests"
_BUSY = _luck_steps("stories > c", "size_pct", "")
_MOOD = _luck_steps("mood > 0", "next_move_pct", "WHERE next_move_pct IS NOT NULL")


@query("busy_day_test", with_views(_TEST, *_BASE, **_BUSY))
def busy_day_test(spark, sf):
    return rounded(luck.busy_test(_table(spark, sf)))


@query("good_news_test", with_views(_TEST, *_BASE, **_MOOD))
def good_news_test(spark, sf):
    return rounded(luck.mood_test(_table(spark, sf)))


@query("luck_scoreboard", with_views(f"""SELECT count(*) FILTER (WHERE p_value < 0.05) AS passed,
    count(p_value) AS tests, {r('count(p_value) * 0.05')} AS expected_by_luck FROM tests""", *_BASE, **_BUSY))
def luck_scoreboard(spark, sf):
    return rounded(sig.scoreboard(luck.busy_test(_table(spark, sf))))


@query("luck_histogram", with_views("""SELECT symbol, CAST(least(49, floor((mean - lo) / ((hi - lo) / 50) + 1e-9)) AS BIGINT)
    AS bin, count(*) AS n FROM (SELECT *, min(mean) OVER (PARTITION BY symbol) AS lo,
    max(mean) OVER (PARTITION BY symbol) AS hi FROM means) t GROUP BY 1, 2""", *_BASE, **_BUSY))
def luck_histogram(spark, sf):
    from tapeline.operators.news import busy_split
    means = sig.random_means(busy_split(_table(spark, sf)), "size_pct", "busy")
    return rounded(sig.histogram(means))


# --- streams ------------------------------------------------------------------------------------

def _trade_stream(spark, sf):
    return v.stream(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        F.col("event_id").alias("trade_id"))


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stored(spark, stream):
    root = _folder(spark)
    live.listen(live.store(stream, f"{root}/table", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/table")


def _bars(spark, sf, width, slide=None):
    root = _folder(spark)
    live.listen(live.collect_bars(_trade_stream(spark, sf), f"{root}/parts", f"{root}/checkpoint", width, slide))
    return live.read_bars(spark, f"{root}/parts")


def _plain_times(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c)
                       for c, t in df.dtypes])


def _bars_sql(width: str, ends: str) -> str:
    return with_views(f"""SELECT symbol, start, "end", open, high, low, close, {r('volume')} AS volume, trades FROM (
        SELECT symbol, start, start + INTERVAL {width} AS "end", first(price ORDER BY ts, trade_id) AS open,
        max(price) AS high, min(price) AS low, last(price ORDER BY ts, trade_id) AS close, sum(size) AS volume,
        count(*) AS trades FROM spread GROUP BY symbol, start) t""", "trades", spread=ends)


@query("stream_minute_bars", _bars_sql("1 MINUTE", "SELECT *, date_trunc('minute', ts) AS start FROM trades"))
def stream_minute_bars(spark, sf):
    """As many trades in the bars as in the input, however it is cut into batches."""
    return rounded(_plain_times(_bars(spark, sf, "1 minute")))


@query("stream_sliding_bars", _bars_sql("5 MINUTE", """SELECT t.*, date_trunc('minute', ts) - to_minutes(CAST(k AS INTEGER))
    AS start FROM trades t CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS k) s"""))
def stream_sliding_bars(spark, sf):
    return rounded(_plain_times(_bars(spark, sf, "5 minutes", "1 minute")))


@query("stream_trade_log", with_views(f"""SELECT symbol, count(*) AS trades, {r('sum(size)')} AS shares,
    first(price ORDER BY ts, trade_id) AS first_price, last(price ORDER BY ts, trade_id) AS last_price,
    min(price) AS low, max(price) AS high, {r('(last(price ORDER BY ts, trade_id) / first(price ORDER BY ts, trade_id) - 1) * 100')}
    AS change_pct FROM trades GROUP BY symbol""", "trades"))
def stream_trade_log(spark, sf):
    """Every trade is stored as it comes; the summary reads the stored log."""
    return rounded(px.session_summary(_stored(spark, _trade_stream(spark, sf))))


@query("stream_session_state", with_views(f"""SELECT symbol, day, close AS price, high, low,
    {r('(close / open - 1) * 100')} AS change_pct FROM bars""", "bars"))
def stream_session_state(spark, sf):
    return rounded(live.session_state(_bars(spark, sf, "1 day")))


@query("stream_text_scores", with_views(f"""SELECT md5(text) AS text_hash, {r('any_value(positive)')} AS positive,
    {r('any_value(negative)')} AS negative, {r('any_value(neutral)')} AS neutral FROM probs GROUP BY text""", **_PROBS))
def stream_text_scores(spark, sf):
    root = _folder(spark)
    texts = v.stream(spark, sf, "documents").select("text")
    live.listen(live_stories.score_batches(texts, sc.lexicon_scorer(v.GOOD, v.BAD), f"{root}/cache", f"{root}/cp"))
    return rounded(spark.read.parquet(f"{root}/cache").select(F.md5("text").alias("text_hash"), *fixed.LABELS))


_FEED = {"stories": f"""SELECT doc_id, url, md5({KEY_SQL.format('headline')}) AS hkey, symbols[1] AS symbol,
            row_number() OVER (ORDER BY doc_id) AS i FROM news""",
         "old": "SELECT CAST(NULL AS BIGINT) AS doc_id, '' AS url, '' AS hkey, '' AS source WHERE false"}


@query("stream_archive", with_views("SELECT md5(n.headline) AS headline_hash, n.url FROM outcome o "
       "JOIN news n USING (doc_id) WHERE NOT hit", "news", **_FEED,
       known="SELECT *, CAST(NULL AS BIGINT) AS ou, CAST(NULL AS BIGINT) AS oh FROM stories",
       run=_REPLAY["run"], outcome="SELECT s.doc_id, r.hit FROM run r JOIN known s ON s.i = r.i"
       ).replace("WITH ", "WITH RECURSIVE ", 1))
def stream_archive(spark, sf):
    """The feed arrives as a stream; the archive starts empty."""
    root = _folder(spark)
    feed = v.as_news(v.stream(spark, sf, "documents")).withColumn("published", F.col("published").cast("timestamp"))
    feed = feed.withColumn("seq", F.col("doc_id")).withColumn("symbol", F.get("symbols", F.lit(0))).drop("symbols")
    live.listen(live_stories.archive_batches(feed, f"{root}/archive", f"{root}/cp"))
    return st.newest_archive(spark, f"{root}/archive").select(F.md5("headline").alias("headline_hash"), "url")
