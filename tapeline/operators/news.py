"""News against trading days: alignment, daily folds, headlines and crawl bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.functions import fixed
from tapeline.functions.textual import mood_bucket, page_text, article_status, site_of
from tapeline.operators.skew import salted_join
from tapeline.session import cut_lineage


def focused(news: DataFrame, max_symbols: int = 3) -> DataFrame:
    """Stories mainly about few companies."""
    return news.where(F.size("symbols") <= max_symbols)


def effective_day(published: Column) -> Column:
    """New York date of a UTC time; from 16:00 on, the day after."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(fixed.MARKET_ZONE), published.cast("timestamp_ntz"))
    return F.date_add(F.to_date(local), F.when(F.hour(local) < fixed.CLOSE_HOUR, 0).otherwise(1))


def day_map(trading_days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cal_day, trading_day): for every calendar day the first trading day on or after it.

    One row per calendar day and key, found from consecutive trading days; no range join.
    """
    keys = list(keys)
    days = trading_days.select(*keys, "day").distinct()
    order = Window.partitionBy(*keys, F.lit(0)).orderBy("day")   # one row per trading day
    gaps = days.withColumn("_prev", F.lag("day").over(order))
    start = F.coalesce(F.date_add("_prev", 1), F.col("day"))
    return gaps.select(*keys, F.explode(F.sequence(start, F.col("day"))).alias("cal_day"),
                       F.col("day").alias("trading_day"))


def first_days(trading_days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return trading_days.groupBy(*keys).agg(F.min("day").alias("_first"))


def assign_trading_day(stories: DataFrame, trading_days: DataFrame,
                       keys: Sequence[str] = ()) -> DataFrame:
    """First trading day that each story could have moved; null after the last one.

    Stories before the first trading day get that day. Days are found for the few (keys, day) that have
    stories; the stories themselves move once, hot (symbol, day) groups spread by salt.
    """
    keys = list(keys)
    # a story without a time is before all others, and a null would meet nothing in a join
    dated = stories.withColumn("_eff", F.coalesce(effective_day(F.col("published")), F.lit("0001-01-01").cast("date")))
    counts = dated.groupBy(*keys, "_eff").agg(F.count(F.lit(1)).alias("n"))
    firsts = first_days(trading_days, keys)
    if keys:
        slots = counts.drop("n").join(firsts, keys, "left")
    else:
        slots = counts.drop("n").withColumn("_first", firsts.scalar())
    slots = slots.withColumn("cal_day", F.greatest("_eff", "_first"))
    placed = slots.join(day_map(trading_days, keys), [*keys, "cal_day"], "left").select(*keys, "_eff", "trading_day")
    return salted_join(dated, placed, [*keys, "_eff"], "left", counts).drop("_eff")


def stories_per_day(stories: DataFrame, trading_days: DataFrame, score: str = "score") -> DataFrame:
    """Story count and mean mood per (symbol, trading day).

    Stories are folded to (symbol, effective day) before they meet the calendar, so a ticker with
    most of the news shuffles one row per day and task.
    """
    folded = (stories.withColumn("cal_day", effective_day(F.col("published")))
              .groupBy("symbol", "cal_day")
              .agg(F.count(F.lit(1)).alias("_n"), F.sum(score).cast("double").alias("_s")))
    firsts = first_days(trading_days, ["symbol"])
    dated = folded.join(firsts, "symbol").withColumn("cal_day", F.greatest("cal_day", "_first"))
    return (dated.join(day_map(trading_days, ["symbol"]), ["symbol", "cal_day"])
            .groupBy("symbol", F.col("trading_day").alias("day"))
            .agg(F.sum("_n").alias("stories"), F.try_divide(F.sum("_s"), F.sum("_n")).alias("mood")))


def by_tag(news: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """One row per story and tagged symbol."""
    tagged = news.withColumn("symbol", F.explode("symbols"))
    return tagged if symbols is None else tagged.join(symbols.select("symbol"), "symbol", "left_semi")


def news_days(moves: DataFrame, per_day: DataFrame, keep_quiet: bool = False) -> DataFrame:
    """Moves beside news. `keep_quiet` keeps days without stories as zero, else they drop out."""
    how = "left" if keep_quiet else "inner"
    table = moves.join(per_day, ["symbol", "day"], how)
    if keep_quiet:
        table = table.na.fill(0, ["stories"])
    return table.where(F.col("move_pct").isNotNull())


def busy_cutoff(table: DataFrame, quantile: float = 0.8) -> DataFrame:
    """Exact interpolated quantile of stories per symbol; distinct counts are few."""
    return table.groupBy("symbol").agg(F.percentile("stories", F.lit(quantile)).alias("cutoff"))


def busy_split(table: DataFrame, quantile: float = 0.8) -> DataFrame:
    """Days above their symbol's cutoff. The table has a row per symbol and day, so a window is small."""
    cutoff = F.percentile("stories", F.lit(quantile)).over(Window.partitionBy("symbol"))
    return table.withColumn("cutoff", cutoff).withColumn("busy", F.col("stories") > F.col("cutoff"))


def busy_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("symbol", "busy").agg(
        F.count(F.lit(1)).alias("days"), F.avg("size_pct").alias("mean_size_pct"))


def story_move_correlation(table: DataFrame) -> DataFrame:
    """Pearson of stories and mood with the moves, over the days that have both."""
    return table.groupBy("symbol").agg(
        F.corr(F.col("stories").cast("double"), "size_pct").alias("stories_size_corr"),
        F.corr("mood", "move_pct").alias("mood_move_corr"),
        F.corr("mood", "next_move_pct").alias("mood_next_corr"))


def mood_summary(table: DataFrame) -> DataFrame:
    """Days, mean move and share of up days per mood bucket, same day and next day. A missing next
    move counts as not up."""
    def up(c):
        return F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0)) * 100.0
    return (table.withColumn("label", mood_bucket(F.col("mood"))).groupBy("symbol", "label").agg(
        F.count(F.lit(1)).alias("days"), F.avg("move_pct").alias("same_day_avg"),
        up("move_pct").alias("same_day_up"), F.avg("next_move_pct").alias("next_day_avg"),
        up("next_move_pct").alias("next_day_up")))


def _top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Top k rows per key. Spark limits each task's groups before the shuffle, so a hot key moves
    k rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def biggest_moves(table: DataFrame, stories: DataFrame, k: int = 5) -> DataFrame:
    """Largest moves per symbol with the newest headline of that day. `stories` carries symbol,
    trading_day, published, headline."""
    top = _top(table, ["symbol"], [F.desc("size_pct"), F.col("day")], k)
    newest = (stories.groupBy("symbol", F.col("trading_day").alias("day"))
              .agg(F.max_by("headline", F.struct("published", "url")).alias("headline")))
    return (top.join(newest, ["symbol", "day"], "left")
            .withColumn("headline", F.coalesce("headline", F.lit("(no focused stories)"))))


def extreme_headlines(stories: DataFrame, k: int = 3) -> DataFrame:
    """The k most positive and the k most negative stories per symbol."""
    best = _top(stories, ["symbol"], [F.desc("score"), F.col("url")], k).withColumn("side", F.lit("best"))
    worst = _top(stories, ["symbol"], [F.col("score"), F.col("url")], k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def fooled(table: DataFrame, stories: DataFrame, worst_days: int = 3) -> DataFrame:
    """Positive stories on the worst days."""
    worst = _top(table, ["symbol"], [F.col("move_pct"), F.col("day")], worst_days).select(
        "symbol", F.col("day").alias("trading_day"))
    return stories.where(F.col("score") > 0).join(worst, ["symbol", "trading_day"], "left_semi")


def newest_headlines(news: DataFrame, watch: DataFrame, since: str, k: int = 2) -> DataFrame:
    """Newest k headlines per watched symbol, then a headline already shown for an earlier symbol is
    dropped. `watch(symbol, pos)`; the order of the two steps means a symbol may show fewer."""
    recent = news.where(F.col("published") >= F.lit(since).cast("timestamp"))
    tagged = salted_join(recent.withColumn("symbol", F.explode("symbols")), watch, ["symbol"])
    picked = _top(tagged, ["symbol"], [F.desc("published"), F.col("url")], k)
    first = Window.partitionBy("headline").orderBy("pos", "rank")
    return (picked.withColumn("_first", F.row_number().over(first)).where(F.col("_first") == 1)
            .drop("_first"))


def portfolio_headlines(news: DataFrame, holdings: DataFrame, since: str, k: int = 2) -> DataFrame:
    """The same per portfolio, walking its holdings by value. The newest k per symbol are found once
    for all portfolios; equal headlines among them are named by the first, so that no text moves per portfolio."""
    recent = news.where(F.col("published") >= F.lit(since).cast("timestamp"))
    newest = _top(recent.withColumn("symbol", F.explode("symbols")), ["symbol"],
                  [F.desc("published"), F.col("url")], k).select("symbol", "headline", "url", "rank")
    newest = cut_lineage(newest)
    named = newest.withColumn("_same", F.min(F.struct("symbol", "rank")).over(Window.partitionBy("headline")))
    held = salted_join(holdings.select("portfolio_id", "symbol", "value"),
                       named.select("symbol", "rank", "_same"), ["symbol"])
    first = Window.partitionBy("portfolio_id", "_same").orderBy(F.desc("value"), "symbol", "rank")
    shown = held.withColumn("_first", F.row_number().over(first)).where(F.col("_first") == 1)
    return salted_join(shown.select("symbol", "portfolio_id", "rank"), newest, ["symbol", "rank"])


def unfetched(archive: DataFrame, limit: int | None = None) -> DataFrame:
    """Stories whose text was not tried yet, newest first."""
    todo = archive.where(F.col("text_status") == "")
    return todo if limit is None else todo.orderBy(F.desc("published"), "url").limit(limit)


def crawl_checks(stories: DataFrame, robots: DataFrame,
                 skip_sites: Sequence[str] = fixed.SKIP_SITES, hosts: DataFrame | None = None) -> DataFrame:
    """May each link be visited? Adds `check`: empty, skipped_site or blocked_by_robots.

    `robots(host, ord, path_prefix, allow)`: the first rule by `ord` whose prefix matches decides;
    none means allowed. A host's rules travel as one sorted list, so a site holding most of the
    links is spread by salt and no (link, rule) rows are made.

    `hosts(host, status)` tells how the request for a host's rules ended: 404 means that it has none; any other
    failure (400 and more, or null for no answer) keeps the whole host shut. Of several rows of a host the
    strictest counts. Hosts that are not in it go by `robots` alone.
    """
    rules = robots.groupBy("host").agg(F.array_sort(F.collect_list(
        F.struct("ord", "path_prefix", "allow"))).alias("_rules"))
    if hosts is None:
        rules = rules.withColumn("_shut", F.lit(False))
    else:
        status = F.col("status")
        told = hosts.groupBy("host").agg(F.bool_or(status.isNull() | ((status >= 400) & (status != 404))).alias("_shut"),
                                         F.bool_and(F.coalesce(status == 404, F.lit(False))).alias("_free"))
        rules = rules.join(told, "host", "full").withColumn("_rules", F.when(~F.coalesce("_free", F.lit(False)), F.col("_rules"))).drop("_free")
    path = F.coalesce(F.try_parse_url("url", F.lit("FILE")), F.lit("/"))
    path = F.when(path == "", "/").otherwise(path)
    located = (stories.withColumn("host", F.coalesce(F.try_parse_url("url", F.lit("AUTHORITY")), F.lit("")))
               .withColumn("_path", path))
    joined = salted_join(located, rules, ["host"], "left")
    match = F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["path_prefix"]))
    verdict = F.try_element_at(match, F.lit(1))["allow"]
    site = site_of(F.col("url"))
    return joined.withColumn(
        "check", F.when(site.isin(*skip_sites), "skipped_site")
        .when(F.coalesce("_shut", F.lit(False)) | ~F.coalesce(verdict, F.lit(True)), "blocked_by_robots").otherwise("")
    ).drop("_rules", "_shut", "_path", "host")


def extract_articles(pages: DataFrame, min_chars: int = fixed.MIN_ARTICLE_CHARS) -> DataFrame:
    """Readable text of each page with its length and status."""
    text = pages.withColumn("text", page_text(F.col("html"))).drop("html")
    return (text.withColumn("n_chars", F.length("text"))
            .withColumn("text_status", article_status(F.col("text"), min_chars)))


def crawl_report(archive: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Stories per source and status."""
    return (archive.groupBy("source").pivot("text_status", list(statuses))
            .agg(F.count(F.lit(1))).na.fill(0))


def archive_stats(archive: DataFrame) -> DataFrame:
    return archive.agg(F.count(F.lit(1)).alias("stories"), F.min("published").alias("oldest"),
                       F.max("published").alias("newest"))
