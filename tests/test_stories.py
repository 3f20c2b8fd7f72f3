import collections
import random

import pytest
from pyspark.sql import functions as F

from helpers import as_dict, utc, weekdays
from tapeline.functions import textual as tx
from tapeline.operators import archive as ar, news as nw, scoring as sc, significance as sig

ARCHIVE = "pos long, published timestamp, symbols array<string>, source string, headline string, summary string, url string, text_status string"
FEED = "seq long, published timestamp, symbol string, source string, headline string, summary string, url string"


def text(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


def test_sentiment_counts_whole_words_any_case_with_repeats(spark):
    assert text(spark, "Stock SURGES, beats; beats again", tx.sentiment) == 3
    assert text(spark, "misses and recordings", tx.sentiment) == -1      # not inside other words
    assert text(spark, "gains but lawsuit", tx.sentiment) == 0


def test_site_key_id_and_shortening(spark):
    assert text(spark, "https://www.site.com/a?b=1", tx.site_of) == "site.com"
    assert text(spark, "no link", tx.site_of) == ""
    assert text(spark, "Apple Drops 3%!", tx.headline_key) == "appledrops3"
    assert text(spark, None, tx.headline_key) == "none"
    assert text(spark, "one two three", lambda c: tx.shorten(c, 9)) == "one two…"
    assert text(spark, "short", tx.shorten) == "short"


@pytest.mark.parametrize("moment,expected", [
    ("2024-03-05 20:59:00", "2024-03-05"),   # 15:59 in New York, winter time
    ("2024-03-05 21:00:00", "2024-03-06"),   # 16:00 counts as after the close
    ("2024-03-12 19:59:00", "2024-03-12"),   # 15:59 in summer time
    ("2024-03-12 20:00:00", "2024-03-13"),
    ("2024-03-09 15:00:00", "2024-03-11"),   # Saturday
    ("2024-03-08 22:00:00", "2024-03-11"),   # Friday evening
    ("2024-03-05 03:00:00", "2024-03-05"),   # 22:00 on the 4th in New York: after that day's close
    ("2024-03-20 12:00:00", None)])
def test_story_goes_to_the_first_day_it_could_move(spark, moment, expected):
    days = spark.createDataFrame([(d,) for d in weekdays(10, "2024-03-04")], "day date")
    story = spark.createDataFrame([(utc(moment),)], "published timestamp")
    got = nw.assign_trading_day(story, days).first().trading_day
    assert (got and str(got)) == expected


def test_stories_before_the_first_day_count_on_it(spark):
    days = spark.createDataFrame([("A", d) for d in weekdays(3, "2024-03-04")], "symbol string, day date")
    story = spark.createDataFrame([("A", utc("2024-01-01 12:00:00"), 1)], "symbol string, published timestamp, score int")
    assert str(nw.stories_per_day(story, days).first().day) == "2024-03-04"
    assert str(nw.assign_trading_day(story, days, ["symbol"]).first().trading_day) == "2024-03-04"


def replay(old, new):
    """The merge one story at a time."""
    rows = [dict(r) for r in old]
    key = lambda h: "".join(ch for ch in str(h).lower() if ch.isalnum())
    links = {r["url"]: r for r in rows}
    heads = {key(r["headline"]): r for r in rows}
    for s in new:
        if not s["url"]:
            continue
        seen = links.get(s["url"]) or heads.get(key(s["headline"]))
        if seen:
            seen["symbols"] = sorted(set(seen["symbols"]) | {s["symbol"]})
        else:
            row = {"url": s["url"], "headline": s["headline"], "symbols": [s["symbol"]], "text_status": ""}
            rows.append(row)
            links[s["url"]] = heads[key(s["headline"])] = row
    return sorted((r["url"], str(r["headline"]), tuple(r["symbols"]), r["text_status"]) for r in rows)


def merged(spark, old, new):
    when = utc("2024-01-01 00:00:00")
    a = spark.createDataFrame([(i, when, o["symbols"], "s", o["headline"], "", o["url"], o["text_status"])
                               for i, o in enumerate(old)], ARCHIVE)
    n = spark.createDataFrame([(i, when, s["symbol"], "s", s["headline"], "", s["url"]) for i, s in enumerate(new)], FEED)
    return sorted((r.url, str(r.headline), tuple(r.symbols), r.text_status) for r in ar.merge(a, n).collect())


def story(url, headline, symbol="A"):
    return {"url": url, "headline": headline, "symbol": symbol}


def test_a_seen_story_does_not_register_its_other_key(spark):
    new = [story("u1", "h1"), story("u1", "h2", "B"), story("u2", "h2", "C")]
    assert merged(spark, [], new) == replay([], new)
    assert [m[0] for m in merged(spark, [], new)] == ["u1", "u2"]


@pytest.mark.parametrize("seed", range(3))
def test_merge_agrees_with_a_replay(spark, seed):
    rnd = random.Random(seed)
    links, heads = [f"u{i}" for i in range(12)], ["Big News!", "big news", "", None, "A", "b", "C c", "d", "E", "f", "G"]
    def some(n):
        return [story(rnd.choice(links + ["", "hot", "hot"]), rnd.choice(heads + ["hot"] * 4), rnd.choice("XYZ")) for _ in range(n)]
    old = [{"url": s["url"], "headline": s["headline"], "symbols": [s["symbol"]], "text_status": "saved"}
           for s in some(6) if s["url"]]
    new = some(60)
    assert merged(spark, old, new) == replay(old, new)


def test_chain_of_alternating_keys(spark):
    new = [story(f"u{i // 2}", f"h{(i + 1) // 2}") for i in range(15)]
    assert merged(spark, [], new) == replay([], new)


def test_first_rule_that_matches_decides(spark):
    rules = [("a.com", 1, "/ok", True), ("a.com", 2, "/", False), ("www.b.com", 1, "/x", False)]
    robots = spark.createDataFrame(rules, "host string, ord int, path_prefix string, allow boolean")
    links = ["https://a.com/ok/1", "https://a.com/no", "https://www.b.com/x", "https://b.com/x", "https://c.com",
             "https://finance.yahoo.com/n", "https://www.b.com/y?x=1"]
    got = as_dict(nw.crawl_checks(spark.createDataFrame([(u,) for u in links], "url string"), robots), "url", "check")
    assert [got[u] for u in links] == ["", "blocked_by_robots", "blocked_by_robots", "", "", "skipped_site", ""]


def test_page_text_drops_boilerplate_and_flags_short_pages(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><p>A &amp; B</p><script>x<1</script><!-- c -->" + "<p>word</p>" * 80
    pages = spark.createDataFrame([("u", page), ("v", "<p>hi</p>")], "url string, html string")
    rows = {r.url: r for r in nw.extract_articles(pages).collect()}
    assert rows["u"].text.startswith("A & B word word") and "menu" not in rows["u"].text
    assert (rows["u"].text_status, rows["v"].text_status) == ("saved", "no_article_text")


def test_headlines_are_cut_to_k_before_repeats_are_dropped(spark):
    rows = [(utc(f"2024-01-02 0{h}:00:00"), tags, head, f"u{i}")
            for i, (h, tags, head) in enumerate([(5, ["A", "B"], "both"), (4, ["A"], "a1"), (3, ["A"], "a2"), (2, ["B"], "b1"), (1, ["B"], "b2")])]
    news = spark.createDataFrame(rows, "published timestamp, symbols array<string>, headline string, url string")
    watch = spark.createDataFrame([("A", 0), ("B", 1)], "symbol string, pos int")
    got = {(r.symbol, r.headline) for r in nw.newest_headlines(news, watch, "2024-01-01 00:00:00", 2).collect()}
    assert got == {("A", "both"), ("A", "a1"), ("B", "b1")}      # B shows one only


def flags(spark, values, chosen, parts=4):
    rows = [("S", d, float(x), bool(c)) for d, x, c in zip(weekdays(len(values)), values, chosen)]
    return spark.createDataFrame(rows, "symbol string, day date, v double, chosen boolean").repartition(parts)


def test_luck_test_sees_a_real_effect_and_no_effect(spark):
    real = sig.shuffle_test(flags(spark, [5] * 10 + [0] * 90, [1] * 10 + [0] * 90), "v", "chosen", trials=300).first()
    assert (real.k, real.n, real.p_value) == (10, 100, 0.0) and real.verdict == "very unlikely to be luck"
    none = sig.shuffle_test(flags(spark, [1, -1] * 30, [0, 0, 1, 1] * 15), "v", "chosen", trials=300).first()
    assert none.p_value > 0.2
    ties = sig.shuffle_test(flags(spark, [1] * 20, [1, 0] * 10), "v", "chosen", trials=50).first()
    assert ties.p_value == 1.0
    empty = sig.shuffle_test(flags(spark, [1] * 5, [0] * 5), "v", "chosen", trials=10).first()
    assert empty.p_value is None and empty.verdict is None


def test_picks_do_not_depend_on_partitioning_and_have_the_right_size(spark):
    values, chosen = list(range(40)), [i % 5 == 0 for i in range(40)]
    one, many = (sorted(map(repr, sig.random_means(flags(spark, values, chosen, p), "v", "chosen", trials=50).collect())) for p in (1, 8))
    assert one == many
    universe = spark.createDataFrame([(s,) for s in "ABCDEF"], "symbol string")
    picks = sig.random_portfolios(universe, [2, 4], 20)
    assert {(r.size, r["count"]) for r in picks.groupBy("size", "sample").count().collect()} == {(2, 2), (4, 4)}
    assert picks.distinct().count() == picks.count() == 120


def test_every_set_is_drawn_about_equally_often_and_sizes_end_at_the_universe(spark):
    universe = spark.createDataFrame([(s,) for s in "ABCDEA"], "symbol string")          # five, one of them twice
    picks = sig.random_portfolios(universe, [2, 9], 2000).collect()
    sets = {}
    for p in picks:
        sets.setdefault((p.size, p.sample), []).append(p.symbol)
    assert all(sorted(s) == list("ABCDE") for (size, _), s in sets.items() if size == 9)
    twos = collections.Counter(tuple(sorted(s)) for (size, _), s in sets.items() if size == 2)
    assert len(twos) == 10 and all(150 < n < 250 for n in twos.values())                  # 200 of each are expected
    assert sig.random_portfolios(universe.limit(0), [2], 5).count() == 0


def test_portfolio_statistics_average_who_has_a_return(spark):
    rows = [("A", 1, 0.1), ("A", 2, 0.2), ("B", 2, 0.0), ("B", 3, -0.5), ("C", 1, None)]
    returns = spark.createDataFrame(rows, "symbol string, d int, r double").selectExpr("symbol", "date_from_unix_date(d) AS day", "r")
    picks = spark.createDataFrame([(2, 0, "A"), (2, 0, "B"), (1, 1, "A"), (1, 2, "C")], "size int, sample int, symbol string")
    got = {(r.size, r.sample): r for r in sig.random_portfolio_stats(returns, picks).collect()}
    assert set(got) == {(2, 0), (1, 1)}                                                   # C has no return
    both = got[2, 0]
    assert both.days == 3 and abs(both.return_pct - (1.1 * 1.1 * 0.5 - 1) * 100) < 1e-9 and abs(both.biggest_drop_pct + 50) < 1e-9


def test_texts_are_scored_once_and_keep_their_rows(spark):
    seen = spark.sparkContext.accumulator(0)
    def counting(c):
        from pyspark.sql.functions import udf
        @udf("struct<positive:double,negative:double,neutral:double>")
        def model(t):
            seen.add(1)
            return (0.5, 0.5, 0.0) if t == "tie" else (0.1, 0.2, 0.7)
        return model(c)
    texts = spark.createDataFrame([("tie",), ("b",), ("tie",), ("b",), ("old",)], "text string")
    cache = spark.createDataFrame([("old", .9, .05, .05)], "text string, positive double, negative double, neutral double")
    fresh = sc.new_scores(texts, cache, counting)
    assert sorted(r.text for r in fresh.collect()) == ["b", "tie"] and seen.value == 2
    rows = sc.attach_scores(texts, sc.extended_cache(cache, fresh)).collect()
    assert sorted((r.text, r.label, r.label_score) for r in rows) == [
        ("b", "neutral", 0), ("b", "neutral", 0), ("old", "positive", 1), ("tie", "positive", 1), ("tie", "positive", 1)]


def matched(rows):
    links, heads, out = set(), set(), []
    for seq, u, h in sorted(rows):
        if u not in links and h not in heads:
            links.add(u)
            heads.add(h)
            out.append(seq)
    return out


@pytest.mark.parametrize("small", [0, 40, 10_000])
def test_archive_rounds_equal_a_replay(spark, small):
    rng = random.Random(6)
    pairs = list({(rng.randrange(60) if rng.random() < .7 else 0, rng.randrange(60) if rng.random() < .7 else 0): 1 for _ in range(400)})
    rows = [(i, f"u{u}", f"h{h}") for i, (u, h) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "seq bigint, _u string, _h string")
    assert sorted(r.seq for r in ar.first_stories(df, small).collect()) == matched(rows)
    assert ar.first_stories(df.limit(0), small).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each story shares its link with the one before it and its headline with the one after."""
    n, rounds = 10_000, []
    rows = [(i, f"u{i // 2}", f"h{(i + 1) // 2}") for i in range(n)]
    cut = ar.cut_lineage
    monkeypatch.setattr(ar, "cut_lineage", lambda df: (rounds.append(1), cut(df))[1])
    df = spark.createDataFrame(rows, "seq bigint, _u string, _h string")
    got = sorted(r.seq for r in ar.first_stories(df, 0).collect())
    assert got == matched(rows) == list(range(0, n, 2))
    assert len(rounds) <= 30          # two or three tables a round, one a doubling: 3 rounds and 14 doublings


def test_hosts_without_an_answer_are_shut(spark):
    rules = spark.createDataFrame([("a.example", 1, "/x", False), ("b.example", 1, "/", False), ("f.example", 1, "/x", False)],
                                  "host string, ord int, path_prefix string, allow boolean")
    hosts = spark.createDataFrame([("a.example", 200), ("b.example", 404), ("c.example", 503), ("d.example", None), ("e.example", 200), ("e.example", 500)],
                                  "host string, status int")
    links = [f"https://{h}.example/{p}" for h in "abcdefg" for p in ("x", "y")]
    got = as_dict(nw.crawl_checks(spark.createDataFrame([(u,) for u in links], "url string"), rules, (), hosts), "url", "check")
    shut = {"https://a.example/x", "https://f.example/x", *(u for u in links if u[8] in "cde")}
    assert {u for u in links if got[u] == "blocked_by_robots"} == shut and {u for u in links if got[u] == ""} == set(links) - shut


def _moved(df):
    """The columns of each shuffle of the plan, in lines."""
    import re
    ways = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    plan = df._jdf.queryExecution().explainString(ways.fromString("formatted"))
    return re.findall(r"\) Exchange\nInput \[\d+\]: ([^\n]*)\nArguments: ([^\n]*)", plan)


def test_stories_are_not_dealt_by_symbol_alone_and_texts_not_per_portfolio(spark):
    stories = spark.sql("""SELECT id, concat('text ', id % 7) AS headline, concat('u', id) AS url, array('A', 'B') AS symbols,
        'A' AS symbol, timestamp'2024-01-02 12:00:00' + make_dt_interval(cast(id % 9 AS int)) AS published FROM range(60)""")
    stories = stories.unionByName(stories.where("id = 0").withColumn("published", F.lit(None).cast("timestamp")).withColumn("id", F.lit(99)))
    days = spark.sql("SELECT 'A' AS symbol, date_add(date'2024-01-04', cast(id AS int)) AS day FROM range(0, 6, 2)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        placed = nw.assign_trading_day(stories, days, ["symbol"])
        dealt = [to for columns, to in _moved(placed) if "headline" in columns]
        assert dealt and all("_salt" in to for to in dealt)
        got = {r["id"]: r["trading_day"] and r["trading_day"].day for r in placed.collect()}
        shown = nw.portfolio_headlines(stories, spark.sql("SELECT id AS portfolio_id, s AS symbol, 1.0D AS value FROM range(9) LATERAL VIEW explode(array('A', 'B')) AS s"), "2024-01-01 00:00:00")
        assert not [to for columns, to in _moved(shown) if "headline" in columns and "portfolio_id" in columns]
        rows = shown.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: {0: 4, 1: 4, 2: 4, 3: 6, 4: 6, 5: 8, 6: 8}.get(i % 9) for i in range(60)} | {99: 4}
    assert len(rows) == 18 and {(r["symbol"], r["headline"]) for r in rows} == {("A", "text 3"), ("A", "text 5")}
