import datetime as dt

from pyspark.sql import functions as F

from helpers import utc
from tapeline import schema
from tapeline.operators.prices import trade_bars
from tapeline.operators.scoring import lexicon_scorer
from tapeline.sources import accounts, market, sinks, stories as st
from tapeline.streaming import stories as live_stories, trades as live


def test_daily_closes_reads_only_what_it_needs(spark, tmp_path):
    rows = [(s, utc(f"2024-01-0{d} 05:00:00"), 1.0, 1.0, 1.0, float(d), 1.0) for s in "AB" for d in (2, 3, 4) if (s, d) != ("B", 3)]
    spark.createDataFrame(rows, schema.BARS).write.parquet(str(tmp_path / "bars"))
    got = market.daily_closes(spark, str(tmp_path / "bars"), "2024-01-05", ["A", "B"], days=2)
    assert {(r.symbol, r.day.day) for r in got.collect()} == {("A", 4), ("B", 4)}
    grid = market.daily_closes(spark, str(tmp_path / "bars"), "2024-01-05", ["A", "B", "C"], days=9, keep_gaps=True)
    assert grid.count() == 9 and grid.where("close is null").count() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ts" in plan and "volume" not in plan


def test_rss_rows(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("""<rss><channel><item><title> Up 3% </title><link>https://www.x.com/a</link>
        <pubDate>Mon, 05 Feb 2024 14:30:00 +0000</pubDate><description>d</description></item>
        <item><title>Two</title><link>https://y.com/b</link><pubDate>Tue, 6 Feb 2024 09:00:00 GMT</pubDate></item></channel></rss>""")
    rows = st.read_rss(spark, str(tmp_path / "feed.xml"), "AAPL").orderBy("published").collect()
    assert [(r.headline, r.source, r.summary) for r in rows] == [("Up 3%", "x.com", "d"), ("Two", "y.com", "")]
    assert [r.published for r in rows] == [utc("2024-02-05 14:30:00"), utc("2024-02-06 09:00:00")]


def test_holdings_csv_and_rounded_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("symbol,name,value_eur,profit_eur\nA,Alpha,10.555,-1\n")
    df = accounts.read_holdings_csv(spark, str(tmp_path / "p.csv"), 3)
    assert df.first() == (3, "A", "Alpha", 10.555, -1.0)
    sinks.save_csv(df.select("symbol", "value"), str(tmp_path / "out"), 2)
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == [("A", "10.56")]


def test_decision_log_appends_and_newest_run_is_found(spark, tmp_path):
    log = str(tmp_path / "log")
    for day in (1, 2):
        rows = [(utc(f"2024-01-0{day} 10:00:00"), s, "HOLD", 1, 1.0, 1.0, "", False, dt.date(2024, 1, day)) for s in "AB"]
        sinks.append_decisions(spark.createDataFrame(rows, schema.DECISIONS), log)
    saved = spark.read.parquet(log).withColumn("portfolio_id", F.lit(1))
    assert saved.count() == 4
    assert {r.time.day for r in accounts.newest_run(saved).collect()} == {2}
    assert [r.symbol for r in accounts.newest_rows(saved, 3).collect()] == ["A", "B", "A"]


def test_archive_versions_and_articles(spark, tmp_path):
    assert st.load_archive(spark, str(tmp_path / "none")).count() == 0
    rows = [(utc("2024-01-01 00:00:00"), ["A"], "s", "h", "", "u", "")]
    first = sinks.save_version(spark.createDataFrame(rows, schema.ARCHIVE), str(tmp_path / "arc"))
    old = st.load_archive(spark, first)
    second = sinks.save_version(old.withColumn("text_status", F.lit("saved")), str(tmp_path / "arc"))
    assert st.load_archive(spark, first).first().text_status == "" and st.load_archive(spark, second).first().text_status == "saved"
    texts = spark.createDataFrame([("u", "long", 4, "saved"), ("v", "x", 1, "no_article_text")],
                                  "url string, text string, n_chars int, text_status string")
    sinks.save_articles(texts, str(tmp_path / "art"))
    rows = sinks.read_articles(spark, str(tmp_path / "art")).collect()
    assert [(r.url, len(r.article_id)) for r in rows] == [("u", 16)]


def test_equity_history_drops_bad_readings(spark):
    raw = spark.createDataFrame([(1, 0, 5.0), (1, 60, 0.0), (1, 120, None)], schema.EQUITY)
    assert [(r.ts, r.equity) for r in market.equity_history(raw).collect()] == [(utc("1970-01-01 00:00:00"), 5.0)]


def trades(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(s, utc(t), float(p), 1.0, n) for n, (s, t, p) in enumerate(rows, 100 * i)], schema.TRADES)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "trades"))
    return str(tmp_path / "trades")


def test_stream_bars_equal_batch_bars_over_several_batches(spark, tmp_path):
    path = trades(spark, tmp_path, [[("A", "2024-01-01 10:00:01", 5), ("A", "2024-01-01 10:00:30", 7), ("B", "2024-01-01 10:00:02", 1)],
                                    [("A", "2024-01-01 10:01:10", 6), ("A", "2024-01-01 10:00:59", 4)],
                                    [("A", "2024-01-01 10:30:00", 9)]])
    query = live.store(live.bars(live.file_trades(spark, path, 1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    live.listen(query)
    got = spark.read.parquet(str(tmp_path / "out")).select("symbol", "start", "open", "high", "low", "close", "volume")
    batch = trade_bars(spark.read.parquet(path).where("ts < '2024-01-01 10:20:00'"), F.date_trunc("minute", "ts"), "start")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, batch.select(got.columns).collect()))


def test_collected_bars_lose_no_trade_in_any_order(spark, tmp_path):
    parts = [[("A", "2024-01-03 10:30:00", 9)], [("A", "2024-01-01 10:00:30", 7), ("B", "2024-01-01 10:00:02", 1)],
             [("A", "2024-01-02 10:01:10", 6)], [("A", "2024-01-01 10:00:59", 4), ("A", "2024-01-01 10:00:01", 5)]]
    path = trades(spark, tmp_path, parts)
    for width, unit in (("1 minute", "minute"), ("1 day", "day")):
        root = str(tmp_path / unit)
        live.listen(live.collect_bars(live.file_trades(spark, path, 1), root, root + "-cp", width))
        got = live.read_bars(spark, root).select("symbol", "start", "open", "high", "low", "close", "volume")
        batch = trade_bars(spark.read.parquet(path), F.date_trunc(unit, "ts"), "start").select(got.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, batch.collect()))
        assert spark.read.parquet(root).select("batch").distinct().count() == 4
    state = {(r.symbol, str(r.day)): r.price for r in live.session_state(live.read_bars(spark, str(tmp_path / "day"))).collect()}
    assert state == {("A", "2024-01-01"): 4.0, ("B", "2024-01-01"): 1.0, ("A", "2024-01-02"): 6.0, ("A", "2024-01-03"): 9.0}


def test_an_archive_does_not_begin_anew_unasked(spark, tmp_path):
    import pytest
    from tapeline.session import exists, shared_dir
    (tmp_path / "arc" / "batch=1").mkdir(parents=True)
    assert exists(spark, str(tmp_path / "arc")) and not exists(spark, str(tmp_path / "none"))
    assert st.newest_archive(spark, str(tmp_path / "none")).count() == 0
    feed_rows = [("2024-01-01 10:00:00", "A", "x.example", "h", "s", "https://x.example/1", 1)]
    feed = spark.createDataFrame(feed_rows, "published string, symbol string, source string, headline string, summary string, url string, seq long")
    feed.withColumn("published", F.to_timestamp("published")).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "feed")).schema).parquet(str(tmp_path / "feed"))
    with pytest.raises(Exception, match="checkpoint was reset"):
        live.listen(live_stories.archive_batches(stream, str(tmp_path / "arc"), str(tmp_path / "cp")))
    assert shared_dir(spark)


def test_trade_log_is_complete_and_resumes(spark, tmp_path):
    path = trades(spark, tmp_path, [[("A", "2024-01-01 10:00:01", 5)]])
    def run():
        live.listen(live.store(live.file_trades(spark, path), str(tmp_path / "out"), str(tmp_path / "cp")))
        return spark.read.parquet(str(tmp_path / "out")).count()
    assert run() == 1
    trades(spark, tmp_path, [[], [("A", "2024-01-01 10:00:05", 6)]][1:])
    assert run() == 2


def test_streamed_archive_and_scores_handle_only_new_stories(spark, tmp_path):
    cols = "seq long, published timestamp, symbol string, source string, headline string, summary string, url string"
    feed_dir = str(tmp_path / "feed")
    def arrive(seq, symbol, headline, url):
        spark.createDataFrame([(seq, utc(f"2024-01-01 0{seq}:00:00"), symbol, "s", headline, "", url)], cols).write.mode("append").parquet(feed_dir)
    def run():
        feed = spark.readStream.schema(cols).parquet(feed_dir)
        live.listen(live_stories.archive_batches(feed, str(tmp_path / "arc"), str(tmp_path / "cp")))
        texts = spark.readStream.schema(cols).parquet(feed_dir).select(F.col("headline").alias("text"))
        live.listen(live_stories.score_batches(texts, lexicon_scorer(), str(tmp_path / "sc"), str(tmp_path / "cp2")))
    arrive(1, "A", "Stock soars", "u1")
    run()
    arrive(2, "B", "STOCK SOARS!", "u2")      # the same headline for another ticker
    arrive(3, "A", "Stock soars", "u1")
    arrive(4, "A", "Profit warning", "u3")
    run()
    rows = {r.url: r.symbols for r in st.newest_archive(spark, str(tmp_path / "arc")).collect()}
    assert rows == {"u1": ["A", "B"], "u3": ["A"]}
    scores = spark.read.parquet(str(tmp_path / "sc"))
    assert sorted((r.text, r.batch) for r in scores.collect()) == [("Profit warning", 1), ("STOCK SOARS!", 1), ("Stock soars", 0)]


def test_runs_of_a_table_follow_from_the_batch():
    from tapeline.sources.runs import FAN, runs_after
    assert runs_after(-1) == [] and runs_after(0) == [(0, 0)] and runs_after(6) == [(b, b) for b in range(7)]
    assert runs_after(7) == [(0, 7)] and runs_after(8) == [(0, 7), (8, 8)] and runs_after(63) == [(0, 63)]
    for b in range(200):
        runs = runs_after(b)
        assert [r[0] for r in runs] == [0, *(r[1] + 1 for r in runs[:-1])] and runs[-1][1] == b and len(runs) <= 3 * (FAN - 1)


def test_an_archive_of_many_batches_equals_a_replay_and_writes_what_is_new(spark, tmp_path):
    import os
    import random
    from tapeline.sources import runs
    draw, feed = random.Random(5), []
    for seq in range(1, 301):
        feed.append((seq, utc("2024-01-01 00:00:00"), draw.choice("ABCDE"), "s", f"story {draw.randrange(90)}", "", f"u{draw.randrange(120)}"))
    cols = "seq long, published timestamp, symbol string, source string, headline string, summary string, url string"
    root, path = str(tmp_path / "arc"), str(tmp_path / "feed")
    for b in range(10):
        spark.createDataFrame(feed[b * 30:b * 30 + 30], cols).coalesce(1).write.mode("append").parquet(path)
        live.listen(live_stories.archive_batches(spark.readStream.schema(cols).parquet(path), root, str(tmp_path / "cp")))
    links, heads, rows = {}, {}, []
    for _, _, symbol, _, headline, _, url in feed:
        owner = links.get(url, heads.get(headline))
        if owner is None:
            links[url] = heads[headline] = len(rows)
            rows.append((url, headline, [symbol]))
        elif symbol not in rows[owner][2]:
            rows[owner][2].append(symbol)
    got = sorted((r.url, r.headline, sorted(r.symbols)) for r in st.newest_archive(spark, root).collect())
    assert got == sorted((u, h, sorted(s)) for u, h, s in rows)
    assert runs.newest(spark, root) == 9 and runs.runs_after(9) == [(0, 7), (8, 8), (9, 9)]
    last = spark.read.parquet(f"{root}/9-9/stories")
    assert 0 < last.count() < 10 and spark.read.parquet(f"{root}/0-7/tickers").count() == 0
    assert len(os.listdir(root)) <= 3 * runs.FAN
    # a run that was not ended does not count, and a retried batch gives the same table
    runs.remove(spark, f"{root}/9-9/whole")
    assert runs.newest(spark, root) == 8
