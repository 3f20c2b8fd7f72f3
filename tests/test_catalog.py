import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql_and_the_flagship_runs(spark):
    from tapeline.catalog import QUERIES, SQL
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", ["trend_leaderboard", "news_days", "rule_alerts", "dividend_summary", "crawl_checks", "hold_by_split", "alike_pairs",
                                  "decision_log_newest_rows", "saved_articles", "rss_items", "stream_minute_bars"])
def test_sample_of_queries_agrees_with_sql(spark, name):
    from oracle import compare, connect
    ok, note = compare(connect(SF), entry.queries()[name](spark, SF), entry.oracle_sql()[name])
    assert ok, note


@pytest.mark.parametrize("name,pieces", [
    ("daily_bars", ["ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double,props:string>"]),
    ("holdings_profit", ["ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderpriority:string>"]),
    ("newest_headlines", ["WindowGroupLimit"])])
def test_plans_prune_and_limit(spark, name, pieces):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for piece in pieces:
        assert piece in plan
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "SortAggregate" not in plan


def test_long_series_share_one_shuffle(spark):
    plan = entry.queries()["parameter_sweep"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2      # to the daily grain, then by symbol


def test_digest_brings_the_tables_of_one_report_together(spark):
    from pyspark.sql import functions as F
    from tapeline.catalog import views as v
    from tapeline.plans.digest import digest
    from tapeline.sources import reference
    held = v.table(spark, SF, "events").groupBy(F.col("user_id").alias("portfolio_id"),
                                                F.col("event_type").alias("symbol")).agg(F.sum("value").alias("value"))
    closes = v.event_bars(spark, SF).select("symbol", "day", "close")
    out = digest(closes, held, v.news(spark, SF), reference.sectors(spark, {"Web": ("click",)}),
                 reference.funds(spark, ("view",)), reference.market_names(spark, {"click": "Clicks"}),
                 "2024-01-20 00:00:00", {"daily_move_pct": 0.0}, min_days=10)
    portfolios = held.select("portfolio_id").distinct().count()
    assert out.day.count() == out.outlook.mix.count() == portfolios
    assert out.holdings.count() == out.outlook.holdings.count() == held.count() == out.alerts.count()
    assert [r.name for r in out.market.collect()] == ["Clicks"]
    assert out.headlines.groupBy("portfolio_id", "headline").count().where("count > 1").count() == 0


@pytest.mark.parametrize("name", ["stream_text_scores", "stream_archive", "stream_minute_bars"])
def test_streams_read_tables_that_are_folders_of_files(spark, tmp_path, name):
    from oracle import compare, connect
    for table in ("documents", "events"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    ok, note = compare(connect(SF), entry.queries()[name](spark, str(tmp_path)), entry.oracle_sql()[name])
    assert ok, note
