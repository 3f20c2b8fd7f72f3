"""Daily digest: the tables behind one report per portfolio."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tapeline.operators.alerts import check_rules, holdings_moves, portfolio_day
from tapeline.operators.news import portfolio_headlines
from tapeline.operators.prices import recent_moves
from tapeline.plans.outlook import Outlook, forecast_holdings


class Digest(NamedTuple):
    alerts: DataFrame
    holdings: DataFrame
    day: DataFrame
    market: DataFrame
    headlines: DataFrame
    outlook: Outlook


def market_overview(closes: DataFrame, names: DataFrame) -> DataFrame:
    """Day and month moves of the market and sector funds, by name."""
    return recent_moves(closes).join(names, "symbol")


def digest(closes: DataFrame, holdings: DataFrame, news: DataFrame, sectors: DataFrame,
           funds: DataFrame, names: DataFrame, since: str, rules: dict[str, float],
           min_days: int = 63) -> Digest:
    moved = holdings_moves(holdings, recent_moves(closes))
    return Digest(
        alerts=check_rules(moved, sectors, funds, **rules), holdings=moved, day=portfolio_day(moved),
        market=market_overview(closes, names), headlines=portfolio_headlines(news, holdings, since),
        outlook=forecast_holdings(closes, holdings, min_days=min_days))


def digest_lines(report: Digest) -> DataFrame:
    """(portfolio_id, section, subject, value): the report's tables as lines of one. Market lines belong to
    no portfolio."""
    def part(df: DataFrame, section: str, subject, value, owner=F.col("portfolio_id").cast("bigint")) -> DataFrame:
        return df.select(owner.alias("portfolio_id"), F.lit(section).alias("section"), subject.alias("subject"),
                         value.cast("double").alias("value"))
    parts = [part(report.alerts, "alert", F.concat_ws(": ", "rule", "subject"), F.col("value")),
             part(report.holdings, "holding", F.col("symbol"), F.col("day_pct")),
             part(report.day, "day", F.lit("portfolio"), F.col("day_pct")),
             part(report.market, "market", F.col("name"), F.col("day_pct"), F.lit(None).cast("bigint")),
             part(report.headlines, "headline", F.concat_ws(" ", "symbol", "url"), F.col("rank")),
             part(report.outlook.mix, "outlook", F.lit("portfolio"), F.col("volatility_pct"))]
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionByName(more)
    return lines
