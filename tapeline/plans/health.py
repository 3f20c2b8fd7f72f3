"""Portfolio health check: one bundle of tables for any number of portfolios."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tapeline.operators import books as bk
from tapeline.operators.correlation import close_pairs
from tapeline.operators.portfolio import sector_money, with_sector


class HealthCheck(NamedTuple):
    totals: DataFrame         # portfolio_id, total, invested
    positions: DataFrame      # sector, value, money %, risk %, volatility per usable holding
    by_sector: DataFrame
    effective: DataFrame
    correlations: DataFrame
    close_pairs: DataFrame
    growth: DataFrame         # 100 grown day by day, mix and benchmarks
    comparison: DataFrame     # final value, volatility, drawdown, mix against benchmarks
    excluded: DataFrame       # holdings with too little history


def missing_benchmarks(closes: DataFrame, benchmarks: Sequence[str], min_days: int) -> list[str]:
    """Benchmarks without enough history: the comparison needs them all."""
    counts = (closes.where(F.col("symbol").isin(*benchmarks)).groupBy("symbol")
              .agg(F.count("close").alias("n")).where(F.col("n") >= min_days))
    have = {row.symbol for row in counts.limit(len(benchmarks)).collect()}
    return [b for b in benchmarks if b not in have]


def health_check(closes: DataFrame, holdings: DataFrame, sectors: DataFrame,
                 benchmarks: Sequence[str] = ("SPY",), min_days: int = 200,
                 account_totals: DataFrame | None = None, keep_book: bool = False) -> HealthCheck:
    """`closes` already holds only the days to look at. `keep_book` writes the arrays of closes once,
    which pays when several of the tables are used."""
    absent = missing_benchmarks(closes, benchmarks, min_days) if benchmarks else []
    if absent:
        raise ValueError(f"benchmarks without enough price history: {', '.join(absent)}")
    book = bk.books(closes, holdings, min_days, benchmarks, keep=keep_book)
    positions = with_sector(book.facts(bk.risk_facts, bk.RISK).withColumn("money_pct", F.col("weight") * 100.0), sectors)
    pairs = book.facts(bk.correlation_facts, "sym_a string, sym_b string, corr double, n_days bigint")
    steps = book.facts(bk.growth_facts(book.benchmarks), bk.GROWTH)
    names = F.array(*[F.lit(n) for n in bk.line_names(book.benchmarks)])
    invested = holdings.groupBy("portfolio_id").agg(F.sum("value").alias("invested"))
    totals = (invested.withColumn("total", F.col("invested")) if account_totals is None
              else invested.join(account_totals, "portfolio_id", "left"))
    return HealthCheck(
        totals=totals, positions=positions, by_sector=sector_money(positions),
        effective=book.facts(bk.effective_facts, "effective double"), correlations=pairs, close_pairs=close_pairs(pairs),
        growth=steps.select("portfolio_id", F.get(names, F.col("line")).alias("name"), F.date_from_unix_date("days").alias("day"), "r", "growth"),
        comparison=book.facts(bk.comparison_facts, "name string, grown_100 double, volatility_pct double, biggest_drop_pct double"),
        excluded=book.left_out)
