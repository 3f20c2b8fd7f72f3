"""Do news days differ by more than luck? Both tests for every symbol in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeline.operators.news import busy_split, focused, by_tag, news_days, stories_per_day
from tapeline.operators.prices import moves
from tapeline.operators.significance import shuffle_test


def news_table(closes: DataFrame, news: DataFrame, max_symbols: int = 3,
               keep_quiet: bool = False) -> DataFrame:
    """Moves with story count and mood per symbol and day. `news` carries `score`."""
    stories = by_tag(focused(news, max_symbols))
    per_day = stories_per_day(stories, closes.select("symbol", "day"))
    return news_days(moves(closes), per_day, keep_quiet)


def busy_test(table: DataFrame, trials: int = 10_000, seed: int = 0) -> DataFrame:
    """Are moves larger on busy news days?"""
    return shuffle_test(busy_split(table), "size_pct", "busy", trials=trials, seed=seed)


def mood_test(table: DataFrame, trials: int = 10_000, seed: int = 0) -> DataFrame:
    """Are next-day moves higher after good news?"""
    rows = (table.where(F.col("next_move_pct").isNotNull())
            .withColumn("good", F.coalesce(F.col("mood") > 0, F.lit(False))))
    return shuffle_test(rows, "next_move_pct", "good", trials=trials, seed=seed)
