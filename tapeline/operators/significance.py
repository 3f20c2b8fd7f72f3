"""Luck tests and random portfolios.

Random picks are ordered by a hash of (seed, trial, item), so results do not depend on how the
data is partitioned and any engine with md5 can replay them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tapeline.functions.finance import verdict
from tapeline.operators.mixes import _path, over_mixes
from tapeline.operators.ranking import numbered
from tapeline.operators.skew import salted_join
from tapeline.session import cut_lineage


def draw(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def group_picks(flagged: DataFrame, value: str, chosen: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per group: mean of the chosen rows, how many they are, and how many rows there are."""
    return flagged.groupBy(*keys).agg(
        F.avg(F.when(F.col(chosen), F.col(value))).alias("ours"),
        F.count_if(F.col(chosen)).alias("k"), F.count(F.lit(1)).alias("n"))


def random_means(flagged: DataFrame, value: str, chosen: str, row_id: str = "day", keys: Sequence[str] = ("symbol",),
                 trials: int = 10_000, seed: int = 0, block: int = 250) -> DataFrame:
    """(keys, trial, mean, ours): mean of a random pick of as many rows as were chosen, without
    replacement, for every trial; missing values are not averaged.

    A group's rows ride in one array (one entry per trading day). The array is sent once per block of
    trials, trials are exploded in place, and each picks its k smallest hashes inside the row, so nothing
    of the size rows x trials is shuffled or sorted across tasks. Groups in which nothing is chosen have
    no trials.
    """
    keys = list(keys)
    entry = F.struct(F.col(row_id).cast("string").alias("id"), F.col(row_id).alias("at"), F.col(value).cast("double").alias("v"))
    groups = flagged.groupBy(*keys).agg(
        F.avg(F.when(F.col(chosen), F.col(value))).alias("ours"), F.count_if(F.col(chosen)).cast("int").alias("k"),
        F.collect_list(entry).alias("_rows")).where(F.col("k") > 0)
    blocks = F.sequence(F.lit(0), F.lit((trials - 1) // block))
    spread = groups.withColumn("_block", F.explode(blocks)).repartition(*keys, "_block")
    first = F.col("_block") * block
    each = spread.withColumn("trial", F.explode(F.sequence(first, F.least(first + (block - 1), F.lit(trials - 1)))))
    drawn = F.transform("_rows", lambda e: F.struct(
        F.md5(F.concat_ws("#", F.lit(str(seed)), F.col("trial").cast("string"), *[F.col(k).cast("string") for k in keys], e["id"])).alias("h"),
        e["at"].alias("at"), e["v"].alias("v")))
    picked = F.filter(F.transform(F.slice(F.array_sort(drawn), F.lit(1), F.col("k")), lambda e: e["v"]), lambda x: x.isNotNull())
    total = F.aggregate("_p", F.lit(0.0), lambda acc, x: acc + x)
    return each.select(*keys, "trial", "ours", picked.alias("_p")).select(*keys, "trial", F.try_divide(total, F.size("_p")).alias("mean"), "ours")


def shuffle_test(flagged: DataFrame, value: str, chosen: str, row_id: str = "day",
                 keys: Sequence[str] = ("symbol",), trials: int = 10_000, seed: int = 0) -> DataFrame:
    """How often a random pick does at least as well: ours, k, n, p_value, verdict per group.

    A group in which nothing was chosen has no p-value. The flagged rows (one per group and day) are
    written once, so that the work behind them is not repeated for each use.
    """
    flagged = cut_lineage(flagged.select(*keys, row_id, value, chosen))
    means = random_means(flagged, value, chosen, row_id, keys, trials, seed)
    # equal picks tie whatever the order of summation: the slack is relative to the value
    hit = F.col("mean") >= F.col("ours") - F.abs("ours") * 1e-9
    p = means.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("p_value"))
    out = group_picks(flagged, value, chosen, keys).join(p, list(keys), "left")
    return out.withColumn("verdict", verdict(F.col("p_value")))


def histogram(means: DataFrame, value: str = "mean", bins: int = 50,
              keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Counts in equal-width bins between each group's smallest and largest value. A value within a
    billionth of a bin below an edge counts as on it, so that noise of summation moves nothing."""
    edges = means.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width) + 1e-9),
                                               F.lit(0)))
    placed = salted_join(means.select(*keys, value), edges, keys)
    return (placed.withColumn("bin", place.cast("int")).groupBy(*keys, "bin")
            .agg(F.count(F.lit(1)).alias("n")))


def scoreboard(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Tests passed against what luck alone would give."""
    return tests.agg(F.count_if(F.col("p_value") < level).alias("passed"),
                     F.count("p_value").alias("tests"),
                     (F.count("p_value") * level).alias("expected_by_luck"))


def random_portfolios(universe: DataFrame, sizes: Sequence[int], samples: int, seed: int = 0) -> DataFrame:
    """(size, sample, symbol): `samples` picks of each size from the universe, no repeats; a size above the
    universe takes all of it.

    Symbols are numbered once. A sample of k of n is drawn by Floyd's rule: at step i a number up to n - k + i
    comes from a hash of (seed, size, sample, i), and where it is taken already the number n - k + i itself
    enters, which makes every set of k equally likely. So a sample costs its size, not the universe's.
    """
    names = cut_lineage(numbered(universe, "symbol"))
    n = names.count()
    each = (universe.sparkSession.range(samples).select(F.col("id").cast("int").alias("sample"))
            .withColumn("size", F.explode(F.array(*[F.lit(int(s)) for s in sizes]))))
    k = F.least("size", F.lit(n))

    def step(taken: Column, i: Column) -> Column:
        last = F.lit(n) - k + i
        drawn = F.conv(F.substring(draw(seed, F.col("size"), F.col("sample"), i), 1, 13), 16, 10).cast("bigint") % (last + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, drawn), last.cast("bigint")).otherwise(drawn)))

    steps = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    picks = each.select("size", "sample", F.explode(F.aggregate(
        steps, F.expr("cast(array() as array<bigint>)"), step)).alias("pos"))
    return picks.join(names, "pos").select("size", "sample", "symbol")


def random_portfolio_stats(returns: DataFrame, picks: DataFrame) -> DataFrame:
    """Equal-weight growth, volatility and drawdown of every pick: a day counts the members that have a
    return on it. Symbols are arrays, so no row per pick and day exists."""
    def facts(held, block, days):
        grown, volatility, drop = _path(np.nanmean(block, axis=0))
        yield 100.0 * grown, volatility, drop, len(days), 100.0 * grown - 100.0
    return over_mixes(returns, picks.withColumn("weight", F.lit(1.0)), facts,
                      "grown_100 double, volatility_pct double, biggest_drop_pct double, days bigint, return_pct double",
                      ["size", "sample"])


def diversification(stats: DataFrame) -> DataFrame:
    """Typical and worst results per portfolio size; the samples of a size are a set parameter."""
    return stats.groupBy("size").agg(
        F.median("volatility_pct").alias("typical_volatility"),
        F.median("biggest_drop_pct").alias("typical_drop"),
        F.min("biggest_drop_pct").alias("worst_drop"),
        F.median("return_pct").alias("typical_return"), F.min("return_pct").alias("worst_return"))


def box_stats(stats: DataFrame, value: str = "volatility_pct") -> DataFrame:
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    q = stats.groupBy("size").agg(quartiles.alias("q"))
    return q.select("size", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"),
                    F.col("q")[2].alias("q75"))
