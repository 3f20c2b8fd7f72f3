"""Average ranks and rank correlation over pools of any size.

A rank needs an order, and one window over the pool would put all of it in one task. Here values are first
counted (equal values collapse map-side), laid out in ranges of (key, value) that hold equally many distinct
values, and ranked inside each range; the ranges' totals supply the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tapeline.operators.skew import salted_join
from tapeline.session import cut_lineage


def value_ranks(counts: DataFrame, value: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Average rank of each distinct value. `counts` holds (by, value, n), unique on (by, value).

    Ranges are cut over keys and values together, so a large key has many and small keys share one; their
    number is that of the shuffle partitions. Any cut gives exact ranks; the layout is written once.
    """
    by = list(by)
    ranges = ranges or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(counts.select(*by, value, "n").repartitionByRange(ranges, *by, value)
                         .withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy(*by, "_range").agg(F.sum("n").alias("_total"))
    earlier = (Window.partitionBy(*by, F.lit(0)).orderBy("_range")
               .rowsBetween(Window.unboundedPreceding, -1))   # a row per range that the key is in
    offsets = totals.select(*by, "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(inside), F.lit(0))
    return (placed.withColumn("_before", before).join(offsets, [*by, "_range"])
            .select(*by, value, "n", (F.col("_offset") + F.col("_before") + (F.col("n") + 1) / 2.0).alias("avg_rank")))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Pearson correlation of the average ranks of `a` and `b`, per `by`, with the pair count.

    Rows with a missing side are dropped first and equal pairs are counted once.
    """
    by = list(by)
    pairs = cut_lineage(df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
                        .groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("_n")))
    ranked = pairs
    for side, out in ((a, "_ra"), (b, "_rb")):
        counts = pairs.groupBy(*by, side).agg(F.sum("_n").alias("n"))
        ranks = value_ranks(counts, side, by, ranges).select(*by, side, F.col("avg_rank").alias(out))
        ranked = salted_join(ranked, ranks, [*by, side], counts=pairs.groupBy(*by, side).agg(F.count("*").alias("n")))
    sizes = pairs.groupBy(*by).agg(F.sum("_n").alias("_size"))
    if by:
        ranked = salted_join(ranked, sizes, by, counts=pairs.groupBy(*by).agg(F.count("*").alias("n")))
    else:
        ranked = ranked.withColumn("_size", sizes.scalar())
    # ranks of n rows average (n + 1) / 2, so the sums are centred without another pass
    middle = (F.col("_size") + 1) / 2.0
    da, db, n = F.col("_ra") - middle, F.col("_rb") - middle, F.col("_n")
    sums = ranked.groupBy(*by).agg(
        F.sum(n * da * db).alias("_ab"), F.sum(n * da * da).alias("_aa"),
        F.sum(n * db * db).alias("_bb"), F.sum(n).alias("checks"))
    return sums.select(*by, F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb"))).alias("rank_corr"), "checks")


def numbered(names: DataFrame, name: str, out: str = "pos", ranges: int | None = None) -> DataFrame:
    """(name, out): the distinct names numbered from 0 in their order, without one window over all of them."""
    once = names.select(name).distinct().withColumn("n", F.lit(1))
    return value_ranks(once, name, (), ranges).select(name, (F.col("avg_rank") - 1).cast("bigint").alias(out))
