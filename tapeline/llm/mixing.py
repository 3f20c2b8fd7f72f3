"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: each source's share of the whole by weight, at most `most` times its size; what is above goes to
the others by weight until none is above. A source whose target reaches its size first takes every document
whole, once per complete epoch; what is left of the target is a budget. Documents get exponential keys
-ln(u) / quality, u from a hash of the id, are sorted by key within their source and taken while the sum of
sizes is within the budget; the document at its end is cut (or, with whole=True, taken if that is nearer).

No source is gathered: keys are cut into ranges of about `share` documents, and sums count on from range to
range. Only sums per source, and per source and range, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeline.llm.common import reliable

WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source. Sources in order of
    code points, null last, weigh `weights` in turn. A target is the smaller of most * size and weight *
    level, where the level is such that targets add up to total * all sizes: sources whose capacity per
    weight is below it are full."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    led = (weighed.withColumn("place", F.row_number().over(by_cap)).withColumn("full_before", F.coalesce(F.sum("cap").over(upto), F.lit(0)))
           .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
           .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(total)))
           .withColumn("level", (F.col("wanted") - F.col("full_before")) / F.col("weight_left")))
    # the first source, by capacity per weight, that its level does not fill sets the level for all after it
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level")))
    return (led.withColumn("level", level.over(everything)["level"])
            .select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap").cast("double"))
                    .otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).alias("target")))


def uniform(*cols: str) -> Column:
    """In (0, 1), from 52 bits of an md5: the same in every run and engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST,
        quality: str | None = None, whole: bool = False, share: int = 2_000) -> DataFrame:
    """Rows (doc_id, source, size[, quality]) with source_size, target and taken. Sizes of null or below 1
    take nothing; a null or non-positive quality counts as 1; repeated rows are documents of their own, of
    the same key. Columns named like results are replaced, others stay. No rows in, none out."""
    docs = docs.drop("source_size", "target", "taken").withColumn("size", F.coalesce("size", F.lit(0)).cast("bigint"))
    per = reliable(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n")))
    goal = targets(per.select("source", "source_size"), weights, total, most).join(
        per.select(F.col("source").alias("__s"), "__n"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    goal = reliable(goal.withColumn("__parts", F.ceil(F.col("__n") / share)).withColumnRenamed("source", "__source"))
    q = F.lit(1.0) if quality is None else F.when(F.col(quality) > 0, F.col(quality).cast("double")).otherwise(F.lit(1.0))
    keyed = docs.withColumn("__key", -F.log(uniform("doc_id")) / q)
    # exponential keys to ranges of about equal numbers; any rising function of the key would do
    keyed = keyed.join(goal, F.col("source").eqNullSafe(F.col("__source"))).withColumn(
        "__part", F.least(F.floor((1 - F.exp(-F.col("__key"))) * F.col("__parts")), F.col("__parts") - 1))
    sums = keyed.groupBy("__source", "__part").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).select(
        F.col("__source").alias("__s"), F.col("__part").alias("__p"), "__before")
    own = Window.partitionBy("__source", "__part").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumn("__own", F.sum("size").over(own)).join(
        sums, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__p")))
    upto = F.col("__before") + F.col("__own") - F.col("size")          # of the documents before this one
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("bigint")
    budget = F.round(F.col("target") - epochs * F.col("source_size")).cast("bigint")
    left = F.greatest(budget - upto, F.lit(0))
    part = (F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.least(left, F.col("size")))
    return summed.select(*docs.columns, "source_size", "target", (epochs * F.col("size") + part).cast("bigint").alias("taken"))
