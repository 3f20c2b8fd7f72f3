"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def key_salts(counts: DataFrame, on: Sequence[str], n: str = "n") -> DataFrame:
    """(on, _salts): for each key with more rows than an even share of a shuffle partition, into how many
    parts it is cut so that each is about one share. With p partitions fewer than p keys can have that
    many rows and their parts add up to less than 2 p, which is the bound that makes the table safe to
    broadcast, whatever the data."""
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = counts.agg(F.sum(n)).scalar() / F.lit(float(partitions))
    return counts.where(F.col(n) > share).select(*on, F.ceil(F.col(n) / share).cast("int").alias("_salts"))


def salted_join(big: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner",
                counts: DataFrame | None = None) -> DataFrame:
    """Equi join that spreads the heavy keys of `big` over as many tasks as their share of its rows asks
    for; lookup rows are repeated for those keys alone. `counts` (on, n) may be given where a cheaper table
    than `big` has them. The salt is a hash of the row, so a retried task sends the same row to the same
    place.
    """
    on = list(on)
    if counts is None:
        counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    heavy = F.broadcast(key_salts(counts, on))
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*big.columns), F.col("_salts")).cast("int"))
    every = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1))
    left = big.join(heavy, on, "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_salts")
    right = (lookup.join(heavy, on, "left")
             .withColumn("_salt", F.explode(F.coalesce(every, F.array(F.lit(0))))).drop("_salts"))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
