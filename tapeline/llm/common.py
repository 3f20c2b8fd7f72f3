"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeline.session import cut_lineage, shared_dir

#: A word: a run of characters that are neither space nor tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = (1 << 63) - 1          # stands for a null id, after all others


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reliable(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder: read again instead of computed again."""
    return cut_lineage(df)


def written(df: DataFrame) -> DataFrame:
    """As `reliable`, but packed as Parquet, for wide tables; the folder stays until the shared folder is cleared."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column | str) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("bigint")


def as_bytes(text: Column | str) -> Column:
    """UTF-8 bytes, empty for null: Python then splits words without decoding."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string").cast("binary"), F.lit(b""))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller pieces of Arrow batches, so that lists of texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_size(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of Arrow batches with about `most` bytes in a binary column (a longer row is a piece; a null has none)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(new, np.r_[new[1:], len(part)]):
            yield batch.slice(int(a), int(b - a))


def components(edges: DataFrame) -> DataFrame:
    """(src, dst) links to (src, root): the smallest node reachable, for every node that has a link and
    is not itself the smallest. Alternates large and small stars until nothing changes; each round is
    written to the checkpoint folder. Nulls and loops are ignored; no links give no rows."""
    pair = edges.filter("src is not null and dst is not null and src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    stars, before = reliable(pair), None
    while True:
        both = stars.unionByName(stars.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("src", "low"))
        large = both.join(low, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        joined = large.join(low, "src")
        small = joined.filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(
            low.select("src", F.col("low").alias("dst"))).distinct()
        stars = reliable(small)
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return stars.select("src", F.col("dst").alias("root"))
        before = state
