"""Writers. Tables being read are never overwritten in place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeline import schema
from tapeline.functions.textual import article_id
from tapeline.session import exists


def save_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """CSV with a header; doubles rounded when asked."""
    if decimals is not None:
        df = df.select(*[F.round(c, decimals).alias(c) if t == "double" else F.col(c)
                         for c, t in df.dtypes])
    df.write.mode("overwrite").option("header", True).csv(path)


def append_decisions(decisions: DataFrame, path: str) -> None:
    """Add one run to the log, one folder per run date and run. A rerun of the same run (its `time`) replaces
    what it wrote before. Rows are laid out by run first, a large run in several files, so that a log of
    many runs is not cut into a file per task and run."""
    run = F.date_format("time", "yyyyMMdd'T'HHmmss").alias("run")
    decisions.select("*", run).hint("rebalance", "run_date", "run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run_date", "run").parquet(path)


def save_version(df: DataFrame, root: str) -> str:
    """Write a whole table as a new version and return its folder. The caller moves readers over, so
    a job may read the old version while the new one is written."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def save_articles(extracted: DataFrame, path: str) -> None:
    """Add the texts that were worth saving, one per hash of the link; those already there stay as they are."""
    saved = extracted.where(F.col("text_status") == "saved").select(
        article_id(F.col("url")).alias("article_id"), "url", "text", F.col("n_chars").cast("int"))
    # of several texts of one link the first in order stays, whatever the partitions
    first = F.min(F.struct("url", "text", "n_chars")).alias("first")
    saved = saved.groupBy("article_id").agg(first).select("article_id", "first.*")
    if exists(saved.sparkSession, path):
        known = saved.sparkSession.read.schema(schema.ARTICLES).parquet(path).select("article_id")
        saved = saved.join(known, "article_id", "left_anti")
    saved.write.mode("append").parquet(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ARTICLES).parquet(path)
