"""Incremental archive and scoring: each run handles only what it has not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeline import schema
from tapeline.operators.archive import changes, keyed
from tapeline.operators.scoring import Scorer, new_scores
from tapeline.session import cut_lineage, exists
from tapeline.sources import runs
from tapeline.sources.stories import STORIES, archive_parts


def archive_batches(feed: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Merge every batch of feed rows (archive columns, `symbol`, `seq`) into the archive under `root`.

    A batch writes only the stories it adds and the tickers it finds for earlier ones (`sources.runs`); of the archive
    it reads the keys, and Spark sends the smaller side of that lookup to the larger. A retried batch replaces its own
    output and gives the same result. A missing run or a checkpoint that was reset is an error, not an empty archive.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        runs.check(spark, root, batch_id)
        keys = runs.read(spark, root, "stories", STORIES, runs.runs_after(batch_id - 1)).select("_u", "_h")

        def known(key: str, asked: DataFrame) -> DataFrame:
            # each link and headline key is registered once, and a story goes by its link
            return cut_lineage(keys.select(key, F.col("_u").alias("pos")).join(asked, key, "left_semi"))

        def together(parts: list[runs.Run]) -> runs.Tables:
            stories, tickers = archive_parts(spark, root, parts)
            return {"stories": stories, "tickers": tickers}

        entering, tickers = changes(batch, known)
        runs.add(spark, root, batch_id, {"stories": keyed(entering), "tickers": tickers.select(F.col("pos").alias("_u"), "_more")}, together)

    return (feed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def score_batches(texts: DataFrame, scorer: Scorer, cache: str, checkpoint: str) -> StreamingQuery:
    """Score each text once over all runs; copies and known texts never reach the scorer."""
    def one(batch: DataFrame, batch_id: int) -> None:
        known = None
        if exists(batch.sparkSession, cache):
            known = (batch.sparkSession.read.schema(schema.SCORES + ", batch bigint").parquet(cache)
                     .where(F.col("batch") < batch_id).drop("batch"))
        new_scores(batch, known, scorer).write.mode("overwrite").parquet(f"{cache}/batch={batch_id}")

    return (texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
