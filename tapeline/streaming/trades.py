"""Live trades: bars, session state and a stored trade log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeline import schema
from tapeline.operators.prices import moment


def file_trades(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Trades arriving as Parquet files. Kafka or another source gives the same columns."""
    reader = spark.readStream.schema(schema.TRADES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def bars(trades: DataFrame, width: str = "1 minute", slide: str | None = None,
         late: str = "2 minutes") -> DataFrame:
    """OHLCV bars per symbol and window, put out once a window is `late` behind the newest trade. State holds
    one row per open window and symbol; partial aggregation combines a busy symbol's trades before they
    move. For live feeds: trades later than `late` are dropped and the last windows stay open. Stored
    trades go through `collect_bars`, which loses none."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    at = moment()
    return (trades.withWatermark("ts", late).groupBy(window.alias("w"), "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"))
        .select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                "open", "high", "low", "close", "volume", "trades"))


def collect_bars(trades: DataFrame, root: str, checkpoint: str, width: str = "1 minute", slide: str | None = None) -> StreamingQuery:
    """Every batch's part of each bar, written under `root/batch=b`; `read_bars` puts the parts together.

    Nothing is held in state and nothing is too late: the bars equal those of the whole input, in whatever
    order and number of batches it comes. A retried batch replaces its own parts.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)

    def one(batch: DataFrame, batch_id: int) -> None:
        at = moment().alias("at")
        entry = F.struct(at, F.col("price").alias("price"))
        parts = batch.groupBy(window.alias("w"), "symbol").agg(
            F.min_by(entry, at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by(entry, at).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"))
        parts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "symbol", "open", "high", "low", "close",
                     "volume", "trades").write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return (trades.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_bars(spark: SparkSession, root: str) -> DataFrame:
    """Bars from the parts that `collect_bars` has written so far."""
    parts = spark.read.parquet(root)
    return parts.groupBy("symbol", "start", "end").agg(
        F.min_by("open.price", "open.at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close.price", "close.at").alias("close"), F.sum("volume").alias("volume"), F.sum("trades").alias("trades"))


def session_state(day_bars: DataFrame) -> DataFrame:
    """Latest price, high, low and change since the open of each symbol's day, from bars of one day."""
    return day_bars.select("symbol", F.to_date("start").alias("day"), F.col("close").alias("price"), "high", "low",
                           ((F.try_divide(F.col("close"), F.col("open")) - 1.0) * 100.0).alias("change_pct"))


def store(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True,
          every: str | None = None, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once through its checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every or "5 seconds")
    return writer.start(path)


def listen(query: StreamingQuery, seconds: int | None = None) -> None:
    """Wait for the stream to finish, at most `seconds`, and stop it."""
    query.awaitTermination(seconds) if seconds else query.awaitTermination()
    query.stop()
