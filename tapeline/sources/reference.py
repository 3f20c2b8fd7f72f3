"""Small dimension tables built from fixed values; their size is known when they are written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tapeline.functions import fixed


def sectors(spark: SparkSession, table: Mapping[str, str | Sequence[str]] = fixed.SECTORS) -> DataFrame:
    """Sector by symbol, from a map of symbols to their sector or of sectors to their symbols."""
    rows = [(k, v) if isinstance(v, str) else (x, k) for k, v in table.items() for x in ([k] if isinstance(v, str) else v)]
    return spark.createDataFrame(rows, "symbol string, sector string")


def funds(spark: SparkSession, symbols: Sequence[str] = fixed.FUNDS) -> DataFrame:
    return spark.createDataFrame([(s,) for s in symbols], "symbol string")


def market_names(spark: SparkSession, names: Mapping[str, str] = fixed.MARKET_NAMES) -> DataFrame:
    return spark.createDataFrame(list(names.items()), "symbol string, name string")
