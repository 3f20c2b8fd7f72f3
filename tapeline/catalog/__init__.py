"""Registered queries: each runs an operator over the driver's tables, beside the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def _nudge(decimals: int) -> float:
    """Averages of decimal prices often end exactly on a rounding tie, which the last bit of a sum decides:
    what is within a thousandth of the unit below a tie rounds up."""
    return 0.001 * 10.0 ** -decimals


def _round(x: Column, places: int) -> Column:
    """`F.round` by arithmetic of doubles, as a decimal of each value costs more than making the value. What is near
    a tie, large values, whose last digits are coarse beside a unit, and what is no number are left to `F.round`."""
    units = F.abs(x) * F.lit(10.0 ** places)
    clear = (units < F.lit(2.0 ** 40)) & (F.abs(units - F.floor(units) - F.lit(0.5)) > F.lit(2.0 ** -11))
    near = F.signum(x) * F.floor(units + F.lit(0.5)) / F.lit(10.0 ** places) + F.lit(0.0)     # no -0.0
    return F.when(clear, near).otherwise(F.round(x, places))


def rounded(df: DataFrame, decimals: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison, counts as bigint."""
    def col(name: str, kind: str) -> Column:
        if kind == "double":
            places = special.get(name, decimals)
            return _round(F.col(name) + F.lit(_nudge(places)), places).alias(name)
        return F.col(name).cast("bigint").alias(name) if kind in ("int", "bigint") else F.col(name)
    return df.select(*[col(n, k) for n, k in df.dtypes])


def r(expression: str, decimals: int = 6) -> str:
    """The same rounding in SQL."""
    nudged = f"({expression}) + CAST({_nudge(decimals)!r} AS DOUBLE)"
    return f"(round({nudged}, {decimals}) + CAST(0 AS DOUBLE))"   # no -0.0
