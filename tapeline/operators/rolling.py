"""Rolling sums and deviations over long windows in a few lookups per row.

A sliding frame is re-added from scratch for every row, which makes a 252-row window cost 252
steps. Here sums over 1, 2, 4, 8, ... rows are built by doubling (each is two neighbours of the one
before), and any window is put together from those: about log2(n) lookups per row, no differences
of running totals and so no cancellation. All steps share one partitioning and sort. A window that
is not full yet, or holds a null, is null.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tapeline.operators.prices import timeline


def _powers(rows: int) -> list[int]:
    """Powers of two adding up to `rows`, largest first."""
    return [1 << b for b in range(rows.bit_length() - 1, -1, -1) if rows >> b & 1]


def window_sums(values: np.ndarray, sizes: Sequence[int]) -> Iterator[np.ndarray]:
    """The same sums of one series inside a task, size by size; nan where a window is not full or holds a nan."""
    def back(x: np.ndarray, rows: int) -> np.ndarray:
        return np.r_[np.full(min(rows, len(x)), np.nan), x[:max(0, len(x) - rows)]]

    sums = {1: values}
    p = 1
    while p < max(_powers(max(sizes))):
        sums[2 * p] = sums[p] + back(sums[p], p)
        p *= 2
    for rows in sizes:
        first, *rest = _powers(rows)
        out, seen = sums[first], first
        for size in rest:
            out, seen = out + back(sums[size], seen), seen + size
        yield out


def _with_sums(df: DataFrame, totals: Mapping[str, tuple[Column, int]], keys: Sequence[str]) -> DataFrame:
    w = timeline(keys)
    values = {}
    for value, _ in totals.values():
        values.setdefault(str(value), (f"_v{len(values)}", value))
    df = df.withColumns({f"{tag}_1": value for tag, value in values.values()})
    largest = max(_powers(max(rows for _, rows in totals.values())))
    p = 1
    while p < largest:
        df = df.withColumns({f"{tag}_{2 * p}": F.col(f"{tag}_{p}") + F.lag(f"{tag}_{p}", p).over(w)
                             for tag, _ in values.values()})
        p *= 2

    def total(tag: str, rows: int) -> Column:
        first, *rest = _powers(rows)
        out, back = F.col(f"{tag}_{first}"), first
        for size in rest:
            out, back = out + F.lag(f"{tag}_{size}", back).over(w), back + size
        return out

    df = df.withColumns({name: total(values[str(value)][0], rows)
                         for name, (value, rows) in totals.items()})
    return df.drop(*[f"{tag}_{1 << b}" for tag, _ in values.values() for b in range(p.bit_length())])


def with_sums(df: DataFrame, value: str, sizes: Mapping[str, int],
              keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add the sum of the last n rows for each name -> n."""
    return _with_sums(df, {name: (F.col(value), rows) for name, rows in sizes.items()}, keys)


def with_stddevs(df: DataFrame, value: str, sizes: Mapping[str, int],
                 keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add the sample standard deviation of the last n rows for each name -> n.

    Meant for returns, whose mean is small beside their spread: then sum(x^2) - sum(x)^2 / n keeps
    its digits. What is left of a constant series is noise and counts as zero.
    """
    x = F.col(value)
    totals = {f"_t_{name}": (x, rows) for name, rows in sizes.items()}
    totals |= {f"_q_{name}": (x * x, rows) for name, rows in sizes.items()}
    df = _with_sums(df, totals, keys)

    def deviation(name: str, rows: int) -> Column:
        squares = F.col(f"_q_{name}")
        spread = squares - F.col(f"_t_{name}") * F.col(f"_t_{name}") / rows
        return F.sqrt(F.when(spread > squares * 1e-14, spread / (rows - 1))
                      .when(spread.isNotNull(), F.lit(0.0)))

    df = df.withColumns({name: deviation(name, rows) for name, rows in sizes.items()})
    return df.drop(*totals)
