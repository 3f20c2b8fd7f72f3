"""Statistics of mixes of weighted holdings, without a table of holdings x days.

A symbol's returns are one row with an array. Portfolios are dealt into blocks of about `holdings` weights,
and each block gets the array of every symbol in it once, however many of its portfolios hold it; those of the same
symbols are worked on together, as products of matrices. What is
shuffled is one row per weight and one array per block and symbol; days exist only inside a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tapeline.functions import fixed
from tapeline.operators.portfolio import uncovered
from tapeline.session import cut_lineage

P = ("portfolio_id",)
ANNUAL = np.sqrt(float(fixed.TRADING_DAYS_PER_YEAR)) * 100.0
#: Of one mix: its rows of weights, the matrix of returns (holdings x days, nan where missing), the days.
Facts = Callable[[pd.DataFrame, np.ndarray, np.ndarray], Iterator[tuple]]
#: Of mixes of the same symbols: all rows of weights, where theirs are (mixes x holdings), that matrix and the days.
#: Rows are columns, of which the first is the mix's place.
AlikeFacts = Callable[[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]]
VALUES = 500_000      # mixes of the same symbols are worked on together while they have so few days between them


def over_mixes(returns: DataFrame, weights: DataFrame, facts: Facts, out: str, keys: Sequence[str] = P,
               carry: Sequence[str] = (), holdings: int = 2000) -> DataFrame:
    """Rows (keys, out) that `facts` gives for each mix, one by one. Holdings without any return take no part; a mix of
    none but such gives no rows."""
    def one_by_one(held, rows, block, days):
        made = [(i, *row) for i, part in enumerate(rows) for row in facts(held.iloc[part], block, days)]
        if made:
            yield tuple(pd.Series(c).to_numpy() for c in zip(*made))
    return over_alike(returns, weights, one_by_one, out, keys, carry, holdings)


def over_alike(returns: DataFrame, weights: DataFrame, facts: AlikeFacts, out: str, keys: Sequence[str] = P,
               carry: Sequence[str] = (), holdings: int = 2000) -> DataFrame:
    """The same from facts that take all mixes of the same symbols at once."""
    keys = list(keys)
    weights = cut_lineage(weights.select(*keys, "symbol", "weight", *carry))
    blocks = max(1, -(-weights.count() // holdings))
    dealt = weights.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)))
    series = F.array_sort(F.collect_list(F.struct(F.unix_date("day").alias("d"), F.col("r").alias("r"))))
    arrays = returns.where(F.col("r").isNotNull()).groupBy("symbol").agg(series.alias("s")).select(
        "symbol", F.col("s.d").alias("days"), F.col("s.r").alias("values"))
    beside = dealt.select(F.col("_block").alias("_beside"), F.col("symbol").alias("_name")).distinct().join(
        arrays.withColumnRenamed("symbol", "_name"), "_name").select("_beside", "_name", "days", "values")
    names = [*keys, *(f.split()[0] for f in out.split(", "))]

    def one(held: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        made: list[tuple] = []
        if len(held) and len(known):
            days = np.unique(np.concatenate([np.asarray(d) for d in known["days"]]))
            table = np.full((len(known), len(days)), np.nan)
            for i, (d, v) in enumerate(zip(known["days"], known["values"])):
                table[i, np.searchsorted(days, d)] = v
            place = {s: i for i, s in enumerate(known["_name"])}
            held = held[held["symbol"].isin(place)].sort_values([*keys, "symbol"], ignore_index=True)
            for rows, symbols in alike(held.groupby(keys, sort=False).ngroup().to_numpy(), held["symbol"].map(place).to_numpy(np.int64)):
                block = table[symbols]
                some = ~np.isnan(block).all(0)
                block, step = block[:, some], max(1, VALUES // max(1, some.sum()))
                for part in (rows[i:i + step] for i in range(0, len(rows), step)):
                    own = [held[k].to_numpy()[part[:, 0]] for k in keys]
                    made += [(*(k[at] for k in own), *columns) for at, *columns in facts(held, part, block, days[some])]
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*made))} if made else [], columns=names)

    kinds = dict(weights.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), out])
    return dealt.groupBy("_block").cogroup(beside.groupBy("_beside")).applyInPandas(one, schema)


def alike(code: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of equal `code`, which is sorted into runs, by what they hold: (rows, the `at` that each row of rows has).
    Rows without a code are left out."""
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    found: dict[bytes, list[int]] = {}
    for a, b in zip(starts, np.r_[starts[1:], len(code)]):
        if code[a] >= 0:
            found.setdefault(at[a:b].tobytes(), []).append(a)
    for first in found.values():
        n = int(np.searchsorted(starts, first[0], "right"))
        size = (starts[n] if n < len(starts) else len(code)) - first[0]
        yield np.array(first)[:, None] + np.arange(size), at[first[0]:first[0] + size]


def _daily(weight: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Daily return of fixed weights, topped back up every day."""
    return np.nansum(weight[:, None] * block, axis=0)


def paths(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Growth factor, volatility and worst drawdown of each row of returns; a path starts after its first return."""
    path = np.cumprod(1.0 + r, axis=1)
    peak = np.maximum.accumulate(path, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        drop = np.where(peak == 0, np.nan, (path - peak) / peak)
    volatility = np.std(r, axis=1, ddof=1) * ANNUAL if r.shape[1] > 1 else np.full(len(r), np.nan)
    return path[:, -1], volatility, np.fmin.reduce(drop, axis=1) * 100.0


def _path(r: np.ndarray) -> tuple[float, float, float]:
    """The same of one series."""
    return tuple(float(x[0]) for x in paths(r[None]))


def refuse_uncovered(returns: DataFrame, weights: DataFrame, shown: int = 10) -> None:
    """Raises if a holding has no return at all: the mix of its portfolio would not be what it says."""
    bare = uncovered(weights, returns.where(F.col("r").isNotNull())).select("symbol").distinct()
    names = [r.symbol for r in bare.orderBy("symbol").limit(shown).collect()]       # a message of set length
    if names:
        raise ValueError(f"no returns for {', '.join(map(str, names))}{' and maybe more' if len(names) == shown else ''}")


def _together(held: pd.DataFrame, rows: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and daily returns of mixes of the same symbols."""
    w = held["weight"].to_numpy(float)[rows]
    return w, np.nan_to_num(w) @ np.nan_to_num(block, posinf=np.inf, neginf=-np.inf)


def evaluate_mixes(returns: DataFrame, weights: DataFrame, keys: Sequence[str] = P, strict: bool = False) -> DataFrame:
    """One row per portfolio: growth, volatility, drawdown, days, effective number of holdings. `strict`
    refuses holdings without any return, which are left out otherwise."""
    if strict:
        refuse_uncovered(returns, weights)

    def facts(held, rows, block, days):
        w, r = _together(held, rows, block)
        grown, volatility, drop = paths(r)
        squares = ((w * w) @ np.unique(~np.isnan(block), axis=1)).max(1)
        yield (np.arange(len(rows)), 100.0 * grown, volatility, drop, np.full(len(rows), len(days)),
               np.divide(1.0, squares, out=np.full(len(rows), np.nan), where=squares != 0))
    return over_alike(returns, weights, facts, "grown_100 double, volatility_pct double, biggest_drop_pct double, days bigint, effective double", keys)


def yearly_mixes(returns: DataFrame, weights: DataFrame, keys: Sequence[str] = P) -> DataFrame:
    """Each portfolio one calendar year at a time; growth starts again each year."""
    def facts(held, rows, block, days):
        _, r = _together(held, rows, block)
        years = days.astype("datetime64[D]").astype("datetime64[Y]").astype(int) + 1970
        n = len(rows)
        for part in np.split(np.arange(len(days)), np.flatnonzero(np.diff(years)) + 1):
            grown, volatility, drop = paths(r[:, part])
            yield np.arange(n), np.full(n, years[part[0]], np.int32), 100.0 * grown - 100.0, volatility, drop, np.full(n, len(part))
    return over_alike(returns, weights, facts, "year int, return_pct double, volatility_pct double, biggest_drop_pct double, days bigint", keys)


def mix_risk_shares(returns: DataFrame, weights: DataFrame, keys: Sequence[str] = P) -> DataFrame:
    """Share of the mix's risk from each holding, w * cov(r, mix) / var(mix) in %, and its own volatility."""
    def facts(held, rows, block, days):
        w, mix = _together(held, rows, block)
        symbols, nothing = held["symbol"].to_numpy()[rows], np.full(len(rows), np.nan)
        for i, r in enumerate(block):
            here = ~np.isnan(r)
            risk, own, n = nothing, nothing, here.sum()
            if n > 1:
                a, m = r[here] - r[here].mean(), mix[:, here] - mix[:, here].mean(1, keepdims=True)
                own = np.full(len(rows), np.sqrt((a * a).sum() / (n - 1)) * ANNUAL)
                squares = (m * m).sum(1)
                risk = np.divide(w[:, i] * (a * m).sum(1), squares, out=nothing.copy(), where=squares != 0) * 100.0
            yield np.arange(len(rows)), symbols[:, i], w[:, i], risk, own
    return over_alike(returns, weights, facts, "symbol string, weight double, risk_pct double, own_volatility_pct double", keys)
