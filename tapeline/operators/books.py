"""Portfolios on their own complete days: arrays of closes and day bitmaps instead of a book of days.

A symbol is one row with its closes and, in a task, one bitmap of the days it has. A portfolio counts the days on
which all its symbols (benchmarks too) have a close: the AND of their bitmaps. Returns span dropped days. What is
shuffled is one row per holding and one array per block of portfolios and symbol; days exist only inside a task,
and portfolios of the same symbols share one matrix of returns there and are worked on together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tapeline.functions import fixed
from tapeline.operators.mixes import ANNUAL, paths
from tapeline.session import cut_lineage

VALUES = 500_000      # portfolios of the same symbols are worked on together while they have so few days between them
MANY = 200            # blocks that keep the tasks busy; beyond that they may be larger


@dataclass
class Book:
    """Portfolios of the same symbols in a task. Rows of `value` and `weight` are portfolios; their columns, and rows
    of `r`, are the symbols in order of their names."""
    keys: np.ndarray            # portfolio_id
    symbols: np.ndarray
    value: np.ndarray           # money, nan for a benchmark that is not held
    weight: np.ndarray          # share of the usable money, nan likewise; nan for all of them or for none
    is_benchmark: np.ndarray
    members: pd.DataFrame       # all rows of the block, of which `rows` are the portfolios', -1 where not held
    rows: np.ndarray
    days: np.ndarray            # days since 1970, after the first complete one
    r: np.ndarray               # symbols x days; nan after a close of zero
    fx: np.ndarray | None       # return of the currency by day, 0 where unknown

    @property
    def own(self) -> np.ndarray:
        return ~np.isnan(self.weight[0])

    @property
    def held(self) -> np.ndarray:
        return self.own & ~np.isnan(self.r).all(1)

    @property
    def each(self) -> np.ndarray:
        return np.arange(len(self.keys))

    def mix(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a day has any return, and the daily returns of fixed weights, topped back up every day, on those
        that have one: portfolios x days."""
        r = self.r[self.own]
        some = ~np.isnan(r).all(0)
        return some, self.weight[:, self.own] @ np.nan_to_num(r[:, some], posinf=np.inf, neginf=-np.inf)

    def carried(self, name: str) -> np.ndarray:
        """A column that the members carry, laid out as `value` is."""
        return np.where(self.rows >= 0, self.members[name].to_numpy(float)[self.rows], np.nan)


#: Rows of all portfolios of a book as columns, of which the first is the portfolio's place in `keys`.
Facts = Callable[[Book], Iterator[tuple]]


@dataclass
class Books:
    """Holdings and arrays dealt into blocks; `tables` may be made from them as often as needed."""
    members: DataFrame
    arrays: DataFrame
    left_out: DataFrame
    benchmarks: tuple[str, ...]

    def facts(self, facts: Facts, out: str) -> DataFrame:
        """Rows (portfolio_id, out) that `facts` gives for each portfolio with two complete days or more."""
        marks, names = self.benchmarks, ["portfolio_id", *(f.split()[0] for f in out.split(", "))]

        def one(held: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            made: list[tuple] = []
            if len(held) and len(known):
                made = [(book.keys[at], *columns) for book in _walk(held, known, marks) for at, *columns in facts(book)]
            return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*made))} if made else [], columns=names)

        kind = dict(self.members.dtypes)["portfolio_id"]
        return self.members.groupBy("_block").cogroup(self.arrays.groupBy("_beside")).applyInPandas(
            one, f"portfolio_id {kind}, {out}")


def _walk(held: pd.DataFrame, known: pd.DataFrame, benchmarks: Sequence[str]) -> Iterator[Book]:
    """Books of one block."""
    money = known["_fx"].to_numpy(bool)
    rates, known = known[money], known[~money].sort_values("_name", ignore_index=True)
    if not len(known):
        return
    days = np.unique(np.concatenate(known["days"].to_list()))
    table = np.full((len(known), len(days)), np.nan)
    for i, (d, v) in enumerate(zip(known["days"], known["values"])):
        table[i, np.searchsorted(days, d)] = v
    bitmap = np.packbits(~np.isnan(table), axis=1)
    fx = None
    if len(rates):
        fx = np.zeros(len(days))
        at = np.searchsorted(days, rates["days"].iloc[0])
        here = at < len(days)
        here[here] = days[at[here]] == rates["days"].iloc[0][here]
        fx[at[here]] = rates["values"].iloc[0][here]
    place = {s: i for i, s in enumerate(known["_name"])}
    marks = sorted({place[b] for b in benchmarks if b in place})
    if len(marks) < len(set(benchmarks)):
        return
    names = known["_name"].to_numpy()
    code, keys = pd.factorize(held["portfolio_id"])
    order = np.lexsort((held["symbol"].map(place).to_numpy(float), code))
    order = order[np.searchsorted(code[order], 0):]          # a missing portfolio_id is no portfolio
    held, code = held.iloc[order].reset_index(drop=True), code[order]
    at = held["symbol"].map(place).fillna(-1).to_numpy(np.int64)
    value = held["value"].to_numpy(float)
    total = np.bincount(code, np.nan_to_num(value), len(keys))[code]
    weight = np.divide(value, total, out=np.full(len(value), np.nan), where=total != 0)
    alike: dict[bytes, list[int]] = {}
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    marked = np.c_[at, np.isnan(weight)]
    for a, b in zip(starts, np.r_[starts[1:], len(code)]):
        alike.setdefault(marked[a:b].tobytes(), []).append(a)
    for pattern, first in alike.items():
        own = np.frombuffer(pattern, np.int64).reshape(-1, 2)[:, 0]
        if (own < 0).any():
            continue
        extra = np.array([m for m in marks if m not in own], np.int64)
        symbols = np.r_[own, extra]
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        whole = np.unpackbits(np.bitwise_and.reduce(bitmap[symbols], axis=0), count=len(days)).astype(bool)
        where = np.flatnonzero(whole)[1:]
        if not len(where):
            continue
        closes = table[symbols][:, whole]
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(closes[:, :-1] == 0, np.nan, closes[:, 1:] / closes[:, :-1] - 1.0)
        rows = np.c_[np.array(first)[:, None] + np.arange(len(own)), np.full((len(first), len(extra)), -1)][:, order]
        step = max(1, VALUES // len(where))
        for part in (rows[i:i + step] for i in range(0, len(rows), step)):
            yield Book(keys[code[part.max(1)]], names[symbols], np.where(part >= 0, value[part], np.nan),
                       np.where(part >= 0, weight[part], np.nan), np.isin(symbols, marks), held, part, days[where], r,
                       None if fx is None else fx[where])


def books(closes: DataFrame, holdings: DataFrame, min_days: int = 200, benchmarks: Sequence[str] = (),
          carry: Sequence[str] = (), fx_returns: DataFrame | None = None, keep: bool = False, block: int = 2000,
          crowded: int = 1) -> Books:
    """Holdings (portfolio_id, symbol, value) with the closes they need. Symbols with fewer than `min_days` closes
    are left out. `fx_returns` (day, r) is one row per day and goes to each block. `keep` writes the arrays once, for
    several tables. A block holds `block` holdings; where there are more than `MANY` blocks and no more than `block` symbols
    in all, up to `crowded` times as many: for facts of few rows, as portfolios of the same symbols then meet more often and
    no block has more arrays than before."""
    counts = closes.groupBy("symbol").agg(F.count("close").alias("days"))
    usable = counts.where(F.col("days") >= min_days).select("symbol")
    held = holdings.select("portfolio_id", "symbol", "value", *carry)
    left_out = held.join(usable, "symbol", "left_anti")
    members = cut_lineage(held.join(usable, "symbol", "left_semi").select("portfolio_id", "symbol", "value", *carry))
    rows, symbols = members.agg(F.count(F.lit(1)), F.approx_count_distinct("symbol")).first()
    blocks = max(1, -(-rows // block))
    if symbols <= block:
        blocks = max(min(blocks, MANY), -(-blocks // crowded))
    dealt = members.withColumn("_block", F.pmod(F.xxhash64("portfolio_id"), F.lit(blocks)))
    series = F.array_sort(F.collect_list(F.struct(F.unix_date("day").alias("d"), F.col("close").alias("c"))))
    arrays = closes.where(F.col("close").isNotNull()).join(usable, "symbol", "left_semi").groupBy(
        F.col("symbol").alias("_name")).agg(series.alias("s")).select("_name", F.col("s.d").alias("days"), F.col("s.c").alias("values"))
    wanted = dealt.select(F.col("_block").alias("_beside"), F.col("symbol").alias("_name"))
    every = closes.sparkSession.range(blocks).select(F.col("id").alias("_beside"))
    if benchmarks:
        wanted = wanted.unionByName(every.withColumn("_name", F.explode(F.array(*[F.lit(b) for b in benchmarks]))))
    beside = wanted.distinct().join(arrays, "_name").select("_beside", "_name", "days", "values", F.lit(False).alias("_fx"))
    if fx_returns is not None:
        rates = fx_returns.where(F.col("r").isNotNull()).agg(F.array_sort(F.collect_list(
            F.struct(F.unix_date("day").alias("d"), F.col("r").alias("c")))).alias("s")).select(
            F.lit(True).alias("_fx"), F.col("s.d").alias("days"), F.col("s.c").alias("values"))
        # one row, beside each block
        beside = beside.unionByName(every.withColumn("_fx", F.lit(True)).join(rates, "_fx").withColumn("_name", F.lit(None).cast("string")))
    return Books(dealt, cut_lineage(beside) if keep else beside, left_out.select("portfolio_id", "symbol", "value"), tuple(benchmarks))


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, np.nan)


def _by_portfolio(book: Book, *columns: np.ndarray) -> tuple:
    """Rows that hold for every portfolio of a book."""
    n = len(book.keys)
    return (np.repeat(book.each, len(columns[0])), *(np.tile(c, n) for c in columns))


def risk_facts(book: Book) -> Iterator[tuple]:
    """symbol, value, weight, risk_pct, own_volatility_pct of each holding with a return."""
    some, mix = book.mix()
    for i in np.flatnonzero(book.held):
        r, w = book.r[i, some], book.weight[:, i]
        here = ~np.isnan(r)
        n = here.sum()
        a, m = r[here] - r[here].mean(), mix[:, here] - mix[:, here].mean(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            risk = w * (a * m).sum(1) / (m * m).sum(1) * 100.0 if n > 1 else np.full(len(w), np.nan)
            swing = np.sqrt((a * a).sum() / (n - 1)) * ANNUAL if n > 1 else np.nan
        yield book.each, np.full(len(w), book.symbols[i], object), book.value[:, i], w, _finite(risk), _finite(np.full(len(w), swing))


RISK = "symbol string, value double, weight double, risk_pct double, own_volatility_pct double"


def effective_facts(book: Book) -> Iterator[tuple]:
    """Effective number of holdings."""
    w = book.weight[:, book.held]
    if w.shape[1]:
        squares = (w * w).sum(1)
        yield book.each, np.divide(1.0, squares, out=np.full(len(w), np.nan), where=squares != 0)


MIX = "Your mix"


def named_series(book: Book) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(symbol, days, returns) of the mix, without a symbol, and of each benchmark alone: one row per portfolio, or one
    that holds for all of them."""
    if book.held.any():
        some, mix = book.mix()
        yield "", book.days[some], mix
    for i in np.flatnonzero(book.is_benchmark):
        here = ~np.isnan(book.r[i])
        if here.any():
            yield book.symbols[i], book.days[here], book.r[i][None, here]


def line_names(benchmarks: Sequence[str]) -> list[str]:
    """Names of the lines that `growth_facts` numbers."""
    return [MIX, *(f"Just {b}" for b in benchmarks)]


def growth_facts(benchmarks: Sequence[str]) -> Facts:
    """line (its place in `line_names`), day, return and what 100 has grown to."""
    def facts(book: Book) -> Iterator[tuple]:
        n = len(book.keys)
        for symbol, days, r in named_series(book):
            line = list(benchmarks).index(symbol) + 1 if symbol else 0
            shape = n, len(days)
            yield (np.repeat(book.each, len(days)), np.full(n * len(days), line, np.int32), np.tile(days.astype(np.int32), n),
                   *(np.broadcast_to(x, shape).ravel() for x in (r, 100.0 * np.cumprod(1.0 + r, axis=1))))
    return facts


GROWTH = "line int, days int, r double, growth double"


def comparison_facts(book: Book) -> Iterator[tuple]:
    """name, what 100 became, volatility and worst drawdown."""
    for symbol, _, r in named_series(book):
        grown, volatility, drop = (np.broadcast_to(x, len(book.keys)) for x in paths(r))
        yield book.each, np.full(len(book.keys), f"Just {symbol}" if symbol else MIX, object), 100.0 * grown, _finite(volatility), _finite(drop)


def correlation_facts(book: Book) -> Iterator[tuple]:
    """sym_a < sym_b, correlation and days of each pair of holdings, by one matrix product."""
    own = book.held
    names, r = book.symbols[own], book.r[own]
    here = (~np.isnan(r)).astype(float)
    x = np.where(here > 0, r - (np.nansum(r, 1) / here.sum(1))[:, None], 0.0)
    n = here @ here.T
    with np.errstate(divide="ignore", invalid="ignore"):
        sums = x @ here.T
        squares = (x * x) @ here.T - sums * sums / n
        corr = (x @ x.T - sums * sums.T / n) / np.sqrt(squares * squares.T)
    i, j = np.triu_indices(len(names), 1)
    some = n[i, j] > 0
    i, j = i[some], j[some]
    if len(i):
        yield _by_portfolio(book, names[i], names[j], _finite(corr[i, j]), n[i, j].astype(np.int64))


def ewma_last(r: np.ndarray, lam: float = fixed.EWMA_LAMBDA) -> np.ndarray:
    """Last exponentially weighted volatility of each row in %: v_0 = r_0^2, v_t = lam v_(t-1) + (1 - lam) r_t^2."""
    if not r.shape[1]:
        return np.full(len(r), np.nan)
    weight = (1.0 - lam) * lam ** np.arange(r.shape[1] - 1, -1, -1.0)
    weight[0] /= 1.0 - lam
    return np.sqrt((weight * r * r).sum(1)) * ANNUAL


def rolling_last(r: np.ndarray, rows: int) -> float:
    """Volatility of the last `rows` returns in %; nan if there are fewer."""
    if len(r) < rows:
        return np.nan
    part = r[-rows:]
    spread, squares = ((part - part.mean()) ** 2).sum(), (part * part).sum()
    return float(np.sqrt(spread / (rows - 1))) * ANNUAL if spread > squares * 1e-14 else 0.0


def outlook_facts(rows: int) -> Facts:
    """symbol (null: the whole mix) and its volatility. If any holding has fewer than `rows` returns all holdings
    take the exponentially weighted one; the mix always does."""
    def facts(book: Book) -> Iterator[tuple]:
        seen = book if book.fx is None else replace(book, r=(1.0 + book.r) / (1.0 + book.fx) - 1.0)
        own = [(s, x[~np.isnan(x)]) for s, x in zip(seen.symbols, seen.r) if not np.isnan(x).all()]
        recent = [rolling_last(x, rows) for _, x in own]
        if any(np.isnan(x) for x in recent):
            recent = [float(ewma_last(x[None])[0]) for _, x in own]
        if own:
            yield _by_portfolio(book, np.array([s for s, _ in own], object), _finite(np.array(recent)))
        some, mix = seen.mix()
        if some.any() and seen.own.any():
            yield book.each, np.full(len(book.keys), None, object), _finite(ewma_last(mix))
    return facts


def plan_facts(months: Sequence[int]) -> Facts:
    """month, what 100 became, volatility, worst drawdown and days of the mix planned for each month; members carry
    `_plan0`, `_plan1`, ...: the money of each month, null where it is not above zero."""
    def facts(book: Book) -> Iterator[tuple]:
        known, r, n = ~np.isnan(book.r), np.nan_to_num(book.r, posinf=np.inf, neginf=-np.inf), len(book.keys)
        w = np.nan_to_num(np.concatenate([book.carried(f"_plan{i}") for i in range(len(months))]))
        place, month = np.tile(book.each, len(months)), np.repeat(months, n)
        # the days of a mix follow from which symbols it has, whatever the month
        kinds, kind = np.unique(w > 0, axis=0, return_inverse=True)
        for k, some in enumerate(kinds):
            here = known[some].any(0)
            days = int(here.sum())
            if days:
                of, step = np.flatnonzero(kind.ravel() == k), max(1, VALUES // days)
                for at in (of[i:i + step] for i in range(0, len(of), step)):
                    part = w[at][:, some]
                    money = part.sum(1, keepdims=True) if known[some][:, here].all() else part @ known[some][:, here]
                    grown, volatility, drop = paths(part @ r[some][:, here] / money)
                    yield (place[at], month[at], 100.0 * grown, _finite(volatility), _finite(drop), np.full(len(at), days, np.int64))
    return facts
