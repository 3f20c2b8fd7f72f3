"""Periodic runs of words, by an enhanced suffix array and the branching-tandem test.

A run is a stretch of words with smallest period q, at least `max(least, 2 * q)` words long, that no neighbouring
word extends. Every run ends in a branching square: two equal blocks of q words whose next words differ. Two
starts i and i + q of such blocks share exactly q words, so they lie on different sides of a cut of depth q in
the suffix array. Each LCP value is such a cut: its interval is told by the next smaller values on both sides,
and every suffix i of the smaller side is tested for ISA[i - q] and ISA[i + q] on the other side. There are no
tree nodes, and n log n tests in all. A square found is rotated to the left for as long as its words agree, which
gives the run; squares of one end whose root repeats a shorter one belong to the shorter root's run.

Texts of one batch share a suffix array, with a mark of its own after each stretch. Only stretches that can hold a
run enter it: any `least // 2` neighbouring words of a run of `least` words and more are found again within its
text, or lie under words that are, so words outside all such repeats are left out beforehand.

Each text is settled by itself: there is no shuffle, and a task's memory follows the larger of a batch
(`BATCH` bytes of text) and its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tapeline.llm.common import as_bytes, by_size, mix

LEAST, BATCH = 12, 2_000_000
BLOCK = 2_000_000                       # suffixes tested at a time


class Numbers(dict):
    """Words to numbers from 0, in the order of their coming."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(SA, ISA) of a sequence of non-negative numbers, by doubling the compared length."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step, order = 1, np.argsort(rank, kind="stable")
    while n and rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        both = rank * (n + 1) + after
        order = np.argsort(both, kind="stable")
        both = both[order]
        rank[order] = np.cumsum(np.r_[0, both[1:] != both[:-1]])
        step *= 2
    return order, rank


def _agree(s: np.ndarray, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
    """How many neighbouring words from a and b on (way 1: to the right, -1: to the left) are equal; a < b.
    Compared in blocks that double, so the work follows the answer."""
    out, todo, width = np.zeros(len(a), np.int64), np.arange(len(a)), 8
    while len(todo):
        far = out[todo, None] + np.arange(width)
        x, y = a[todo, None] + way * far, b[todo, None] + way * far
        inside = (y < len(s)) if way > 0 else (x >= 0)
        same = inside & (s[np.where(inside, x, 0)] == s[np.where(inside, y, 0)])
        whole = same.all(1)
        out[todo] += np.where(whole, width, np.argmin(same, 1))
        todo = todo[whole]
        width = min(2 * width, max(8, BLOCK // max(1, len(todo))))
    return out


def common_prefixes(s: np.ndarray, sa: np.ndarray, isa: np.ndarray) -> np.ndarray:
    """LCP[r]: equal words of the suffixes of ranks r - 1 and r; 0 at rank 0. In text order, a value whose
    suffix and predecessor are preceded by one and the same word is one less than the value before it; only
    the others are compared, n log n words in all."""
    n = len(s)
    before = np.empty(n, np.int64)                      # the suffix that stands before suffix i
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    at = np.arange(n)
    own = (at == 0) | (before <= 0) | (s[at - 1] != s[np.maximum(before, 1) - 1])
    own[1:] |= before[:-1] < 0
    some = np.flatnonzero(own & (before >= 0))
    low, high = np.minimum(some, before[some]), np.maximum(some, before[some])
    value = np.zeros(n, np.int64)
    for k in range(0, len(some), BLOCK // 8):
        value[some[k:k + BLOCK // 8]] = _agree(s, low[k:k + BLOCK // 8], high[k:k + BLOCK // 8], 1)
    last = np.maximum.accumulate(np.where(own, at, 0))
    return (value[last] - (at - last))[sa]


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per cut r the ranks [first, last] around it that share LCP[r] words: from the last value at most as
    large on its left to the next smaller one on its right. Of equal cuts the leftmost holds the others."""
    n = len(lcp)
    first, last, stack = np.zeros(n, np.int64), np.full(n, n - 1, np.int64), []
    left, right = first.tolist(), last.tolist()
    for r, v in enumerate(lcp.tolist()):
        while stack and stack[-1][1] > v:
            right[stack.pop()[0]] = r - 1
        left[r] = stack[-1][0] if stack else 0
        stack.append((r, v))
    return np.array(left, np.int64), np.array(right, np.int64)


def branching_squares(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares whose blocks are followed by different words (or by the end)."""
    n = len(s)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    sa, isa = suffix_array(s)
    lcp = common_prefixes(s, sa, isa)
    first, last = intervals(lcp)
    cut = np.flatnonzero(lcp > 0)
    # the sides of cut r are ranks [first, r - 1] and [r, last]
    left_small = cut - first[cut] <= last[cut] - cut + 1
    lo = np.where(left_small, first[cut], cut)
    size = np.where(left_small, cut - first[cut], last[cut] - cut + 1)
    other_lo, other_hi = np.where(left_small, cut, first[cut]), np.where(left_small, last[cut], cut - 1)
    depth, total = lcp[cut], np.r_[0, np.cumsum(size)]
    starts, periods = [none], [none]
    a = 0
    while a < len(cut):
        b = max(a + 1, int(np.searchsorted(total, total[a] + BLOCK, "right")) - 1)
        of = np.repeat(np.arange(a, b), size[a:b])
        i = sa[lo[of] + np.arange(len(of)) - (total[of] - total[a])]
        q = depth[of]
        for start, mate in ((i, i + q), (i - q, i - q)):
            ok = (mate >= 0) & (mate < n)
            rank = isa[np.where(ok, mate, 0)]
            hit = np.flatnonzero(ok & (rank >= other_lo[of]) & (rank <= other_hi[of]))
            starts.append(start[hit])
            periods.append(q[hit])
        a = b
    return np.concatenate(starts), np.concatenate(periods)


def runs(s: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    start, period = branching_squares(s)
    none, found = np.zeros(0, np.int64), []
    if least > 2:                                         # short squares that cannot grow to `least` words go first
        for k in range(1, least - 1):
            able = (2 * period + k > least) | ((start >= k) & (s[start - k] == s[start - k + period]))
            start, period = start[able], period[able]
    end = start + 2 * period
    while len(start):
        order = np.lexsort((period, end))
        start, period, end = start[order], period[order], end[order]
        new = np.r_[True, end[1:] != end[:-1]]
        head = np.flatnonzero(new)
        grown = _agree(s, start[head] - 1, start[head] - 1 + period[head], -1)
        begin = start[head] - grown
        long = end[head] - begin >= least
        found.append((begin[long], (end[head] - begin)[long], period[head][long]))
        group = np.cumsum(new) - 1
        covered = (period % period[head][group] == 0) & (start >= begin[group])
        rest = ~new & ~covered
        start, period, end = start[rest], period[rest], end[rest]
    if not found:
        return none, none, none
    begin, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, begin))
    return begin[order], length[order], period[order]


def _candidates(ids: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Words under some `least // 2` neighbours that come twice in their text (or seem to, by their hash)."""
    half, n = max(1, least // 2), len(ids)
    mark = np.zeros(n, bool)
    if n < least:
        return mark
    name = mix(ids.astype(np.uint64) + np.uint64(1))
    window = name[:n - half + 1].copy()
    for k in range(1, half):
        window = window * np.uint64(0x9E3779B97F4A7C15) + name[k:n - half + 1 + k]
    at = np.flatnonzero(doc[:n - half + 1] == doc[half - 1:])
    window = mix(window[at] + mix(doc[at].astype(np.uint64)))
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + half] -= 1
    return np.cumsum(edge[:n]) > 0


def text_runs(ids: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(start, length, period) of all runs of several texts laid end to end; doc numbers their words."""
    at = np.flatnonzero(_candidates(ids, doc, least))
    if not len(at):
        return at, at, at
    gap = np.r_[True, (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])]
    part = np.cumsum(gap) - 1
    place = np.arange(len(at)) + part                     # one mark before each stretch but the first
    s = np.empty(len(at) + part[-1], np.int64)
    s[place] = np.unique(ids[at], return_inverse=True)[1] + part[-1]
    s[place[gap][1:] - 1] = np.arange(part[-1])
    origin = np.zeros(len(s), np.int64)
    origin[place] = at
    start, length, period = runs(s, least)
    return origin[start], length, period


def tiled(words: list[bytes], h: int) -> list[bytes]:
    """The words with a tail made periodic, where the number h says so (every tenth)."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a:a + p]
    return (words[:a] + root * (-(-(n - a) // len(root))))[:n]


SCHEMA = ("n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string, collapsed binary")


def collapse(docs: DataFrame, keep: list[str], seed: Column | None = None, least: int = LEAST, text: bool = True) -> DataFrame:
    """`keep` and per row: n_words; n_runs; start, length, period, exponent_milli of the longest run (then the
    first, then of the smallest period; null without a run); runs_sha256 of all runs as `start,length,period` lines;
    collapsed_sha256 and (unless `text` is false: null) collapsed, the words that stay when each run keeps its first
    period, joined by one space. `seed`, if given, tells which texts get a periodic tail first (`tiled`).

    Null texts have no words; rows that repeat are each settled alike; an empty table gives no rows; texts of any
    length are read whole. Column names in `keep` are free but for those of the results (a ValueError).
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    if set(keep) & set(names):
        raise ValueError("columns to keep have names of the results")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 1, BATCH):
            number = Numbers()
            texts = [t.split() for t in b.column(1).to_pylist()]
            texts = [w if h is None else tiled(w, h) for w, h in zip(texts, b.column(0).to_pylist())]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            ids = np.fromiter((number[w] for t in texts for w in t), np.int64, int(size.sum()))
            first = np.r_[0, np.cumsum(size)]
            start, length, period = text_runs(ids, np.repeat(np.arange(len(size)), size), least)
            bounds = np.searchsorted(start, first)
            local = start - first[np.searchsorted(first, start, "right") - 1]
            rows = []
            for d, words in enumerate(texts):
                x, y = bounds[d], bounds[d + 1]
                s, n, q = local[x:y], length[x:y], period[x:y]
                best, stay = (None, None, None, None), words
                if len(s):
                    k = int(np.argmax(n))                 # ordered by start, then period
                    best = (int(s[k]), int(n[k]), int(q[k]), 1000 * int(n[k]) // int(q[k]))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, s + q, 1)
                    np.add.at(edge, s + n, -1)
                    stay = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                spelled = "".join(f"{a},{c},{e}\n" for a, c, e in zip(s.tolist(), n.tolist(), q.tolist()))
                joined = b" ".join(stay)
                rows.append((len(words), len(s), *best, hashlib.sha256(spelled.encode()).hexdigest(),
                             hashlib.sha256(joined).hexdigest(), joined if text else None))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*b.column(2).flatten(), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], [*keep, *names])

    made = "struct<" + ",".join(f.replace(" ", ":") for f in SCHEMA.split(", ")) + ">"
    schema = docs.select(*keep, F.lit(None).cast(made).alias("made")).select(*keep, "made.*").schema
    told = (F.lit(None) if seed is None else seed).cast("bigint")
    return docs.select(told.alias("seed"), as_bytes("text").alias("text"), F.struct(*keep).alias("row")).mapInArrow(run, schema)
