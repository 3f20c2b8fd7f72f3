"""Quality rules: gradient-boosted trees over statistics of documents, with monotonic constraints.

Statistics come from whole texts, in one pass. The trees are fitted on a bounded sample of labelled documents
(`MAX_ROWS` in each class, drawn by document), by logistic loss over binned features. A split on a constrained
feature is only taken when its sides are in the wanted order, and its middle bounds all that grows below, so the
score never rises with symbols, repeated lines or repeated words, whatever the sample says. All trees are laid
into flat numpy arrays, and a block of rows walks all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeline.llm.common import as_bytes, by_size, reliable
from tapeline.llm.periodic import Numbers

MAX_ROWS, BATCH = 10_000, 2_000_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_distinct", "n_digits", "n_upper", "n_letters")
#: Features with their constraint: -1 means that more of it never raises the score.
FEATURES = {"symbols": -1, "dup_lines": -1, "repeat_words": -1, "words": 0, "word_length": 0, "line_words": 0, "ended": 0,
            "distinct": 0, "digits": 0, "upper": 0, "letters": 0}

# kinds of bytes: 0 inside a code point, 1 white space, 2 symbol, 3 digit, 4 upper case, 5 lower case or beyond ASCII, 6 the rest
KIND = np.full(256, 6, np.uint8)
KIND[0x80:0xC0], KIND[0xC0:] = 0, 5
KIND[[0x20, *range(0x09, 0x0E)]] = 1
KIND[list(b"#*$%&|<>")] = 2
KIND[ord("0"):ord("9") + 1], KIND[ord("A"):ord("Z") + 1], KIND[ord("a"):ord("z") + 1] = 3, 4, 5


def _kinds(texts: list[bytes]) -> np.ndarray:
    """How many bytes of each kind a text has, counted in blocks."""
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    raw, out = np.frombuffer(b"".join(texts), np.uint8), np.zeros(8 * len(texts), np.int64)
    for k in range(0, len(raw), 1 << 20):
        part = raw[k:k + (1 << 20)]
        doc = np.repeat(np.arange(len(texts)), np.diff(np.clip(bounds, k, k + len(part))))
        out += np.bincount(8 * doc + KIND[part], minlength=len(out))
    return out.reshape(-1, 8)


def repeated(ids: np.ndarray, doc: np.ndarray, width: int = 3) -> np.ndarray:
    """Which words lie in a window of `width` words that comes twice or more in its text; exact."""
    n = len(ids)
    inside = np.zeros(n, bool)
    if n < width:
        return inside
    at = np.flatnonzero(doc[:n - width + 1] == doc[width - 1:])
    name = doc[at]
    for k in range(width):                                   # windows named by numbers that stay under n
        top = int(ids.max()) + 1
        if (int(name.max(initial=0)) + 1) * top >= 1 << 62:
            name = np.unique(name, return_inverse=True)[1]
        name = name * top + ids[at + k]
    order = np.argsort(name)
    same = name[order[1:]] == name[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + width] -= 1
    return np.cumsum(edge[:n]) > 0


def count(texts: list[bytes]) -> np.ndarray:
    """Rows of COUNTS."""
    words = [t.split() for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    number = Numbers()
    ids = np.fromiter((number[w] for t in words for w in t), np.int64, int(size.sum()))
    doc = np.repeat(np.arange(len(texts)), size)
    kinds = _kinds(texts)
    lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    ended = [sum(x.rstrip()[-1:] in b".!?" for x in rows) for rows in lines]
    columns = [size, kinds[:, 2:].sum(1), kinds[:, 2], n_lines - np.array([len(set(x)) for x in lines], np.int64),
               np.bincount(doc, repeated(ids, doc), len(texts)), n_lines, ended, [len(set(w)) for w in words],
               kinds[:, 3], kinds[:, 4], kinds[:, 4] + kinds[:, 5]]
    return np.stack([np.asarray(c).astype(np.int64) for c in columns], 1) if texts else np.zeros((0, len(COUNTS)), np.int64)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and COUNTS per row: words, code points in words, symbols (`#*$%&|<>`), lines with a word that equal an
    earlier one, words in three-word windows that come twice, lines with a word, those that end a sentence,
    distinct words, digits, upper-case and all letters (beyond ASCII: all code points). Null texts have zeros."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 0, BATCH):
            made = count(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.column(1).flatten(), *(pa.array(c) for c in made.T.copy())], [*keep, *COUNTS])

    if set(keep) & set(COUNTS):
        raise ValueError("columns to keep have names of the results")
    schema = docs.select(*keep, *(F.lit(0).cast("bigint").alias(c) for c in COUNTS)).schema
    return docs.select(as_bytes("text").alias("text"), F.struct(*keep).alias("row")).mapInArrow(run, schema)


def base_failed() -> F.Column:
    """Too short, or over half of the words in windows that come again."""
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def features(counts: np.ndarray) -> np.ndarray:
    """Rows of FEATURES from rows of COUNTS; shares of nothing are 0."""
    c = dict(zip(COUNTS, counts.astype(np.float64).T))
    words, lines, chars = (np.maximum(c[k], 1) for k in ("n_words", "n_lines", "word_chars"))
    return np.stack([c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, np.log1p(c["n_words"]),
                     c["word_chars"] / words, c["n_words"] / lines, c["n_ended"] / lines, c["n_distinct"] / words,
                     c["n_digits"] / chars, c["n_upper"] / chars, c["n_letters"] / chars], 1)


@dataclass
class Trees:
    """All nodes of all trees in a row; a leaf is its own child. `roots` has one node per tree."""
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds per row of features."""
        out = np.full(len(x), self.base)
        for k in range(0, len(x), 4096):
            part = x[k:k + 4096]
            node, row = np.tile(self.roots, (len(part), 1)), np.arange(len(part))[:, None]
            for _ in range(self.depth):
                low = part[row, self.feature[node]] <= self.limit[node]
                node = np.where(low, self.left[node], self.right[node])
            out[k:k + 4096] += self.value[node].sum(1)
        return out


def _best_split(bins: np.ndarray, g: np.ndarray, h: np.ndarray, width: int, signs: np.ndarray, low: float, high: float, soft: float, least: int):
    """(gain, feature, bin, left value, right value) of the best allowed split: `least` rows on each side, and
    values within [low, high]."""
    at = bins + width * np.arange(bins.shape[1])
    shape = (bins.shape[1], width)
    G, H = (np.bincount(at.ravel(), np.repeat(w, bins.shape[1]), shape[0] * width).reshape(shape) for w in (g, h))
    few = np.cumsum(np.bincount(at.ravel(), minlength=shape[0] * width).reshape(shape), 1)[:, :-1]
    gl, hl = np.cumsum(G, 1)[:, :-1], np.cumsum(H, 1)[:, :-1]
    gr, hr = G.sum(1, keepdims=True) - gl, H.sum(1, keepdims=True) - hl
    vl, vr = np.clip(-gl / (hl + soft), low, high), np.clip(-gr / (hr + soft), low, high)
    worth = lambda v, a, b: -(a * v + 0.5 * (b + soft) * v * v)               # noqa: E731 - less loss by value v
    whole = np.clip(-g.sum() / (h.sum() + soft), low, high)
    gain = worth(vl, gl, hl) + worth(vr, gr, hr) - worth(whole, g.sum(), h.sum())
    allowed = (few >= least) & (few <= len(g) - least) & (signs[:, None] * (vr - vl) >= 0)
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return gain[f, b], int(f), int(b), float(vl[f, b]), float(vr[f, b])


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
        bins: int = 128, soft: float = 1.0, least: int = 3) -> Trees:
    """Trees for y (0 or 1) from features x; signs has 1, 0 or -1 per feature. One class or no rows: no trees,
    and a score that keeps the class seen (no rows: every document)."""
    nodes: list[list[float]] = []                            # feature, limit, left, right, value
    roots: list[int] = []
    share = float(y.mean()) if len(y) else 1.0
    base = float(np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5)))
    if 0 < share < 1:
        limits = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        where = np.stack([np.searchsorted(lim, c) for lim, c in zip(limits, x.T)], 1)   # bin b: at most limits[b]
        total = np.full(len(y), base)

        def leaf(value: float) -> int:
            nodes.append([0, 0.0, len(nodes), len(nodes), value])
            return len(nodes) - 1

        def grow(rows: np.ndarray, level: int, value: float, low: float, high: float) -> int:
            if level < depth and len(rows) > 1:
                gain, f, b, vl, vr = _best_split(where[rows], g[rows], h[rows], bins, signs, low, high, soft, least)
                if gain > 1e-9 and b < len(limits[f]):
                    goes, middle = where[rows, f] <= b, (vl + vr) / 2
                    me = len(nodes)
                    nodes.append([f, float(limits[f][b]), 0, 0, 0.0])
                    sides = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high),) * 2}[int(signs[f])]
                    nodes[me][2] = grow(rows[goes], level + 1, vl, *sides[0])
                    nodes[me][3] = grow(rows[~goes], level + 1, vr, *sides[1])
                    return me
            total[rows] += rate * value
            return leaf(rate * value)

        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            roots.append(grow(np.arange(len(y)), 0, 0.0, -np.inf, np.inf))
    flat = np.array(nodes or [[0, 0.0, 0, 0, 0.0]])
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4],
                 np.array(roots, np.int64), base, depth)


def sample(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(counts, good) of at most `max_rows` labelled documents of each class, drawn by a hash of doc_id. Labels of one
    document count once, by their highest quality (good: 1 and more); null ids and qualities are passed over, and of
    rows that repeat a doc_id one is taken. Documents that fail the base rules are left out: they go anyway."""
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") >= 1).alias("good"))
    sizes = {r["good"]: r["count"] for r in marked.groupBy("good").count().collect()}              # two rows
    if not sizes:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros(0)
    hashed = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 1.3 * max_rows / n))]), F.col("good"))
    drawn = marked.filter(hashed < share * float(1 << 30))
    rows = stats.filter(~base_failed()).join(drawn, "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct(*COUNTS)).alias("s"))
    got = [rows.filter(F.col("good") == k).orderBy(hashed, "doc_id").limit(max_rows).select("s.*", "good").toPandas() for k in sizes]
    both = np.concatenate([g[list(COUNTS)].to_numpy(np.int64) for g in got])
    return both, np.concatenate([g["good"].to_numpy(np.float64) for g in got])


def judge(stats: DataFrame, trees: Trees, least: float = 0.5) -> DataFrame:
    """The rows of `statistics` with base_failed, score (the probability of being good) and kept: the base rules
    hold and the score is `least` or more."""
    shared = stats.sparkSession.sparkContext.broadcast(trees)                                       # a few thousand nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.stack([b.column(c).to_numpy() for c in COUNTS], 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-shared.value.score(features(counts)))))], [*b.schema.names, "score"])

    made = stats.mapInArrow(run, stats.withColumn("score", F.lit(0.0)).schema)
    return made.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def rate(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, least: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, COUNTS, base_failed, score, kept; the trees learn from labels (doc_id, quality).

    Null texts have no words and fail the base rules; repeated rows are rated alike; texts are read whole; an
    empty table gives no rows; without labels the base rules alone decide. Other columns are not looked at.
    """
    stats = reliable(statistics(docs, ["doc_id"]))
    counts, good = sample(stats, labels, max_rows)
    return judge(stats, fit(features(counts), good, np.array(list(FEATURES.values()))), least)


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, least: float = 0.5) -> DataFrame:
    """The documents that `rate` keeps, columns unchanged whatever their names; rows of equal texts and ids are kept
    or go together."""
    stats = statistics(docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole")), ["doc_id", "whole"])
    counts, good = sample(reliable(stats.drop("whole")), labels, max_rows)
    return judge(stats, fit(features(counts), good, np.array(list(FEATURES.values()))), least).filter("kept").select("whole.*")
