"""Near-duplicate documents by SimHash fingerprints, found through a byte-position inverted index.

A fingerprint is one or more 64-bit words of eight bytes. Two words that differ in at most four bits share
at least four of their eight positional bytes. Posting lists are kept for sets of three positional bytes:
the twenty triples of a Turan system meet every set of four positions, so any such pair meets in a list.
In a list the shared positional bytes of each pair are tallied, pairs that reach the guaranteed four are
kept, and these are verified by their differing bits. Each list gives a spanning forest of its links, never
all pairs; a list longer than `block` is cut into blocks that are compared two at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tapeline.llm.common import NO_ID, as_bytes, components, mix, reliable, slices

BYTES, FLIPS = 8, 4
SHARED = BYTES - FLIPS         # positional bytes that a linked pair shares at least


def _turan() -> list[tuple[int, int, int]]:
    """Triples of the eight positions such that every four positions hold one: positions in three classes
    in a circle, the triples inside a class and those with two of a class and one of the next."""
    kind = [i % 3 for i in range(BYTES)]
    out = []
    for t in combinations(range(BYTES), 3):
        n = [sum(kind[i] == c for i in t) for c in range(3)]
        if 3 in n or any(n[c] == 2 and n[(c + 1) % 3] == 1 for c in range(3)):
            out.append(t)
    return out


TRIPLES = _turan()


def _majority(hashes: np.ndarray) -> bytes:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def simhash(text: bytes, words: int, seeds: tuple[int, ...], distinct: bool) -> bytes:
    """Fingerprint of one text: a bit is 1 where over half the shingle hashes have it."""
    tokens, digest = text.lower().split(), xxhash.xxh64_intdigest
    if not tokens:
        return bytes(8 * len(seeds))
    joined, n = b" ".join(tokens), len(tokens)
    if n < words:
        shingles: list[bytes] | Iterator[bytes] = [joined]
    else:
        length = np.fromiter(map(len, tokens), np.int64, n)
        start = np.cumsum(length + 1) - length - 1
        spans = zip(start[:n - words + 1].tolist(), (start + length)[words - 1:].tolist())
        shingles = (joined[a:b] for a, b in spans)
    if distinct or len(seeds) > 1:
        shingles = sorted(set(shingles)) if distinct else list(shingles)
        return b"".join(_majority(np.array([digest(s, seed) for s in shingles], np.uint64)) for seed in seeds)
    return _majority(np.fromiter((digest(s, seeds[0]) for s in shingles), np.uint64))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", words: int = 4,
                 seeds: tuple[int, ...] = (42,), distinct: bool = False) -> DataFrame:
    """`keep` and fp, 8 bytes of fingerprint per seed, for every row. Null and empty texts have fingerprint
    zero; texts under `words` words are one shingle; repeated rows give repeated rows; other columns are
    not looked at."""
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [simhash(t, words, seeds, distinct) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(made, pa.binary())], [*keep, "fp"])

    return docs.select(*keep, as_bytes(text).alias("__t")).mapInArrow(run, f"{kinds}, fp binary")


def _postings(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            raw = b.column(0).to_pylist()
            cells = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width * BYTES).astype(np.int64)
            for w in range(width):
                for t, (x, y, z) in enumerate(TRIPLES):
                    at = w * BYTES
                    key = ((w * len(TRIPLES) + t) << 24) | (cells[:, at + x] << 16) | (cells[:, at + y] << 8) | cells[:, at + z]
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0)], ["key", "fp"])
    return run


def _near(a: np.ndarray, b: np.ndarray, word: np.ndarray | int, total: int) -> np.ndarray:
    """Whether fingerprints link: tally of shared bytes of the posting's word, then the differing bits."""
    diff = a ^ b
    own = np.take_along_axis(diff, np.broadcast_to(np.asarray(word), diff.shape[:-1])[..., None], -1)
    tally = (own.view(np.uint8).reshape(*own.shape[:-1], BYTES) == 0).sum(-1)
    return (tally >= SHARED) & (np.bitwise_count(own[..., 0]) <= FLIPS) & (np.bitwise_count(diff).sum(-1) <= total)


def _forest(fps: np.ndarray, side: np.ndarray, word: int, total: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of one list; members of the same side of a pair of blocks are left to
    their own block. Rows are compared one at a time: memory follows the list, not its square."""
    left = np.arange(len(fps))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            hit = _near(fps[at][None], fps[left], word, total)
            if side[at] >= 0:
                hit &= side[left] != side[at]
            for other in left[hit]:
                yield int(at), int(other)
                frontier.append(other)
            left = left[~hit]


def _links(width: int, total: int, small: int = 24):
    """Links within runs of equal (key, cell) of sorted rows."""
    def settle(key: np.ndarray, cell: np.ndarray, side: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps = np.ascontiguousarray(raw).view(">u8").astype(np.uint64).reshape(-1, width)
        word = (key >> 24) // len(TRIPLES)
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        size = np.diff(np.r_[new, len(key)])
        run = np.repeat(np.arange(len(new)), size)
        a, b = [], []
        short = size[run] <= small
        for d in range(1, small):
            i = np.flatnonzero((run[d:] == run[:-d]) & short[:-d])
            if not len(i):
                break
            hit = _near(fps[i], fps[i + d], word[i], total)
            hit &= (side[i] < 0) | (side[i] != side[i + d])
            a.append(i[hit])
            b.append((i + d)[hit])
        for r in np.flatnonzero(size > small):
            part = slice(new[r], new[r] + size[r])
            pairs = np.array(list(_forest(fps[part], side[part], int(word[new[r]]), total)), np.int64).reshape(-1, 2)
            a.append(pairs[:, 0] + new[r])
            b.append(pairs[:, 1] + new[r])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        if len(x):
            wide = pa.binary(width * BYTES)
            cells = [pa.FixedSizeBinaryArray.from_buffers(wide, len(v), [None, pa.py_buffer(np.ascontiguousarray(raw[v]).tobytes())]).cast(pa.binary())
                     for v in (x, y)]
            yield pa.RecordBatch.from_arrays(cells, ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, width * BYTES)
            now = (*(b.column(i).to_numpy() for i in range(3)), raw)
            if kept is not None:
                now = tuple(np.concatenate([p, q]) for p, q in zip(kept, now))
            key, cell = now[0], now[1]
            ends = np.flatnonzero((key != key[-1]) | (cell != cell[-1])) if len(key) else []
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield from settle(*(v[:cut] for v in now))
            kept = tuple(v[cut:] for v in now)
        if kept is not None and len(kept[0]):
            yield from settle(*kept)
    return run


def links(distinct_fps: DataFrame, width: int = 1, total: int = FLIPS, block: int = 4096) -> DataFrame:
    """(src, dst): spanning forests of all links among distinct fingerprints `fp` of `width` words. A pair
    links if some word differs in at most 4 bits and all words together in at most `total`."""
    postings = distinct_fps.select("fp").mapInArrow(_postings(width), "key bigint, fp binary")
    long_lists = reliable(postings.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block))
    light = postings.join(long_lists, "key", "left_anti").select(
        "key", F.lit(0).alias("cell"), F.lit(-1).alias("side"), "fp")
    # a long list: each pair of its blocks is a cell of its own, in which only members of different blocks
    # are compared, but for the cell of a block with itself
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int")
    heavy = (postings.join(long_lists, "key").withColumn("n_blocks", blocks).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
             .select("key", (F.least("own", "other") * F.col("n_blocks") + F.greatest("own", "other") + 1).alias("cell"),
                     F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), "fp"))
    every = light.unionByName(heavy) if not long_lists.isEmpty() else light
    return (every.repartition(F.col("key"), F.col("cell")).sortWithinPartitions("key", "cell", "fp")
            .mapInArrow(_links(width, total), "src binary, dst binary").distinct())


def classes(fps: DataFrame, key: str = "doc_id", width: int = 1, total: int = FLIPS, block: int = 4096) -> DataFrame:
    """(key, fp, component_id) for every row of `fps`: the smallest key reachable over links, the row's own
    included (null only if all keys of the component are null). Rows of equal fingerprint are one node, so
    a group of copies costs one comparison, however large."""
    fps = reliable(fps.select(key, "fp"))
    nodes = fps.groupBy("fp").agg(F.min(key).alias("first"))
    stars = components(links(nodes, width, total, block))
    rooted = nodes.join(stars.withColumnRenamed("src", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


# ------------------------------------------------------------------ the stage: one document of a group stays

#: Candidates of the stage, beside the links of fingerprints: equal groups of `ROWS` minima of a text's shingles, `BANDS` of them. Two texts with
#: shingles J alike meet with probability 1 - (1 - J^6)^32, whatever edit made one of the other: 0.99994 at 0.8.
BANDS, ROWS = 32, 6
_DRAW = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_ADD, _TIMES = _DRAW[0], _DRAW[1] | np.uint64(1)

#: Of a component, so many documents are settled among themselves per round, beside so many of the others.
HEADS, OTHERS = 256, 1000
#: A group of equal minima with more rows than this is tied to its first without gathering it.
CROWD = 4096


def _shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    tokens, digest = text.lower().split(), xxhash.xxh64_intdigest
    joined, n = b" ".join(tokens), len(tokens)
    if n <= words:
        return np.array([digest(joined)], np.uint64)
    length = np.fromiter(map(len, tokens), np.int64, n)
    start = np.cumsum(length + 1) - length - 1
    spans = zip(start[:n - words + 1].tolist(), (start + length)[words - 1:].tolist())
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in spans), np.uint64, n - words + 1))


def _bands(shingles: np.ndarray) -> np.ndarray:
    """One key per band: a hash of the band's number and its minima."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        # the product's upper half, folded in, makes each order depend on all bits
        part = (shingles[None, at:at + 1024] ^ _ADD) * _TIMES
        part ^= part >> np.uint64(32)
        part *= _TIMES
        np.minimum(least, part.min(1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for value in least.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + value)
    return key.view(np.int64)


def _signatures(words: int):
    """Rows (__text, __id, text) to (__text, __id, bands, fp), the bands as bytes, the fingerprint as `fingerprints` makes it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            made = [_bands(_shingles(t, words)).tobytes() for t in texts]
            fps = [simhash(t, 4, (42,), False) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary()), pa.array(fps, pa.binary())],
                                             ["__text", "__id", "bands", "fp"])
    return run


def _band_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (alias, bands) to one row (key, alias) per band."""
    for b in slices(batches, 4096):
        keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["key", "alias"])


def band_links(signed: DataFrame) -> DataFrame:
    """(src, dst) of rows (alias, bands): each alias with the least that shares a band with it."""
    postings = signed.select("alias", "bands").mapInArrow(_band_postings, "key bigint, alias bigint")
    crowded = postings.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("key")
    crowded = reliable(crowded)                                       # at most rows / CROWD
    first = F.min("alias").over(Window.partitionBy("key")).alias("dst")
    if crowded.isEmpty():
        made = postings.select(F.col("alias").alias("src"), first)
    else:
        hot = postings.join(F.broadcast(crowded), "key")
        heads = reliable(hot.groupBy("key").agg(F.min("alias").alias("dst")))
        made = postings.join(F.broadcast(crowded), "key", "left_anti").select(F.col("alias").alias("src"), first).unionByName(
            hot.join(F.broadcast(heads), "key").select(F.col("alias").alias("src"), "dst"))
    return made.filter("src <> dst").distinct()


def fingerprint_links(signed: DataFrame) -> DataFrame:
    """(src, dst) of rows (alias, fp): each alias with the least of its fingerprint, and those least ones whose
    fingerprints `links` joins."""
    heads = reliable(signed.groupBy("fp").agg(F.min("alias").alias("head"), F.count("*").alias("n")))
    same = signed.join(heads.filter("n > 1"), "fp").select(F.col("alias").alias("src"), F.col("head").alias("dst"))
    near = (links(heads).join(heads.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src")
            .join(heads.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst")
            .select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return same.unionByName(near).filter("src <> dst").distinct()


class _Kept:
    """Shingle sets of kept documents: the first ones in one sorted index, the latest as they are."""

    def __init__(self) -> None:
        self.sets: list[np.ndarray] = []
        self.sizes = np.zeros(0, np.int64)
        self.hashes, self.owner, self.indexed = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def add(self, own: np.ndarray) -> None:
        self.sets.append(own)
        self.sizes = np.append(self.sizes, len(own))
        if len(self.sets) >= self.indexed + 32:
            fresh = self.sets[self.indexed:]
            hashes = np.concatenate([self.hashes, *fresh])
            owner = np.concatenate([self.owner, np.repeat(np.arange(self.indexed, len(self.sets)), [len(x) for x in fresh])])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.owner, self.indexed = hashes[order], owner[order], len(self.sets)

    def alike(self, own: np.ndarray, similarity: float) -> bool:
        """Whether some set has a Jaccard similarity of at least `similarity`; every set is counted exactly."""
        both = np.zeros(len(self.sets), np.int64)
        if self.indexed:
            a, b = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
            n = b - a
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            both[:self.indexed] = np.bincount(self.owner[at], minlength=self.indexed)
        for i in range(self.indexed, len(self.sets)):
            small, large = sorted((own, self.sets[i]), key=len)
            if len(small) >= similarity * len(large):
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both[i] = np.count_nonzero(large[at] == small)
        return bool((both >= similarity * (len(own) + self.sizes - both)).any())


def _settle(similarity: float, words: int):
    """Rows (root, salt, later, node, text), sorted, to (node, salt, later, gone). The heads (later = 0) come
    first in the order of their names: one that is alike to a kept head goes. Others go if they are alike to
    a kept head. Every document is compared with every kept head by their shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, _Kept()
        for b in slices(batches, 128):
            out = []
            for root, salt, later, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if (root, salt) != group:
                    group, kept = (root, salt), _Kept()
                mine = _shingles(text, words)
                gone = kept.alike(mine, similarity)
                if not later and not gone:
                    kept.add(mine)
                out.append(gone)
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(1), b.column(2), pa.array(out, pa.bool_())], ["node", "salt", "later", "gone"])
    return run


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """Documents without exact and near copies, columns unchanged. Equal texts are one node, kept by the
    smallest doc_id (null last). Texts are linked by their SimHash fingerprints, as in `classes`, and by shared bands of
    minima, which meet the near copies that differ in more bits. Components are settled by their texts, in that
    order: a node goes only if its shingles of five words and those of a node that stays are at least 0.8
    alike (Jaccard). Rows with
    null or empty texts are one group; repeated rows with the same doc_id and text stay once."""
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    named = docs.withColumn("__text", F.unhex(F.substring(F.sha2(as_bytes("text"), 256), 1, 32))).withColumn("__id", order)
    marks = named.select("__text", "__id", as_bytes("text").alias("text")).mapInArrow(
        _signatures(words), "__text binary, __id bigint, bands binary, fp binary")
    # a node is a text with its smallest doc_id; its name sorts by that. The alias stands for it in links: two
    # nodes of one alias share a component, which settling by texts does not mind
    name = F.concat(F.unhex(F.lpad(F.hex("__id"), 16, "0")), F.col("__text")).alias("node")
    alias = F.xxhash64("__text").alias("alias")
    nodes = reliable(marks.groupBy("__text").agg(F.min("__id").alias("__id"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
                     .select("__text", "__id", name, alias, "bands", "fp"))
    stars = components(fingerprint_links(nodes).unionByName(band_links(nodes)))
    roots = reliable(stars.unionByName(stars.select(F.col("root").alias("src"), "root")).distinct())
    left = reliable(nodes.join(roots.withColumnRenamed("src", "alias"), "alias").select("node", "root"))
    nodes = nodes.drop("bands", "fp", "alias")
    gone = None
    if not left.isEmpty():
        wanted = nodes.join(left.select("node"), "node").select("__text", "__id", "node")
        texts = reliable(named.select("__text", "__id", as_bytes("text").alias("text")).join(wanted, ["__text", "__id"])
                         .dropDuplicates(["__text", "__id"]).select("node", "text"))
    while not left.isEmpty():
        # heads: the first of each component; the filter on the rank keeps few rows per task before the shuffle
        rank = F.row_number().over(Window.partitionBy("root").orderBy("node"))
        heads = reliable(left.withColumn("r", rank).filter(F.col("r") <= HEADS).select("root", "node"))
        parts = left.groupBy("root").agg(F.ceil(F.count("*") / OTHERS).cast("int").alias("parts"))
        beside = heads.join(parts, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("later"), "node")
        rest = left.join(heads.select("node"), "node", "left_anti").join(parts, "root").select(
            "root", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("later"), "node")
        rows = beside.unionByName(rest).join(texts, "node").select("root", "salt", "later", "node", "text")
        done = reliable(rows.repartition("root", "salt").sortWithinPartitions("root", "salt", "later", "node").mapInArrow(
            _settle(similarity, words), "node binary, salt int, later int, gone boolean"))
        found = done.filter("gone AND (later = 1 OR salt = 0)").select("node")
        gone = found if gone is None else gone.unionByName(found)
        left = reliable(left.join(done.filter("later = 1 AND NOT gone").select("node"), "node", "left_semi"))
    stay = (nodes if gone is None else nodes.join(gone, "node", "left_anti")).select("__text", "__id")
    return named.join(stay, ["__text", "__id"]).dropDuplicates(["__text", "__id"]).select(*docs.columns)
