"""Long repeated passages by recompression.

Words are named by 64-bit hashes. A first round names runs of one word, later rounds name pairs of adjacent
symbols: a symbol of the left class followed by one of the right class becomes one symbol, whose name is a
hash of both, and classes are one bit of a hash of (round, symbol). All names depend on content alone, so
equal passages get equal symbols wherever they are, but for a margin at either end: each symbol carries the
span of words that decide it. A window of `window` words takes as its anchor the symbol of the highest round
whose deciding span lies inside the window, by smallest hash, then leftmost; single words are the symbols of
round 0, so every window has one. Equal windows hence have equal anchors at equal places.

Spark groups the windows by anchor. Rows of an anchor (key, its windows' hashes) meet in one shuffle, in
which a window is repeated if an earlier window has the same anchor, place and hash. Copies with one and the
same surroundings inside one batch are settled there, so a passage that a third of all documents hold sends
one row per batch. Anchors with more than `crowd` rows go on window by window in a second shuffle, whose
tasks only keep the first row of each run in memory.

Hashes: windows are compared by 64 bits of their anchor's deciding span and 64 bits of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zlib
from pyspark.sql import DataFrame, functions as F

from tapeline.llm.common import NO_ID, as_bytes, by_size, mix, reliable, slices, written

WINDOW, ROUNDS = 20, 3
BASE = 0x9E3779B97F4A7C15                       # odd: has an inverse modulo 2^64
BACK = pow(BASE, -1, 1 << 64)
FAR = 1 << 40                                   # a span that reaches the end of a document
PART = 1 << 16                                  # windows whose anchors are looked up at a time


class _Words(dict):
    """Hashes of words, remembered; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


WORDS = _Words()                                # one per Python worker, emptied when a task ends


def _name(x: np.ndarray, y: np.ndarray, salt: int) -> np.ndarray:
    return mix(x * np.uint64(BASE) + mix(y + np.uint64(salt)))


def _runs(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(name, lo, hi, document) of the runs of one word; whether a run is whole is decided by the words beside it."""
    n = len(ids)
    same = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(np.r_[True, ~same])
    last = np.r_[first[1:] - 1, n - 1]
    length = (last - first + 1).astype(np.uint64)
    name = np.where(length > 1, _name(ids[first], length, 1), ids[first])
    del same, length
    inner_l, inner_r = np.zeros(len(first), bool), np.zeros(len(first), bool)
    inner_l[1:] = doc[first[1:]] == doc[last[:-1]]
    inner_r[:-1] = inner_l[1:]
    lo = np.where(inner_l, first - 1, first - FAR)
    hi = np.where(inner_r, last + 2, last + 1 + FAR)
    return name, lo, hi, doc[first]


def _paired(level: int, name: np.ndarray, lo: np.ndarray, hi: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next round's (name, lo, hi, document)."""
    right = (mix(name + np.uint64(level * 0x51ED27)) >> np.uint64(63)).astype(bool)
    touch = of[1:] == of[:-1]
    pair = ~right[:-1] & right[1:] & touch              # i and i + 1 become one
    second = np.zeros(len(name), bool)
    second[1:] = pair
    begins = np.flatnonzero(~second)
    paired = np.zeros(len(name), bool)
    paired[:-1] = pair
    paired = paired[begins]
    after = np.minimum(begins + 1, len(name) - 1)
    new_name = np.where(paired, _name(name[begins], name[after], level + 1), name[begins])
    has_after = (after > begins) & (of[after] == of[begins])
    alone_l, alone_r = ~paired & ~right[begins], ~paired & right[begins]
    # a symbol left alone is decided by the one that it did not join
    new_hi = np.where(paired, hi[after], np.where(alone_l, np.where(has_after, hi[after], hi[begins] + FAR), hi[begins]))
    new_hi = np.maximum(new_hi, hi[begins])
    del after, has_after
    before = np.maximum(begins - 1, 0)
    has_before = (before < begins) & (of[before] == of[begins])
    new_lo = np.where(alone_r, np.where(has_before, np.minimum(lo[before], lo[begins]), lo[begins] - FAR), lo[begins])
    return new_name, new_lo, new_hi, of[begins]


def _symbols(ids: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(round, name, lo, hi) of the symbols of each round; [lo, hi) are the words that decide them."""
    yield 0, ids, np.arange(len(ids)), np.arange(1, len(ids) + 1)
    name, lo, hi, of = _runs(ids, doc)
    for level in range(1, ROUNDS + 1):
        name, lo, hi, of = _paired(level, name, lo, hi, of)
        yield level, name, lo, hi


def _least(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the smallest of order[a:b] for each a < b, the leftmost of equals; by doubling."""
    steps = [np.arange(len(order))]
    width = int((b - a).max()) if len(a) else 1
    while (1 << len(steps)) <= width:
        half, prev = 1 << (len(steps) - 1), steps[-1]
        x, y = prev[:-half], prev[half:]
        steps.append(np.where(order[x] <= order[y], x, y))
    level = np.zeros(len(a), np.int64)
    for k in range(1, len(steps)):
        level[(b - a) >= (1 << k)] = k
    out = np.empty(len(a), np.int64)
    for k, step in enumerate(steps):
        m = level == k
        x, y = step[a[m]], step[b[m] - (1 << k)]
        out[m] = np.where(order[x] <= order[y], x, y)
    return out


def anchors(ids: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Rows of windows that follow each other and share an anchor: (anchor's key, first window's start,
    number of windows, place of the anchor in the first window); and the hash of the window at each start."""
    n = len(ids)
    power = np.full(n + 1, BASE, np.uint64)
    power[0] = 1
    back = np.full(n + 1, BACK, np.uint64)
    back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    total = np.r_[np.uint64(0), np.cumsum(ids * power[:-1])]
    spell = lambda a, b: mix((total[b] - total[a]) * back[a])       # noqa: E731 - hash of the words [a, b)
    starts = np.flatnonzero(doc[:n - window + 1] == doc[window - 1:]) if n >= window else np.zeros(0, np.int64)
    hashes = spell(starts, starts + window)
    rounds = list(_symbols(ids, doc))
    key, place, open_ = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
    while rounds:
        level, name, lo, hi = rounds.pop()                          # a round is let go once it is done
        fits = hi - lo <= window
        name, lo, hi = name[fits], lo[fits], hi[fits]
        left = np.flatnonzero(open_)
        if not len(left) or not len(lo):
            continue
        own = _name(spell(lo, hi), name, 100 + level)
        for at in range(0, len(left), PART):                        # each window is looked up by itself
            todo = left[at:at + PART]
            s = starts[todo]
            a, b = np.searchsorted(lo, s), np.searchsorted(hi, s + window, "right")
            some = b > a
            if not some.any():
                continue
            todo, a, b = todo[some], a[some], b[some]
            low = int(a.min())
            best = _least(own[low:int(b.max())], a - low, b - low) + low
            key[todo], place[todo], open_[todo] = own[best], lo[best], False
    if not len(starts):
        return key, starts, starts, starts, starts, hashes
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    count = np.diff(np.r_[new, len(starts)])
    return key[new], starts[new], count, place[new] - starts[new], new, hashes


#: `at` is the first window's start * 32 + the anchor's place in it, or, without windows, the number of windows that
#: the batch has settled; few and narrow columns, as there is a row for every few words
ROW = "key bigint, doc_id bigint, uid int, at bigint, windows binary"
HIT = "doc_id bigint, uid int, start int, mask int, key bigint, name bigint"


def _find(window: int):
    """Documents to anchor rows; those that the batch has settled have no windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from found(batches)
        finally:
            WORDS.clear()                       # else idle workers hold them while other steps run

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WORDS
        for b in by_size(batches, 1, 3_000_000):
            texts = [t.split() for t in b.column(1).to_pylist()]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            if not size.sum():
                continue
            uid = np.array([zlib.crc32(t) for t in b.column(1).to_pylist()], np.uint32).view(np.int32)
            ids = np.fromiter((words[w] for t in texts for w in t), np.uint64, int(size.sum()))
            del texts
            doc = np.repeat(np.arange(len(size)), size)
            key, start, count, place, at, hashes = anchors(ids, doc, window)
            if not len(key):
                continue
            which, first = doc[start], np.r_[0, np.cumsum(size)[:-1]]
            own, local = b.column(0).to_numpy(), start - first[doc[start]]
            ends = np.r_[at[1:], len(hashes)]
            # equal surroundings in this batch: only the earliest goes on
            roll = np.r_[np.uint64(0), np.cumsum(mix(hashes + (np.arange(len(hashes)) - np.repeat(at, count)).astype(np.uint64) * np.uint64(BASE)))]
            around = mix(roll[ends] - roll[at] + mix(key + place.astype(np.uint64)))
            order = np.lexsort((local, uid[which], own[which], around))
            repeat = np.zeros(len(key), bool)
            prev, nxt = order[:-1], order[1:]
            same = around[prev] == around[nxt]
            repeat[nxt[same]] = True
            # rows of one and the same place in repeated rows of the table are no repeats
            equal = same & (own[which[prev]] == own[which[nxt]]) & (uid[which[prev]] == uid[which[nxt]]) & (local[prev] == local[nxt])
            for i in np.flatnonzero(equal):
                repeat[nxt[i]] = repeat[prev[i]]
            live = ~repeat
            raw = hashes.tobytes()
            blobs = [raw[8 * x:8 * y] if z else None for x, y, z in zip(at.tolist(), ends.tolist(), live.tolist())]
            spread = np.where(live, key, mix(key + own[which].astype(np.uint64) + local.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread.view(np.int64)), pa.array(own[which]), pa.array(uid[which]),
                 pa.array(32 * local + np.where(live, place, count)), pa.array(blobs, pa.binary())], [f.split()[0] for f in ROW.split(", ")])
    return run


def _hits(doc: np.ndarray, uid: np.ndarray, start: np.ndarray, mask: np.ndarray, key: np.ndarray | None = None,
          name: np.ndarray | None = None) -> pa.RecordBatch:
    none = np.zeros(len(doc), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(uid), pa.array(start.astype(np.int32)), pa.array(mask.astype(np.int32)),
         pa.array(none if key is None else key), pa.array(none if name is None else name)],
        ["doc_id", "uid", "start", "mask", "key", "name"])


def _explode(rows: tuple) -> tuple[np.ndarray, ...]:
    """One entry per window: row, window's index in the row, and its name (place, hash) beside the row's anchor."""
    key, _, _, _, n, place, blobs = rows
    row = np.repeat(np.arange(len(key)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    hashes = np.frombuffer(b"".join(blobs), np.uint64)
    name = mix(hashes + mix((place[row] - j + 64).astype(np.uint64)))
    return row, j, name


def _meet(crowd: int):
    """Anchor rows sorted by key to hits; windows of crowded anchors go on with mask 0 under their name."""
    def settle(rows: tuple) -> Iterator[pa.RecordBatch]:
        key, doc, uid, start, n, place, blobs = rows
        done = n == 0
        if done.any():
            yield _hits(doc[done], uid[done], start[done], place[done])
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.repeat(np.diff(np.r_[new, len(key)]), np.diff(np.r_[new, len(key)]))
        use = np.flatnonzero((size > 1) & ~done)
        if not len(use):
            return
        part = (*(v[use] for v in rows[:6]), [blobs[i] for i in use.tolist()])
        row, j, name = _explode(part)
        key, doc, uid, at = part[0][row], part[1][row], part[2][row], part[3][row].astype(np.int64) + j
        big = size[use][row] > crowd
        if big.any():
            yield _hits(doc[big], uid[big], at[big], np.zeros(big.sum(), np.int64), key[big], name[big].view(np.int64))
        small = np.flatnonzero(~big)
        order = small[np.lexsort((at[small], uid[small], doc[small], name[small], key[small]))]
        hit = _later(key[order], name[order], doc[order], uid[order], at[order])
        mask = np.zeros(len(use), np.int64)
        np.add.at(mask, row[order[hit]], np.int64(1) << j[order[hit]])
        some = mask > 0
        if some.any():
            yield _hits(part[1][some], part[2][some], part[3][some], mask[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None
        for b in batches:
            key, doc, uid, at = (b.column(i).to_numpy() for i in range(4))
            n = pc.fill_null(pc.binary_length(b.column(4)), 0).to_numpy(zero_copy_only=False) // 8
            now = (key, doc, uid, at >> 5, n, np.where(n > 0, at & 31, (1 << (at & 31)) - 1), b.column(4).to_pylist())
            if kept is not None:
                now = (*(np.concatenate(p) for p in zip(kept[:6], now[:6])), kept[6] + now[6])
            key = now[0]
            ends = np.flatnonzero(key != key[-1])
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield from settle(tuple(v[:cut] for v in now))
            kept = tuple(v[cut:] for v in now)
            # of a crowded anchor nothing but its being crowded has to be known
            while len(kept[0]) > 2 * crowd + 2:
                yield from settle(tuple(v[:-crowd - 1] for v in kept))
                kept = tuple(v[-crowd - 1:] for v in kept)
        if kept is not None and len(kept[0]):
            yield from settle(kept)
    return run


def _later(key: np.ndarray, name: np.ndarray, doc: np.ndarray, uid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of sorted windows, those that are not at the first place of their anchor and name."""
    if not len(name):
        return np.zeros(0, bool)
    new = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])]
    first = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
    return ~((doc == doc[first]) & (uid == uid[first]) & (at == at[first]))


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by (name, anchor, document, place) to hits; keeps the first of the current name and anchor."""
    head: tuple | None = None
    for b in batches:
        doc, uid, at, _, key, name = (b.column(i).to_numpy() for i in range(6))
        if head is not None:
            doc, uid, at, key, name = (np.r_[h, v] for h, v in zip(head, (doc, uid, at, key, name)))
        hit = _later(key, name, doc, uid, at)
        if hit.any():
            yield _hits(doc[hit], uid[hit], at[hit], np.ones(hit.sum(), np.int64))
        first = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])])[-1])
        head = tuple(v[first:first + 1] for v in (doc, uid, at, key, name))


def repeated_windows(docs: DataFrame, window: int = WINDOW, crowd: int = 20_000) -> DataFrame:
    """(doc_id, uid, start, mask): bit j of mask says that the window at word start + j also starts earlier
    (smaller doc_id, null last; then the text's checksum uid; then the start). Texts under `window` words
    have no windows; rows that repeat doc_id and text count as one document."""
    if not 2 <= window <= 30:
        raise ValueError("window must be from 2 to 30 words")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), as_bytes("text").alias("text"))
    met = rows.mapInArrow(_find(window), ROW).repartition("key").sortWithinPartitions("key").mapInArrow(_meet(crowd), HIT)
    met = written(met)
    hits = met.filter("mask <> 0").select("doc_id", "uid", "start", "mask")
    crowded = met.filter("mask = 0")
    if crowded.isEmpty():
        return hits
    more = crowded.repartition("name").sortWithinPartitions("name", "key", "doc_id", "uid", "start").mapInArrow(_second, HIT)
    return hits.unionByName(more.select("doc_id", "uid", "start", "mask"))


def covered(n_words: int, start: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a repeated window."""
    edge = np.zeros(n_words + 1, np.int64)
    for j in range(window + 1):
        s = start[(mask >> j) & 1 == 1] + j
        np.add.at(edge, s, 1)
        np.add.at(edge, s + window, -1)
    return np.cumsum(edge[:n_words]) > 0


def key_map(keys: DataFrame, most: int = 1 << 27) -> np.ndarray:
    """A map of the keys (a written table of id, uid) for `may_have`: 16 bits a key, at most `most` bits (16 MB)."""
    bits = 64
    while bits < min(most, 16 * keys.count()):
        bits *= 2
    place = F.pmod(F.xxhash64("id", "uid"), F.lit(bits))
    words = keys.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))).alias("bits")).toArrow()     # at most `most` / 64 rows
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64)


def may_have(table: np.ndarray, name: np.ndarray) -> np.ndarray:
    """False where the keys of a map surely lack a row, told by the hash of its id and uid. Where the map is too
    small for its keys, more rows may have one."""
    at = name.view(np.uint64) & np.uint64(64 * len(table) - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def over_hits(docs: DataFrame, work, schema, window: int = WINDOW, crowd: int = 20_000) -> DataFrame:
    """What `work` makes of batches (row, starts, masks): the documents as structs, with their repeated windows (null:
    none). Only documents that may have some are moved to meet them; the others are done where they are read."""
    hits = reliable(repeated_windows(docs, window, crowd).groupBy(F.col("doc_id").alias("id"), "uid").agg(
        F.collect_list(F.struct("start", "mask")).alias("h")))
    shared = docs.sparkSession.sparkContext.broadcast(key_map(hits.select("id", "uid")))
    uid = ((F.crc32(as_bytes("text")) + F.lit(1 << 31)) % F.lit(1 << 32) - F.lit(1 << 31)).cast("int")
    named = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), uid.alias("uid"))

    @F.pandas_udf("boolean")
    def maybe(name: pd.Series) -> pd.Series:
        return pd.Series(may_have(shared.value, name.to_numpy()))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~may_have(shared.value, b.column(1).to_numpy())))
            none = pa.nulls(b.num_rows, pa.list_(pa.int32()))
            yield from work(iter([pa.RecordBatch.from_arrays([b.column(0), none, none], ["row", "starts", "masks"])]))

    found = named.filter(maybe(F.xxhash64("id", "uid"))).join(hits, ["id", "uid"], "left").select(
        "row", F.col("h.start").alias("starts"), F.col("h.mask").alias("masks"))
    return found.mapInArrow(work, schema).unionByName(named.select("row", F.xxhash64("id", "uid")).mapInArrow(rest, schema))


def _of(b: pa.RecordBatch, i: int) -> list[np.ndarray | None]:
    return [None if x is None else np.array(x, np.int64) for x in b.column(i).to_pylist()]


def without_repeats(docs: DataFrame, window: int = WINDOW, crowd: int = 20_000) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space, as bytes),
    stripped (the text without the removed words and the white space after each; null stays null). An empty table
    gives no rows; columns but doc_id and text are not looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, gone, kept, bare = [], [], [], []
            ids, texts = b.column(0).flatten()
            for text, start, mask in zip(texts.to_pylist(), _of(b, 1), _of(b, 2)):
                words = (text or b"").split()
                n.append(len(words))
                if start is None:
                    gone.append(0)
                    kept.append(b" ".join(words))
                    bare.append(text)
                    continue
                out = covered(len(words), start, mask, window)
                gone.append(int(out.sum()))
                stay = ~out
                kept.append(b" ".join([w for w, s in zip(words, stay.tolist()) if s]))
                bare.append(_strip(text, words, out))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(bare, pa.binary())], ["doc_id", "n_words", "n_removed", "kept", "stripped"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return over_hits(rows, run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary, stripped binary", window, crowd)


def _strip(text: bytes, words: list[bytes], out: np.ndarray) -> bytes:
    """The text without the removed words, each with the white space that follows it."""
    parts, at, cuts = [], 0, out.tolist()
    places = []
    for w in words:
        at = text.index(w, at)
        places.append(at)
        at += len(w)
    places.append(len(text))
    parts.append(text[:places[0]])
    parts += [text[places[i]:places[i + 1]] for i, cut in enumerate(cuts) if not cut]
    return b"".join(parts)


def drop_repeats(docs: DataFrame, window: int = WINDOW, crowd: int = 20_000) -> DataFrame:
    """The documents with repeated passages cut out of their texts and n_chars counted anew; all rows stay,
    other columns are unchanged, whatever their names. A document that keeps nothing has an empty text; an empty
    table gives no rows."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, starts, masks = b.columns
            columns = row.flatten()
            text = columns[names.index("text")]
            out = []
            for t, start, mask in zip(text.to_pylist(), starts.to_pylist(), masks.to_pylist()):
                if start is not None:
                    raw = t.encode()
                    words = raw.split()
                    t = _strip(raw, words, covered(len(words), np.array(start, np.int64), np.array(mask, np.int64), window)).decode()
                out.append(t)
            cols = [pa.array(out, pa.string()) if f == "text" else c for f, c in zip(names, columns)]
            yield pa.RecordBatch.from_arrays(cols, names)

    done = over_hits(docs, run, docs.schema, window, crowd)
    return done.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else done
