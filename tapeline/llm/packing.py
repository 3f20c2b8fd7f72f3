"""Best-fit packing of tokenised documents into sequences of a fixed length, by exact-complement hashing.

Pieces are counted by length: at most `length` counts, all that the driver sees of the data. The plan takes
the longest pieces first and looks up what fills their gap exactly: one piece, then two, then three, by
hashing the sums of the available lengths, and repeats the combination as often as its counts allow. What
has no exact filling takes the largest piece that fits, and then looks again. Pieces of one length are
numbered across all partitions, and a piece's number says which sequence of the plan it goes to.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tapeline.llm.common import by_size, reliable

#: White space other than these four takes part in the tokenizer's splits in ways that differ by library.
ODD_SPACE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
#: White space with what follows it up to the next white space: the tokenizer never joins over such an edge.
CHUNK = re.compile("[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")


#: The split pattern of byte-level BPE, and the characters that stand for bytes in its files.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHOWN = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, by the vocabulary of a `tokenizers` file with
    byte-level BPE, whose ids are in the order of its merges. Chunks between white space are encoded once
    and remembered, at most `memory` of them at a time. The `tokenizers` library gives the same ids, but
    takes three times as long per chunk; the tests compare both."""

    def __init__(self, path: str, memory: int = 600_000) -> None:
        import tiktoken
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"] is None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("only byte-level BPE files are read")
        hidden = [b for b in range(256) if b not in SHOWN]
        byte = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"] for t in spec["added_tokens"]}
        if spec.get("normalizer") or any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only files without a normalizer and with plain added tokens are read")
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.memory, self.known = memory, {}
        # added tokens stand for themselves wherever they are: the leftmost, then the longest
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in spec["added_tokens"] if t["content"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _plain(self, text: str) -> bytes:
        ids = self.core.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, chunks: list[str]) -> None:
        """Chunks with white space at the front only: encoded in one go, and told apart by their bytes."""
        if chunks:
            raw = self._plain("".join(chunks))
            ends = np.cumsum(self.size[np.frombuffer(raw, "<u4")])
            want = np.cumsum([len(c.encode()) for c in chunks])
            at = np.searchsorted(ends, want, "right")
            if (ends[at - 1] == want).all():
                begin = [0, *(4 * at[:-1]).tolist()]
                self.known.update(zip(chunks, [raw[a:b] for a, b in zip(begin, (4 * at).tolist())]))

    def ids(self, text: str) -> bytes:
        """Ids of a text as the library gives them by default: added tokens of the file are cut out first."""
        if self.cut is None or not self.cut.search(text):
            return self.encode(text)
        parts = self.cut.split(text)                # texts at even places, added tokens between them
        return b"".join(self.added[p] if i % 2 else self.encode(p) for i, p in enumerate(parts))

    def encode(self, text: str) -> bytes:
        """Ids of a text in which nothing is an added token."""
        if ODD_SPACE.search(text):
            return self._plain(text)
        chunks, known = CHUNK.findall(text), self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            new = set(chunks).difference(known)
            if len(known) + len(new) > self.memory:
                known.clear()
                new = set(chunks)
            self._learn([c for c in new if c[0] in " \n\t\r" and c[-1] not in " \n\t\r"])
            for c in new:
                if c not in known:
                    known[c] = self._plain(c)
        return b"".join([known[c] for c in chunks])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, kept from task to task; what it remembers of texts is dropped at the end of a task."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, length: int = 1024, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and the id `end`, cut into pieces of
    `length` if longer, of which the first takes what is over. A null text is empty: one piece of one token."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = encoder(tokenizer), np.array([end], "<u4").tobytes()
        try:
            yield from encoded(own.ids, last, batches)
        finally:
            own.known.clear()                       # else idle workers hold it while other steps run

    def encoded(encode: Callable[[str], bytes], last: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 1, 2_000_000):
            row, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text.decode()) + last
                n = len(ids) // 4
                count = -(-n // length)
                cut = [0, *(n - length * (count - k) for k in range(1, count)), n]
                for k in range(count):
                    row.append(i)
                    piece.append(k)
                    start.append(cut[k])
                    size.append(cut[k + 1] - cut[k])
                    crc.append(zlib.crc32(ids[4 * cut[k]:4 * cut[k + 1]]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text")
    return docs.select("doc_id", text).mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _fill(have: np.ndarray, gap: int) -> list[int] | None:
    """Available lengths that add up to `gap`: one, two or three, the largest first. have[x]: some are left."""
    if gap < len(have) and have[gap]:
        return [gap]
    def two(g: int, most: int) -> list[int] | None:
        low = have[1:g]                                    # the pair (x, g - x)
        both = np.flatnonzero(low & low[::-1]) + 1
        both = both[(both >= g - both) & (both <= most)]
        return [int(both[-1]), int(g - both[-1])] if len(both) else None
    pair = two(gap, gap)
    if pair:
        return pair
    for x in (np.flatnonzero(have[:gap - 1])[::-1]).tolist():
        if 3 * x < gap or x < 1:
            break
        rest = two(gap - x, x)
        if rest:
            return [x, *rest]
    return None


def plan(counts: np.ndarray, length: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a sequence, how many sequences) that use up counts[x] pieces of length x."""
    left, out = counts.astype(np.int64).copy(), []
    while left.any():
        head = int(np.flatnonzero(left)[-1])
        use = np.zeros(length + 1, np.int64)
        use[head] += 1
        parts, gap = [head], length - head
        while gap:
            have = left > use
            have[gap + 1:] = False
            have[0] = False
            if not have.any():
                break
            # a combination may need a length twice: both must be there
            found = _fill(have, gap)
            if found and all(left[x] - use[x] >= found.count(x) for x in found):
                take = found
            else:
                take = [int(np.flatnonzero(have)[-1])]
            for x in take:
                use[x] += 1
                gap -= x
            parts += take
        some = np.flatnonzero(use)
        times = int((left[some] // use[some]).min())
        left -= use * times
        out.append((parts, times))
    return out


def slots(patterns: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Where the pieces of a length go, by their number: rows (length, first, end, each, sequence, offset).
    Numbers first to end - 1 fill `each` neighbours per sequence from `offset`. One row per pattern and
    length, so the table has a few thousand rows at most, however many pieces there are."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, times in patterns:
        offset = 0
        ordered = sorted(parts, reverse=True)
        for x in dict.fromkeys(ordered):
            each = ordered.count(x)
            first = used.get(x, 0)
            rows.append((x, first, first + each * times, each, sequence, offset))
            used[x] = first + each * times
            offset += x * each
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "end", "each", "sequence", "offset"]).sort_values(
        ["length", "first"], ignore_index=True)


def numbered(rows: DataFrame, group: str, order: list[str], parts: int) -> DataFrame:
    """`rows` with rank, from 0, within each group, without gathering a group: every group is cut into
    `parts` by a hash of `order`, and ranks count on from part to part."""
    cut = rows.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    part = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(group, "__part").agg(F.count("*").alias("__n")).select(
        group, "__part", F.coalesce(F.sum("__n").over(part), F.lit(0)).alias("__before"))
    own = Window.partitionBy(group, "__part").orderBy(*order)
    return (cut.withColumn("__own", F.row_number().over(own) - 1).join(before, [group, "__part"])
            .withColumn("rank", F.col("__own") + F.col("__before")).drop("__part", "__own", "__before"))


def packed(cut: DataFrame, length: int = 1024, share: int = 2_000) -> DataFrame:
    """Pieces with sequence_id and offset; they are numbered in parts of about `share` rows. Empty in, empty
    out; any other columns stay."""
    cut = reliable(cut)
    counts = np.zeros(length + 1, np.int64)
    for size, n in cut.groupBy("length").count().collect():          # at most `length` rows
        counts[size] = n
    where = slots(plan(counts, length))
    bounds = {int(x): g.reset_index(drop=True) for x, g in where.groupby("length")}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for size, at in f.groupby("length").groups.items():
                slot, rank = bounds[int(size)], f.loc[at, "rank"].to_numpy()
                s = slot.iloc[np.searchsorted(slot["first"].to_numpy(), rank, "right") - 1]
                over = rank - s["first"].to_numpy()
                f.loc[at, "sequence_id"] = s["sequence"].to_numpy() + over // s["each"].to_numpy()
                f.loc[at, "offset"] = s["offset"].to_numpy() + over % s["each"].to_numpy() * int(size)
            yield f.drop(columns="rank")

    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in cut.columns]
    ranked = numbered(cut, "length", order, max(1, -(-int(counts.sum()) // share))).withColumns(
        {"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    return ranked.select(*cut.columns, "sequence_id", "offset", "rank").mapInPandas(
        place, cut.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).schema)


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end: int = 2) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Pieces keep null doc_ids and
    repeated rows; other columns of the documents are not looked at."""
    return packed(pieces(docs, tokenizer, length, end), length)
