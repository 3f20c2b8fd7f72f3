"""Alignment of two tokenizers over a corpus: which tokens of A and B overlap, and how often each pair does.

A text is spelled by both tokenizers; where tokens of both end at one byte, it is cut into groups. A token pair is
linked when its byte ranges overlap. Most groups hold one token of each with the same bytes: an array from A's ids
to B's ids of the same bytes, made once from the vocabularies, tells them, and they are counted in a vector as long
as A's vocabulary. Only pairs of other groups are shuffled, added up per task.

Neither tokenizer joins over the edge between a word and the white space after it, so texts are cut there into
chunks; each chunk is spelled once per task and remembered, up to a bound. The edges are found out from the
vocabularies; texts in which they would be in doubt are cut only where they are not, or not at all. Texts are
spelled once; their links are written to the shared folder, two or four bytes each, for counting and summing up.

Sums over links: the vector, the highest count of each B id and the `TOP` most frequent other pairs are all bounded,
and go to every task. A pair that is not among them has less than a share of about 1 / TOP of all links, so the
join that adds up what is left has no hot key.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeline.llm.common import as_bytes, by_size, reliable
from tapeline.llm.packing import ODD_SPACE, Encoder

TOP, BATCH = 200_000, 2_000_000
SPACE = "▁"                                     # stands for a space in B's pieces


def _longer(x: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n entries at least, doubled when it grows."""
    if n <= len(x):
        return x
    return np.concatenate([x, np.zeros((max(n, 2 * len(x)) - len(x), *x.shape[1:]), x.dtype)])


class Aligner:
    """Chunks of texts spelled by both tokenizers. Chunk k has sizes[k] = (tokens of A, of B, groups, links), the text
    spelled[k] of its groups and its links in link_a and link_b from begin[k] on; whole[k] is false for chunks that
    B does not spell byte by byte."""

    def __init__(self, a_path: str, b_path: str, memory: int = 400_000) -> None:
        import sentencepiece
        read = Encoder(a_path)
        self.core, self.size_a = read.core, read.size
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        plain = {x: i for i, x in enumerate(self.bytes_b) if x}          # of equal bytes, a piece goes before a byte
        plain |= {x: i for i, x in enumerate(self.bytes_b) if x and not self.pieces.is_byte(i)}
        #: A's id to B's id of the same bytes, or -1
        self.same = np.array([plain.get(self._token(i), -1) if n else -1 for i, n in enumerate(self.size_a.tolist())], np.int64)
        odd = ODD_SPACE.pattern[1:-1]
        inner = {c for x in self.bytes_b for c in re.findall("(?<=[^\\s])\\s", x.decode(errors="ignore"))}
        self.edges = "".join(c for c in " \n\t\r" if c not in inner)     # neither joins these to a word before
        self.usual = re.compile(f"[{self.edges}]*[^{self.edges}]+|[{self.edges}]+") if self.edges else None
        self.unusual = re.compile(f"(?<=[^\\s{odd}])(?=[{self.edges}])") if self.edges else None
        self.doubtful = re.compile(f"[{odd}{''.join(c for c in ' \n\t\r' if c in inner)}]")
        #: id * 4 + what follows it: another of its group and side, B's side, another group, another chunk
        self.names = [f"{i}{after}" for i in range(max(len(self.same), len(self.size_b))) for after in (",", "|", ";", "\n")]
        #: how links are written: ids of A, and pairs as a * (ids of B) + b
        self.id_type = np.dtype("<u2" if len(self.same) <= 1 << 16 else "<u4")
        self.pair_type = np.dtype("<u4" if len(self.same) * len(self.size_b) <= 1 << 32 else "<u8")
        self.memory = memory
        self.clear()

    def _piece(self, i: int) -> bytes:
        if self.pieces.is_byte(i):
            return bytes([int(self.pieces.id_to_piece(i)[1:-1], 16)])
        if self.pieces.is_control(i) or self.pieces.is_unknown(i):
            return b""
        return self.pieces.id_to_piece(i).replace(SPACE, " ").encode()

    def _token(self, i: int) -> bytes:
        return self.core.decode_single_token_bytes(i)

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.spelled: list[bytes] = []
        self.sizes = np.zeros((1024, 4), np.int64)
        self.whole, self.begin = np.zeros(1024, bool), np.zeros(1024, np.int64)
        self.link_a, self.link_b, self.n_links = np.zeros(1024, np.int32), np.zeros(1024, np.int32), 0

    def cut(self, text: str) -> list[str]:
        """Chunks of a space and the text; an empty text has none."""
        if not text:
            return []
        text = " " + text
        if " " not in self.edges:
            return [text]
        return self.unusual.split(text) if self.doubtful.search(text) else self.usual.findall(text)

    def _spell(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for a text that starts with white space; None if the bytes of B are others, or A has no token for it."""
        a = np.array(self.core.encode_ordinary(text), np.int64)
        whole = text[0] == " " and len(text) > 1        # B sets a space before a text, and none before an empty one
        ids = self.pieces.encode(text[1:] if whole else "a" + text)
        if not whole:                                   # that and the letter are taken off
            if not ids or self.bytes_b[ids[0]] != b" a":
                return None
            ids = ids[1:]
        if b"".join([self.bytes_b[i] for i in ids]) != text.encode():
            return None
        return a, np.array(ids, np.int64)

    def _add(self, chunks: list[str], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
        """Remembers chunks that are spelled end to end; false if a chunk's end is not one of both."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        if not np.isin(ends, common).all():
            return False
        base = len(self.spelled)
        self._grow(base + len(chunks))
        every = np.union1d(end_a, end_b)                # each stretch between neighbours is one link
        for k, at in enumerate((end_a, end_b, common, every)):
            self.sizes[base:base + len(chunks), k] = np.bincount(np.searchsorted(ends, at), minlength=len(chunks))
        self.whole[base:base + len(chunks)] = True
        size = self.sizes[base:base + len(chunks), 3]
        self.begin[base:base + len(chunks)] = self.n_links + np.cumsum(size) - size
        upto = self.n_links + len(every)
        self.link_a, self.link_b = (_longer(x, upto) for x in (self.link_a, self.link_b))
        self.link_a[self.n_links:upto] = a[np.searchsorted(end_a, every)]
        self.link_b[self.n_links:upto] = b[np.searchsorted(end_b, every)]
        self.n_links = upto
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        after_a = np.r_[group_a[1:] != group_a[:-1], True] * 1
        after_b = np.r_[group_b[1:] != group_b[:-1], True] * 2 + np.isin(end_b, ends)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        code = np.concatenate([4 * a + after_a, 4 * b + after_b])[order].tolist()
        self.spelled += "".join([self.names[c] for c in code]).encode().split(b"\n")[:-1]
        self.known.update(zip(chunks, range(base, base + len(chunks))))
        return True

    def _grow(self, n: int) -> None:
        self.sizes, self.whole, self.begin = (_longer(x, n) for x in (self.sizes, self.whole, self.begin))

    def _learn_one(self, chunk: str) -> None:
        ids = self._spell(chunk)
        if ids is None or not self._add([chunk], np.array([len(chunk.encode())]), *ids):
            self._grow(len(self.spelled) + 1)
            self.known[chunk] = len(self.spelled)
            self.whole[len(self.spelled)] = False
            self.spelled.append(b"")

    def learn(self, new: set[str]) -> None:
        """Spells chunks not known yet: those that end in a word together, white space at a text's end alone."""
        joined = "".join(new)
        simple = self.edges and SPACE not in joined and not self.doubtful.search(joined)
        together = [c for c in new if c[0] in self.edges and c[-1] not in self.edges and (
            simple or (SPACE not in c and not self.doubtful.search(c)))]
        if together:
            joined = "".join(together)
            ids = self._spell(joined)
            if ids is not None:
                self._add(together, np.cumsum([len(c.encode()) for c in together]), *ids)
        for c in new:
            if c not in self.known:
                self._learn_one(c)

    def index(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(chunk numbers of all texts, where each text's begin). A text with a chunk that is not spelled byte by
        byte gets none."""
        cuts = [self.cut(t) for t in texts]
        new = set().union(*cuts).difference(self.known)
        if len(self.known) + len(new) > self.memory and self.known:
            self.clear()
            new = set().union(*cuts)
        if new:
            self.learn(new)
        known = self.known
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        number = np.fromiter([known[c] for cut in cuts for c in cut], np.int64, int(size.sum()))
        text = np.repeat(np.arange(len(cuts)), size)
        bad = ~self.whole[number]
        if bad.any():
            stay = ~np.isin(text, text[bad])
            number, text = number[stay], text[stay]
        return number, np.searchsorted(text, np.arange(len(cuts) + 1))

    def linked(self, number: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, where each text's begin) of the links of indexed texts."""
        size = self.sizes[number, 3]
        upto = np.r_[0, np.cumsum(size)]
        at = np.repeat(self.begin[number] - upto[:-1], size) + np.arange(upto[-1])
        return self.link_a[at].astype(np.int64), self.link_b[at].astype(np.int64), upto[bounds]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker, kept from task to task."""
    return Aligner(a_path, b_path)


def _cut(raw: bytes, bounds: np.ndarray) -> list[bytes]:
    edge = bounds.tolist()
    return [raw[x:y] for x, y in zip(edge[:-1], edge[1:])]


def _edges(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows of a binary column, and where each row's begin."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).astype(np.int64), np.r_[0, np.cumsum([len(r) for r in rows])] // kind.itemsize


SIZES = ("n_a", "n_b", "n_groups", "n_links")


def links(docs: DataFrame, a_path: str, b_path: str, keep: list[str], spell: bool = False) -> DataFrame:
    """(row, n_a, n_b, n_groups, n_links, groups_sha256, groups, same, other) per row of docs: `row` holds the columns
    to keep, `same` A's ids of links with their own bytes in B, and `other` the pairs of all others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in by_size(batches, 0, BATCH):
            number, bounds = own.index([t.decode() for t in batch.column(0).to_pylist()])
            a, b, edge = own.linked(number, bounds)
            fast = own.same[a] == b
            before = np.r_[0, np.cumsum(fast)][edge]
            same = _cut(a[fast].astype(own.id_type).tobytes(), before * own.id_type.itemsize)
            other = _cut((a[~fast] * len(own.size_b) + b[~fast]).astype(own.pair_type).tobytes(), (edge - before) * own.pair_type.itemsize)
            sizes = np.diff(np.r_[np.zeros((1, 4), np.int64), np.cumsum(own.sizes[number], 0)][bounds], axis=0)
            numbers, at, shas, groups = number.tolist(), bounds.tolist(), [], []
            for x, y in zip(at[:-1], at[1:]):
                text = b";".join([own.spelled[i] for i in numbers[x:y]]) if y > x else None
                shas.append(hashlib.sha256(text).hexdigest() if y > x else "")
                groups.append(text if spell else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array(c) for c in sizes.T.copy()), pa.array(shas, pa.string()), pa.array(groups, pa.binary()),
                 pa.array(same, pa.binary()), pa.array(other, pa.binary())],
                ["row", *SIZES, "groups_sha256", "groups", "same", "other"])

    rows = docs.select(as_bytes("text").alias("text"), F.struct(*keep).alias("row"))
    schema = rows.select("row", *(F.lit(0).cast("bigint").alias(c) for c in SIZES), F.lit("").alias("groups_sha256"),
                         *(F.lit(b"").alias(c) for c in ("groups", "same", "other"))).schema
    for field in schema.fields:
        field.nullable = True
    return rows.mapInArrow(run, schema)


def counts(linked: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a, b, n) from rows of `links`: how many links hold the pair. b is -1 for A's pair with its own bytes in B,
    which is counted in a vector per task and comes as at most one row of an id from each; other pairs are added up
    per batch. No rows give none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        vector = np.zeros(len(own.same), np.int64)

        def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n)], ["a", "b", "n"])

        def added() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return rows(pair // len(own.size_b), pair % len(own.size_b), n)

        held: list[np.ndarray] = []
        for batch in batches:
            vector += np.bincount(_edges(batch.column(0), own.id_type)[0], minlength=len(vector))
            held.append(_edges(batch.column(1), own.pair_type)[0])
            if sum(map(len, held)) > 4_000_000:
                yield added()
        if held:
            yield added()
        some = np.flatnonzero(vector)
        yield rows(some, np.full(len(some), -1), vector[some])

    return linked.select("same", "other").mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def pair_table(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a, b, n) with B's own id in every row: the whole table of pairs that are linked somewhere. Null and empty
    texts, and texts that the tokens do not spell byte by byte, have no links; repeated rows count each."""
    own = aligner(a_path, b_path)
    same = docs.sparkSession.createDataFrame([(a, int(b)) for a, b in enumerate(own.same) if b >= 0], "a int, same int")
    found = counts(links(docs.select("text"), a_path, b_path, ["text"]), a_path, b_path).join(same, "a", "left")   # as long as a vocabulary
    return found.select("a", F.when(F.col("b") < 0, F.col("same")).otherwise(F.col("b")).alias("b"), "n")


RESULTS = (*SIZES, "n_best", "count_sum", "groups_sha256", "groups")


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str], top: int = TOP, spell: bool = False) -> DataFrame:
    """`keep` and per text: n_a, n_b, n_groups, n_links; n_best, the links whose count is the highest of their B id
    (ties included); count_sum, the counts of all links added up; groups_sha256 of the groups spelled as
    `a1,a2|b1;a3|b2,b3`, and with `spell` those bytes themselves as groups.

    Texts that are null, empty, or not spelled byte by byte by both tokenizers have zeros and '' (groups: null).
    Rows that repeat count each and are told alike; an empty table gives no rows; texts are read whole. Columns in
    `keep` may have any names but those of the results (a ValueError). The files must be at the same path on every
    executor. `top` decides only which pairs travel to the tasks and which are joined.
    """
    if set(keep) & set(RESULTS):
        raise ValueError("columns to keep have names of the results")
    spark = docs.sparkSession
    linked = reliable(links(docs, a_path, b_path, keep, spell))
    table = reliable(counts(linked, a_path, b_path))
    own = aligner(a_path, b_path)
    vector, best = np.zeros(len(own.same), np.int64), np.zeros(len(own.size_b), np.int64)
    for r in table.filter("b < 0").toArrow().to_batches():                        # as long as A's vocabulary
        vector[r.column(0).to_numpy()] = r.column(2).to_numpy()
    pairs = table.filter("b >= 0")
    np.maximum.at(best, own.same[vector > 0], vector[vector > 0])
    for r in pairs.groupBy("b").agg(F.max("n").alias("n")).toArrow().to_batches():  # as long as B's
        np.maximum.at(best, r.column(0).to_numpy(), r.column(1).to_numpy())
    # the most frequent pairs: all from a step of the counts on, of which there are 8 to a doubling
    step = F.floor(F.log2("n") * 8)
    upto, least = 0, None
    for s, k in sorted(pairs.groupBy(step).count().collect(), reverse=True):       # at most 504 rows
        if upto + k > top:
            least = s
            break
        upto += k
    often = (pairs if least is None else pairs.filter(step > least)).toArrow()      # at most `top` rows
    key = often["a"].to_numpy().astype(np.int64) * len(best) + often["b"].to_numpy()
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((vector, best, key[order], often["n"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (vector, best, often, often_n) = aligner(a_path, b_path), shared.value
        top_of = vector == best[own.same]                                          # by A's id, for its own bytes
        for batch in by_size(batches, 1, BATCH):
            ids, edge = _edges(batch.column(0), own.id_type)
            pair, edge2 = _edges(batch.column(1), own.pair_type)
            at = np.minimum(np.searchsorted(often, pair), max(0, len(often) - 1))
            here = often[at] == pair if len(often) else np.zeros(len(pair), bool)
            n = np.where(here, often_n[at], 0) if len(often) else np.zeros(len(pair), np.int64)
            good = here & (n == best[pair % len(best)])
            added = lambda v, e: np.diff(np.r_[0, np.cumsum(v)][e])                # noqa: E731 - sums per text
            left: list = [None] * batch.num_rows
            lost = np.flatnonzero(~here)
            if len(lost):
                row = np.searchsorted(edge2, lost, "right") - 1
                for i, x, y in zip(*_spans(row)):
                    p, k = np.unique(pair[lost[x:y]], return_counts=True)
                    left[i] = [{"a": u // len(best), "b": u % len(best), "n": v} for u, v in zip(p.tolist(), k.tolist())]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(added(top_of[ids], edge) + added(good, edge2)),
                 pa.array(added(vector[ids], edge) + added(n, edge2)), pa.array(left, kind)], [*told, "n_best", "count_sum", "rest"])

    told = ["row", *SIZES, "groups_sha256", "groups"]
    schema = linked.select(*told, *(F.lit(None).cast(t).alias(c) for c, t in (
        ("n_best", "bigint"), ("count_sum", "bigint"), ("rest", "array<struct<a:int,b:int,n:bigint>>")))).schema
    out = linked.select("same", "other", *told).mapInArrow(run, schema)
    if least is not None:
        # pairs that did not travel: their counts are joined and added up per row
        out = reliable(out.withColumn("uid", F.monotonically_increasing_id()))
        lacking = out.filter("rest is not null").select("uid", F.inline("rest")).withColumnRenamed("n", "times")
        highest = spark.createDataFrame(list(enumerate(best.tolist())), "b int, highest bigint")
        seldom = pairs.filter(step <= least).join(highest, "b")                     # as long as B's vocabulary
        more = lacking.join(seldom, ["a", "b"]).groupBy("uid").agg(
            F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0)).alias("good"))
        out = out.join(more, "uid", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("good", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return out.select(*(F.col("row")[c].alias(c) for c in keep), *RESULTS)


def _spans(row: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(value, from, to) of the stretches of a sorted array."""
    new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return row[new].tolist(), new.tolist(), [*new[1:].tolist(), len(row)]
