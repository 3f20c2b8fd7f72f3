"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph (a line, cut after sentence ends so that short texts have several) is hashed to a wide vector;
a document is the sum of its paragraphs' vectors, lane by lane, modulo powers of two. Sums do not depend on
order, and a paragraph is inserted or deleted by adding or subtracting its vector. The vector has two parts:
64 lanes of 16 bits with uniform values, by which equal multisets are told, and 128 lanes of 24 bits with
values +1 and -1, whose scalar products estimate how many paragraphs two documents share.

A fingerprint is written in base64: the two parts, then the number of paragraphs (32 bits).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeline.llm.common import by_size, reliable, shuffle_width

EQUAL, SIGNS = 64, 128
CUT = re.compile(r"\n|(?<=[.!?]) ")
SIZE = EQUAL * 2 + SIGNS * 3 + 4


def paragraphs(text: str) -> list[str]:
    """Lines, cut after sentence ends; those of white space only are left out."""
    return [p for p in CUT.split(text) if p.strip()]


class Fingerprint:
    """A sum of paragraph vectors. Insertion and deletion commute; equal multisets are equal."""

    def __init__(self) -> None:
        self.equal, self.signs, self.count = np.zeros(EQUAL, np.uint16), np.zeros(SIGNS, np.int64), 0

    def add(self, parts: Iterable[str], times: int = 1) -> Fingerprint:
        raw = b"".join([hashlib.shake_128(p.encode()).digest(EQUAL * 2 + SIGNS // 8) for p in parts])
        rows = np.frombuffer(raw, np.uint8).reshape(-1, EQUAL * 2 + SIGNS // 8)
        lanes = np.ascontiguousarray(rows[:, :EQUAL * 2]).view("<u2").sum(0, dtype=np.int64) * times
        self.equal = (self.equal.astype(np.int64) + lanes).astype(np.uint16)
        ones = np.unpackbits(np.ascontiguousarray(rows[:, EQUAL * 2:]), axis=1).sum(0, dtype=np.int64)
        self.signs = (self.signs + (2 * ones - len(rows)) * times + (1 << 23)) % (1 << 24) - (1 << 23)
        self.count = (self.count + len(rows) * times) % (1 << 32)
        return self

    def remove(self, parts: Iterable[str]) -> Fingerprint:
        return self.add(parts, -1)

    def join(self, other: Fingerprint) -> Fingerprint:
        """Fingerprint of both together."""
        out = Fingerprint()
        out.equal = self.equal + other.equal
        out.signs = (self.signs + other.signs + (1 << 23)) % (1 << 24) - (1 << 23)
        out.count = (self.count + other.count) % (1 << 32)
        return out

    def text(self) -> str:
        signs = (self.signs % (1 << 24)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        return base64.b64encode(self.equal.astype("<u2").tobytes() + signs.tobytes() + self.count.to_bytes(4, "little")).decode()

    @classmethod
    def read(cls, text: str) -> Fingerprint:
        raw, out = base64.b64decode(text), cls()
        out.equal = np.frombuffer(raw[:EQUAL * 2], "<u2").astype(np.uint16)
        three = np.frombuffer(raw[EQUAL * 2:SIZE - 4], np.uint8).reshape(-1, 3).astype(np.int64)
        out.signs = (three[:, 0] + (three[:, 1] << 8) + (three[:, 2] << 16) + (1 << 23)) % (1 << 24) - (1 << 23)
        out.count = int.from_bytes(raw[-4:], "little")
        return out

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, else the estimated cosine of the paragraph counts, from 0 to 1; 0 where
        one has no paragraph. The estimate's deviation is about 0.09."""
        if self.count == other.count and (self.equal == other.equal).all() and (self.signs == other.signs).all():
            return 1.0
        size = float(np.sqrt((self.signs ** 2).sum() * float((other.signs ** 2).sum())))
        return 0.0 if not size else float(min(1.0, max(0.0, (self.signs * other.signs).sum() / size)))


def fingerprint(text: str | None) -> Fingerprint:
    return Fingerprint().add(paragraphs(text or ""))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the fingerprint of each row's whole text (null: empty)."""
    schema = docs.select(*keep).withColumn("fingerprint", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, len(keep), 8_000_000):
            made = [fingerprint(t.decode()).text() for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(made, pa.string())], [*keep, "fingerprint"])

    return docs.select(*keep, F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("__t")).mapInArrow(run, schema)


OUT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, borrowed, doc_id, text) in order; a row's next is the row below it, and a bucket's last
    row is borrowed from the next bucket. One text is held over from batch to batch."""
    held: tuple | None = None                     # bucket, doc_id, text, fingerprint
    for b in by_size(batches, 3, 8_000_000):
        ids, out = [], []
        for bucket, borrowed, doc, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
            if borrowed and (held is None or held[0] != bucket):
                continue                          # a second loan of repeated rows
            text = raw.decode()
            own = fingerprint(text)
            if held is not None and held[0] == bucket:
                _, before, first, mine = held
                n = len(first)
                edited = first[:n - n // 2] + text[:n // 2]
                changed = fingerprint(edited)
                ids.append(before)
                out.append((n, hashlib.sha256(edited.encode()).hexdigest(), mine.text(), changed.text(), mine.likeness(changed), mine.likeness(own)))
            held = None if borrowed else (bucket, doc, text, own)
        if out:
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             ["doc_id", *(f.split()[0] for f in OUT.split(", "))])


def edited_twins(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, and fingerprints of the text and of the edited text, whose last half is
    taken from the beginning of the next document (descending doc_id, null last, equal ids by text; after
    the last comes the first).

    Texts move once, to ranges of ids; the first row of each range is lent to the range before it. The
    driver sees two ids per range, whose number follows spark.sql.shuffle.partitions.
    """
    wide = shuffle_width(docs)
    count = buckets or 4 * wide
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"))
    bounds = rows.select(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 10 * count)).first()[0]
    bounds = np.array(sorted(set(bounds or [])), np.int64)

    @F.pandas_udf("int")
    def bucket(ids):        # a null id sorts last: it belongs to the lowest range
        import pandas as pd
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), "left")), dtype="int32")

    heads = (rows.select("doc_id").withColumn("bucket", bucket("doc_id")).groupBy("bucket")
             .agg(F.max("doc_id").alias("head")).orderBy(F.desc("bucket")).collect())     # one row per range
    if not heads:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, " + OUT)
    before = {h["bucket"]: heads[i - 1]["bucket"] for i, h in enumerate(heads)}           # the top's is the lowest
    lent = F.create_map(*[F.lit(x) for h in heads for x in (h["bucket"], before[h["bucket"]])])
    first = F.create_map(*[F.lit(x) for h in heads for x in (h["bucket"], h["head"])])
    placed = rows.withColumn("bucket", bucket("doc_id"))
    is_head = F.col("doc_id").eqNullSafe(F.element_at(first, F.col("bucket")))
    both = F.when(is_head, F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("l")),
                                   F.struct(F.element_at(lent, F.col("bucket")).alias("b"), F.lit(True).alias("l")))
                  ).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("l"))))
    spread = placed.withColumn("to", F.explode(both)).select(
        F.col("to.b").alias("bucket"), F.col("to.l").alias("borrowed"), "doc_id", "text")
    return (spread.repartition(wide, "bucket")
            .sortWithinPartitions("bucket", "borrowed", F.col("doc_id").desc_nulls_last(), "text")
            .mapInArrow(_walk, "doc_id bigint, " + OUT))
