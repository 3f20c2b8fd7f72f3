"""Language identification by words, with backoff to character n-grams.

Training counts, for each language, the words and the character n-grams (of words with an edge mark at
either end) of a bounded sample of labelled documents, `max_docs` of each language. The model is a bounded
table: at most `max_words` words and `max_grams` n-grams of each length, the most frequent of those seen at
least twice. A known word adds its smoothed
log frequency in each language, less that over all languages; a word that is not in the table is covered by its
longest known n-grams, from `longest` characters down to one. The sum per language, softened, gives the
score: the chosen language's share.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tapeline.llm.common import by_size, reliable

LETTERS = re.compile(r"[^\W\d_]+")
MAX_WORDS, MAX_GRAMS, LONGEST, MAX_DOCS = 50_000, 20_000, 5, 10_000
UNKNOWN = "und"


def _grams(word: str, longest: int) -> Iterator[str]:
    marked = f"<{word}>"
    for n in range(1, longest + 1):
        for i in range(len(marked) - n + 1):
            yield marked[i:i + n]


def counts(labelled: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(size, term, lang, n) over all rows (text, lang); size 0 for words, else the n-gram's length. Counts
    are added up per batch before they are shuffled."""
    def rows_of(table: Counter, lang: str, word: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([0 if word else len(t) for t in table], pa.int32()), pa.array(list(table), pa.string()),
             pa.array([lang] * len(table), pa.string()), pa.array(list(table.values()), pa.int64())], ["size", "term", "lang", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 0, 8_000_000):
            words: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words[lang].update(LETTERS.findall(text.decode().lower()))
            for lang, found in words.items():
                yield rows_of(found, lang, True)
                grams: Counter = Counter()
                for word, k in found.items():
                    for g in _grams(word, longest):
                        grams[g] += k
                        if len(grams) >= 2_000_000:                    # long runs of letters: partial counts
                            yield rows_of(grams, lang, False)
                            grams.clear()
                yield rows_of(grams, lang, False)

    text = F.col("text").cast("string").cast("binary").alias("text")
    rows = labelled.filter("text is not null and lang is not null").select(text, "lang")
    made = rows.mapInArrow(run, "size int, term string, lang string, n bigint")
    return made.groupBy("size", "term", "lang").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Bounded tables of log frequencies; `tables[0]` for words, then by n-gram length."""
    langs: list[str]
    tables: list[dict[str, int]]
    weights: list[np.ndarray]
    longest: int
    #: How much the evidence of one letter run counts: neighbouring words are no independent draws.
    soft: float = 1.0

    def _unseen(self, word: str) -> np.ndarray:
        marked, out, at, parts = f"<{word}>", np.zeros(len(self.langs)), 0, 0
        while at < len(marked):
            for n in range(min(self.longest, len(marked) - at), 0, -1):
                row = self.tables[n].get(marked[at:at + n])
                if row is not None:
                    out += self.weights[n][row]
                    parts += 1
                    at += n
                    break
            else:
                at += 1
        return out / max(parts, 1)

    def predict(self, text: str, memory: dict[str, np.ndarray]) -> tuple[str, float]:
        words = LETTERS.findall(text.lower())
        if not words or not self.langs:
            return UNKNOWN, 0.0
        known, rows, rest = self.tables[0], [], np.zeros(len(self.langs))
        for word in words:
            row = known.get(word, -1)
            if row >= 0:
                rows.append(row)
            else:
                got = memory.get(word)
                if got is None:
                    got = self._unseen(word)
                    if len(word) <= 64:                 # longer runs hardly come twice
                        if len(memory) > 100_000:
                            memory.clear()
                        memory[word] = got
                rest += got
        total = (rest + self.weights[0][np.array(rows, np.int64)].sum(0)) * self.soft
        share = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.langs[best], float(share[best] / share.sum())


def sampled(labelled: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """About `max_docs` rows of each language (all, where there are fewer), chosen by a hash of the text
    and, where `labelled` has one, the doc_id: copies of a text are then drawn one by one."""
    sizes = labelled.filter("text is not null and lang is not null").groupBy("lang").count().collect()   # languages are few
    if not sizes:
        return labelled.limit(0)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, max_docs / r["count"]))])
    told = [c for c in ("text", "doc_id") if c in labelled.columns]
    draw = F.pmod(F.xxhash64(*told), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.filter("text is not null and lang is not null").filter(draw < F.element_at(share, F.col("lang")))


def _columns(rows: pa.Table, langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The terms of rows (term, lang, n) in order, and of each row the places of its term and language, and n. Columns, not
    a Python object per row: these rows are the most that the driver holds."""
    terms = rows["term"].unique()
    terms = terms.take(pc.sort_indices(terms))
    at, lang = (pc.index_in(rows[c], value_set=v).to_numpy() for c, v in (("term", terms), ("lang", pa.array(langs, pa.string()))))
    return terms.to_pylist(), at, lang, rows["n"].to_numpy()


def train(labelled: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, longest: int = LONGEST,
          max_docs: int = MAX_DOCS) -> Model:
    """Model from rows (text, lang); rows with a null text or lang are passed over. No rows: no language.

    It is fitted on a bounded sample, `max_docs` rows of each language. The tables come to the driver: at
    most max_words + longest * max_grams terms, times languages. They hold all terms with at least so many
    occurrences, the least number for which they fit.
    """
    all_counts = reliable(counts(sampled(labelled, max_docs), longest))
    totals = reliable(all_counts.groupBy("size", "term").agg(F.sum("n").alias("total")).filter("total > 1"))
    upto = Window.partitionBy("size").orderBy(F.desc("total"))       # one row per number of occurrences
    fits = totals.groupBy("size", "total").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(upto)).filter(
        F.col("upto") <= F.when(F.col("size") == 0, max_words).otherwise(max_grams))
    least = {r["size"]: r["least"] for r in fits.groupBy("size").agg(F.min("total").alias("least")).collect()}
    enough = F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col("size")) if least else F.lit(None)
    kept = totals.filter(F.col("total") >= enough).select("size", "term")
    rows = all_counts.join(kept, ["size", "term"]).select("size", "term", "lang", "n").toArrow()      # bounded by the table's size
    mass = {(r["size"], r["lang"]): r["n"] for r in all_counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for _, lang in mass})
    tables, weights = [], []
    for size in range(longest + 1):
        terms, at, lang, seen = _columns(rows.filter(pc.equal(rows["size"], size)), langs)
        tables.append({term: i for i, term in enumerate(terms)})
        n = np.full((len(terms), len(langs)), 0.5)
        n[at, lang] += seen
        n /= np.array([mass.get((size, lang), 0) + 0.5 * max(1, len(terms)) for lang in langs])
        logs = np.log(n) if n.size else n
        weights.append(logs - logs.mean(1, keepdims=True) if n.size else logs)
    return Model(langs, tables, weights, longest)


def predict(docs: DataFrame, model: Model, keep: list[str], kept_text: str | None = None) -> DataFrame:
    """`keep`, lang_pred, score for every row, from its whole text alone. No letter or null: und, 0.
    `kept_text`: the column of `keep` that holds the text's bytes, which then travel to Python once and not twice."""
    shared = docs.sparkSession.sparkContext.broadcast(model)          # bounded, see `train`
    schema = docs.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    at = len(keep) if kept_text is None else keep.index(kept_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, np.ndarray] = {}
        own = shared.value
        for b in by_size(batches, at, 2_000_000):
            made = [own.predict(t.decode() if t else "", memory) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                [*keep, "lang_pred", "score"])

    text = [] if kept_text else [F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("__t")]
    return docs.select(*keep, *text).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The fold that is never learnt from: crc32 of the id as text leaves 1 by 3 (a null id: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learnt from the rows that are not held out."""
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents, columns unchanged, without those that have no language (no letter) or whose best
    language has a share below `least`."""
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    named = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("__row"), F.col("text").cast("string").cast("binary").alias("__text"))
    found = predict(named, model, ["__row", "__text"], "__text")
    text = F.col("__text").cast("string").cast(docs.schema["text"].dataType).alias("text")
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("__row.*", text).select(*docs.columns)
