"""Scoring texts once each, with any scorer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tapeline.functions import fixed
from tapeline.functions.textual import label_score, lexicon_hits, top_label, confidence
from tapeline.operators.skew import salted_join

Scorer = Callable[[Column], Column]


def lexicon_scorer(positive: Sequence[str] = fixed.POSITIVE_WORDS,
                   negative: Sequence[str] = fixed.NEGATIVE_WORDS) -> Scorer:
    """Probabilities from word counts, one pseudo-word per class. A model takes its place as a
    pandas UDF from text to struct<positive, negative, neutral>."""
    def score(text: Column) -> Column:
        good, bad = lexicon_hits(text, positive), lexicon_hits(text, negative)
        total = good + bad + F.lit(3.0)
        return F.struct(((good + 1) / total).alias("positive"), ((bad + 1) / total).alias("negative"),
                        (F.lit(1.0) / total).alias("neutral"))
    return score


def _text_key(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_key", F.sha2(F.col(text), 256))


def new_scores(texts: DataFrame, cache: DataFrame | None, scorer: Scorer, text: str = "text") -> DataFrame:
    """Scores of the distinct texts that the cache does not hold yet.

    Copies collapse map-side on a hash of the whole text before the scorer sees any of them.
    """
    distinct = (_text_key(texts.where(F.col(text).isNotNull()), text)
                .groupBy("_key").agg(F.any_value(text).alias("text")))
    if cache is not None:
        distinct = distinct.join(_text_key(cache, "text").select("_key"), "_key", "left_anti")
    scored = distinct.select("text", scorer(F.col("text")).alias("_p"))
    return scored.select("text", *[F.col(f"_p.{c}").cast("double").alias(c) for c in fixed.LABELS])


def extended_cache(cache: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Old and new scores; of a text that is in both the old score stays. A text twice in one of them keeps
    its smallest score."""
    if cache is None:
        return fresh
    first = F.min(F.struct("_new", *fixed.LABELS))
    both = cache.withColumn("_new", F.lit(1)).unionByName(fresh.withColumn("_new", F.lit(2)))
    return both.groupBy("text").agg(first.alias("_s")).select("text", *[F.col(f"_s.{c}").alias(c) for c in fixed.LABELS])


def attach_scores(texts: DataFrame, scores: DataFrame, text: str = "text") -> DataFrame:
    """Every input row with its scores, label and -1/0/1 score. A text copied many times is spread
    by salt."""
    keyed = (_text_key(scores, "text").groupBy("_key")
             .agg(*[F.any_value(c).alias(c) for c in fixed.LABELS]))
    joined = salted_join(_text_key(texts, text), keyed, ["_key"], "left").drop("_key")
    probs = [F.col(c) for c in fixed.LABELS]
    return (joined.withColumn("label", top_label(*probs))
            .withColumn("label_score", label_score(F.col("label")))
            .withColumn("confidence", confidence(*probs)))


def label_crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    return (df.groupBy(rows).pivot(columns, list(fixed.LABELS)).agg(F.count(F.lit(1))).na.fill(0))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    same = (F.col(a) == F.col(b)).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(same).alias("agreement"),
                  F.avg((F.col(a) == "neutral").cast("double")).alias("neutral_a"),
                  F.avg((F.col(b) == "neutral").cast("double")).alias("neutral_b"))


def opposite_labels(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(((F.col(a) == "positive") & (F.col(b) == "negative"))
                    | ((F.col(a) == "negative") & (F.col(b) == "positive")))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
