"""Counts against a plain reading, trees against plain recursion, constraints, and odd rows."""

import random

import numpy as np
import pytest

from tapeline.llm import quality

DOCS = "doc_id bigint, text string, score string, row int"


def plain(text):
    t = text or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def texts():
    rng = random.Random(8)
    words = ["a", "bb", "é日", "#x", "|", "A1", "end.", "\xa0", "😀", "c"]
    out = [(d, "".join(rng.choice(words) + rng.choice([" ", "\n", " ", "\t", "\r\n", "  \n"]) for _ in range(rng.randint(0, 90)))) for d in range(120)]
    return out + [(500, None), (501, ""), (502, " \n\n "), (503, "long word " * 200), (None, "no id " * 60), (3, "same\n" * 70), (3, "same\n" * 70)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, score string")


@pytest.mark.parametrize("parts", [1, 4])
def test_counts_match_a_plain_reading(spark, parts):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in texts()], DOCS).repartition(parts)
    got = quality.rate(df, labels(spark, [(d, int(d % 5 > 0), "y") for d in range(120)] + [(None, 1, ""), (7, None, "")])).collect()
    want = sorted(((d, *plain(t)) for d, t in texts()), key=repr)
    assert sorted(((r["doc_id"], *(r[c] for c in quality.COUNTS[:5])) for r in got), key=repr) == want
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_repeats_with_many_words():
    ids = np.arange(1 << 20)
    ids[-3:] = [5, 6, 7]
    assert np.flatnonzero(quality.repeated(ids * 4097, np.zeros(len(ids), np.int64))).tolist() == [5, 6, 7, *range(len(ids) - 3, len(ids))]
    assert not quality.repeated(np.array([1, 2, 3, 1, 2, 3]), np.array([0, 0, 0, 1, 1, 1])).any()


def walked(trees, x):
    total = trees.base
    for at in trees.roots.tolist():
        while trees.left[at] != at:
            at = (trees.left if x[trees.feature[at]] <= trees.limit[at] else trees.right)[at]
        total += trees.value[at]
    return total


def noisy(n, rng):
    x = rng.random((n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(4 * x[:, 0] - 6 * x[:, 1] + 3 * np.sin(9 * x[:, 2]))))).astype(float)
    return x, y


def test_flat_arrays_give_what_the_trees_give_and_learn():
    rng = np.random.default_rng(1)
    x, y = noisy(4000, rng)
    trees = quality.fit(x, y, np.array([1, -1, 0]))
    assert np.allclose(trees.score(x[:200]), [walked(trees, r) for r in x[:200]])
    more, want = noisy(4000, rng)
    assert ((trees.score(more) > 0) == want).mean() > 0.8


def test_constraints_hold_even_against_the_sample():
    rng = np.random.default_rng(2)
    x, y = noisy(3000, rng)
    trees = quality.fit(x, y, np.array([-1, 1, 0]))                # the sample says the opposite of both
    for f, sign in ((0, -1), (1, 1)):
        rows = np.repeat(rng.random((100, 3)), 50, axis=0)
        rows[:, f] = np.tile(np.linspace(-0.1, 1.1, 50), 100)
        assert (sign * np.diff(trees.score(rows).reshape(100, 50), axis=1) >= -1e-12).all()
    free = quality.fit(x, y, np.array([0, 0, 0]))
    rows[:, 1] = np.tile(np.linspace(0, 1, 50), 100)
    assert (np.diff(free.score(rows).reshape(100, 50), axis=1) < 0).any()


def test_one_class_and_no_rows():
    none = quality.fit(np.zeros((0, 2)), np.zeros(0), np.array([0, 0]))
    assert (none.score(np.ones((3, 2))) >= 0).all() and len(none.score(np.ones((0, 2)))) == 0
    assert (quality.fit(np.ones((5, 2)), np.zeros(5), np.array([0, 0])).score(np.ones((3, 2))) < 0).all()


def test_sample_is_bounded_and_held_out_documents_are_told(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.statistics(docs, ["doc_id"])
    counts, good = quality.sample(stats, marks, max_rows=20)
    assert good.sum() <= 20 and (1 - good).sum() <= 20 and len(good) > 20
    learnt = marks.filter("doc_id % 2 = 0")
    seen = quality.rate(docs, learnt).join(marks.select("doc_id", "quality").filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    assert all(r["kept"] for r in seen if r["quality"] == 1) and sum(r["kept"] for r in seen if r["quality"] == 0) <= 1


def test_empty_tables_and_names(spark):
    empty, df = spark.createDataFrame([], DOCS), spark.createDataFrame([(d, t, "x", 1) for d, t in texts()], DOCS)
    none = labels(spark, [])
    assert quality.rate(empty, none).count() == 0 and quality.keep_good(empty, none).count() == 0
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.rate(df, none).collect())
    kept = quality.keep_good(df, none)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.rate(df, none).filter("kept").collect()}
