"""Runs of words against brute force, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tapeline.llm import periodic

DOCS = "doc_id bigint, text string, start string, __text bigint, n_runs int"


def plain_runs(w, least=12):
    """All maximal stretches of each period, kept where the period is the stretch's smallest."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    return (doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def lists(rng):
    for _ in range(300):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 70)
        yield [rng.randrange(k) for _ in range(n)]
    for _ in range(200):
        w = []
        while len(w) < rng.randint(20, 150):
            root = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
            w += root * rng.randint(1, 6) + root[:rng.randint(0, len(root))] + [rng.randrange(50) for _ in range(rng.randint(0, 4))]
        yield w
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    yield b                                                              # Fibonacci: many runs of all periods
    yield [bin(i).count("1") % 2 for i in range(512)]                    # Thue-Morse


def test_runs_match_brute_force():
    for w in lists(random.Random(1)):
        assert list(zip(*(x.tolist() for x in periodic.runs(np.array(w, np.int64))))) == plain_runs(w), w
        assert list(zip(*(x.tolist() for x in periodic.runs(np.array(w, np.int64), 2)))) == plain_runs(w, 2), w


def test_suffix_array_and_prefixes(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(periodic, "BLOCK", 64)                            # many small blocks
    for w in [[0], [1, 1], [0] * 40, *([rng.randrange(3) for _ in range(rng.randint(2, 60))] for _ in range(50))]:
        s = np.array(w, np.int64)
        sa, isa = periodic.suffix_array(s)
        assert sa.tolist() == sorted(range(len(w)), key=lambda i: w[i:]) and (sa[isa] == np.arange(len(w))).all()
        lcp = periodic.common_prefixes(s, sa, isa).tolist()
        want = [0] + [next((k for k in range(len(w)) if max(a, b) + k >= len(w) or w[a + k] != w[b + k]), 0) for a, b in zip(sa.tolist(), sa.tolist()[1:])]
        assert lcp == want
        assert list(zip(*(x.tolist() for x in periodic.runs(s)))) == plain_runs(w)


def test_texts_laid_end_to_end_do_not_touch():
    rng = random.Random(3)
    texts = [w for w in lists(rng) if len(w) < 200]
    rng.shuffle(texts)
    ids = np.array([x for w in texts for x in w], np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
    first = np.r_[0, np.cumsum([len(w) for w in texts])]
    want = [(int(first[d]) + s, n, q) for d, w in enumerate(texts) for s, n, q in plain_runs(w)]
    assert list(zip(*(x.tolist() for x in periodic.text_runs(ids, doc)))) == sorted(want)


def test_long_runs_are_quick():
    start, length, period = periodic.runs(np.zeros(300_000, np.int64))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [300_000], [1])
    s = np.tile(np.arange(1000), 200)
    assert list(zip(*(x.tolist() for x in periodic.runs(s)))) == [(0, 200_000, 1000)]


def rows():
    rng = random.Random(5)
    word = lambda k: rng.choice("abcdefgh")[:1] + str(rng.randrange(k))      # noqa: E731
    out = []
    for d in range(150):
        root = [word(3) for _ in range(rng.randint(1, 12))]
        parts = [word(40) for _ in range(rng.randint(0, 40))] + root * rng.randint(0, 5) + [word(40) for _ in range(rng.randint(0, 20))]
        out.append((d, rng.choice([" ", "\n", " \t  "]).join(parts)))
    return out + [(1000, None), (1001, ""), (1002, " \n "), (1003, "x " * 5000), (None, "y z " * 9), (7, "b b " * 30), (7, "b b " * 30),
                  (1004, "é　 " * 14), *((2000 + i, "one two three four " * i) for i in range(12))]


@pytest.mark.parametrize("parts", [1, 4])
def test_query_columns_match_brute_force(spark, parts):
    from tapeline.llm.queries import collapsed_rows
    df = spark.createDataFrame([(d, t, "s", 1, 2) for d, t in rows()], DOCS).repartition(parts)
    got = sorted(map(tuple, collapsed_rows(df).collect()), key=repr)
    assert got == sorted((plain_row(d, t) for d, t in rows()), key=repr)


def test_collapsed_text_and_names(spark):
    df = spark.createDataFrame([(1, "p " + "a b " * 6 + "q")], "id int, text string").withColumnRenamed("id", "__seed")
    got = periodic.collapse(df, ["__seed"]).first()
    assert bytes(got["collapsed"]) == b"p a b q" and (got["start"], got["length"], got["period"]) == (1, 12, 2)
    assert periodic.collapse(df.limit(0), ["__seed"]).count() == 0
    with pytest.raises(ValueError):
        periodic.collapse(df.withColumnRenamed("__seed", "period"), ["period"])
