"""SimHash classes and repeated passages against brute force, with odd rows."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tapeline.llm import repeats, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts, parts=3):
    """Rows from (doc_id, text) pairs."""
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in texts], DOCS).repartition(parts)


def plain_simhash(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps):
    ids = sorted(fps, key=lambda i: (i is None, i))
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(ids, 2):
            if bin(fps[a] ^ fps[b]).count("1") <= 4 and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


def test_every_four_bytes_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in combinations(range(8), 4))


def some_texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(0, 90))) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 90):
        words = rng.choice(base).split(" ")
        words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words)))
    return out + [(90, None), (91, ""), (92, "One Two"), (93, "one\ttwo"), (94, "x " * 9000), (95, " \n ")]


@pytest.mark.parametrize("block", [4096, 2])
def test_classes_match_brute_force(spark, block):
    texts = some_texts()
    fps = {i: plain_simhash(t) for i, t in texts}
    want = plain_classes(fps)
    got = simhash.classes(simhash.fingerprints(table(spark, texts)), block=block).collect()
    assert {r["doc_id"]: int(r["fp"].hex(), 16) for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert fps[92] == fps[93] and fps[90] == fps[91] == fps[95] == 0


def test_dense_lists_keep_chains_together(spark):
    """Fingerprints one bit apart in a row: one class, by blocks of three and by one list."""
    chain = [(i, ((1 << i) - 1).to_bytes(8, "big")) for i in range(0, 40)]
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in chain], "doc_id bigint, fp binary")
    for block in (3, 4096):
        assert {r["component_id"] for r in simhash.classes(df, block=block).collect()} == {0}


def test_wide_words_need_the_total_too(spark):
    near, far = bytes(16), bytes(8) + b"\xff" * 8
    df = spark.createDataFrame([(1, bytearray(near)), (2, bytearray(far)), (3, bytearray(bytes(15) + b"\x07"))], "doc_id bigint, fp binary")
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(df, width=2, total=8).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_no_rows_repeated_rows_and_null_ids(spark):
    empty = table(spark, [])
    assert simhash.classes(simhash.fingerprints(empty)).count() == 0
    got = simhash.classes(simhash.fingerprints(table(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d")]))).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in got) == [(False, 5), (False, 5), (True, 5)]


def test_keep_one_keeps_clean_documents(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(900)]
    clean = [(i, " ".join(rng.choice(words) for _ in range(150))) for i in range(20)]
    near = [(100 + i, t + " more") for i, t in clean[:10]] + [(200, clean[3][1]), (201, clean[3][1].replace(" ", "\n", 1))]
    odd = [(300, None), (301, ""), (302, "hi")]
    df = table(spark, clean + near + odd + [odd[2]]).withColumnsRenamed({}).selectExpr("*", "1 AS node", "2 AS root", "3 AS fp")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(20), 300, 302]
    assert simhash.keep_one(table(spark, [])).count() == 0


def test_keep_one_checks_the_texts(spark):
    """Near by fingerprint, but with shingles under 0.8 alike: both stay."""
    words = ["w%d" % i for i in range(60)]
    other = words[30:] + words[:30]
    mixed = [w for pair in zip(words[::2], words[1::2]) for w in reversed(pair)]
    got = simhash.keep_one(table(spark, [(1, " ".join(words)), (2, " ".join(mixed)), (3, " ".join(words + ["end"])), (4, " ".join(mixed + ["end"])), (5, " ".join(other))]))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2]       # 5 shares 52 of 60 shingles with 1


def plain_repeats(texts, w=20):
    seen, out = {}, {}
    for d, t in sorted(texts, key=lambda x: (x[0] is None, x[0])):
        words = (t or "").encode().split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - w + 1):
            window = tuple(words[i:i + w])
            if window in seen:
                gone[i:i + w] = True
            seen.setdefault(window, True)
        out[d] = (len(words), int(gone.sum()), b" ".join(x for x, g in zip(words, gone) if not g))
    return out


def repeated_texts():
    rng = random.Random(11)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randint(15, 60))] for _ in range(6)]
    texts = []
    for d in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < .5:
                words += rng.choice(pool)
            elif kind < .6:
                words += [rng.choice("ab")] * rng.randint(1, 45)
            elif kind < .7:
                words += ["a", "b"] * rng.randint(1, 25)
            else:
                words += ["x%d" % rng.randrange(30) for _ in range(rng.randint(1, 30))]
        texts.append((d, rng.choice([" ", "\n", "\t ", "  "]).join(words)))
    return texts + [(500, None), (501, ""), (None, texts[5][1] + " z"), (502, "q " * 3000)]


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_repeats_match_brute_force(spark, crowd):
    texts = repeated_texts()
    want = plain_repeats(texts)
    got = repeats.without_repeats(table(spark, texts, 5), crowd=crowd).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got} == want
    assert sum(n for _, n, _ in want.values()) > 2000


def test_repeats_of_other_windows(spark):
    texts = repeated_texts()[:40]
    for window in (5, 30):
        got = repeats.without_repeats(table(spark, texts), window=window).collect()
        assert {r["doc_id"]: r["n_removed"] for r in got} == {d: v[1] for d, v in plain_repeats(texts, window).items()}


def test_repeated_rows_are_one_document(spark):
    text = " ".join("w%d" % i for i in range(50))
    got = repeats.without_repeats(table(spark, [(1, text), (1, text), (2, text + " end")])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 50)]
    assert repeats.without_repeats(table(spark, [])).count() == 0


def test_drop_repeats_keeps_white_space_and_columns(spark):
    run = " ".join("w%d" % i for i in range(25))
    df = table(spark, [(1, "a\n" + run), (2, "Start here.\n\n" + run + "\n\tEnd  now"), (3, None)]).selectExpr("*", "7 AS start", "8 AS mask", "9 AS key")
    got = {r["doc_id"]: r for r in repeats.drop_repeats(df).collect()}
    assert repeats.drop_repeats(df).columns == df.columns
    assert got[2]["text"] == "Start here.\n\nEnd  now" and got[2]["n_chars"] == len(got[2]["text"])
    assert got[1]["text"] == "a\n" + run and got[3]["text"] is None and got[2]["mask"] == 8


def test_large_components_take_several_rounds(spark, monkeypatch):
    """Few heads per round and few others per task give what one round gives."""
    rng = random.Random(5)
    base = ["w%d" % i for i in range(200)]
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(200)] = "x%d" % rng.randrange(10 ** 6)
        texts.append((i, " ".join(words)))
    want = sorted(r["doc_id"] for r in simhash.keep_one(table(spark, texts)).collect())
    monkeypatch.setattr(simhash, "HEADS", 3)
    monkeypatch.setattr(simhash, "OTHERS", 7)
    assert sorted(r["doc_id"] for r in simhash.keep_one(table(spark, texts)).collect()) == want
    assert 1 <= len(want) < 20 and want[0] == 0


def test_keep_one_finds_added_and_cut_passages(spark):
    """Texts that lost or gained one passage, or words here and there, at 0.80 to 0.95 alike: all go."""
    rng = random.Random(17)
    pool = ["v%d" % i for i in range(5000)]
    texts, gone = [], set()
    for g in range(60):
        base = [rng.choice(pool) for _ in range(304)]                  # 300 shingles
        cut = rng.choice([16, 30, 45, 59])                             # 284 to 241 of 300 left: 0.80 and more
        extra = [rng.choice(pool) for _ in range(cut)]
        replaced = list(base)
        for i in rng.sample(range(30), 5):                             # each takes at most 5 shingles of 300
            replaced[10 * i] = "r%d" % rng.randrange(10 ** 6)
        variants = [base[:-cut], base + extra, base[:150] + extra + base[150:], replaced]
        texts.append((10 * g, " ".join(base)))
        texts += [(10 * g + 1 + k, " ".join(v)) for k, v in enumerate(variants)]
    got = {r["doc_id"] for r in simhash.keep_one(table(spark, texts)).collect()}
    assert got == {10 * g for g in range(60)}


def test_settled_against_all_kept(monkeypatch):
    """Whether a set is alike to a kept one is counted exactly, in the index and beside it."""
    rng = np.random.default_rng(2)
    kept, sets = simhash._Kept(), []
    for i in range(70):
        own = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        want = any(len(np.intersect1d(own, s)) >= .55 * len(np.union1d(own, s)) for s in sets)
        assert kept.alike(own, .55) == want
        kept.add(own)
        sets.append(own)


@pytest.mark.parametrize("crowd", [10 ** 9, 20_000])
def test_windows_of_one_anchor_are_told_apart(crowd):
    """A frequent phrase with other words around it each time: nothing is repeated."""
    phrase, n, rows = " ".join("p%d" % i for i in range(18)), 450_000, []
    texts = ["a%d %s b%d" % (i, phrase, i) for i in range(n)]
    for at in range(0, n, 50_000):
        part = texts[at:at + 50_000]
        rows += repeats._find(20)(iter([pa.RecordBatch.from_arrays([pa.array(range(at, at + len(part)), pa.int64()), pa.array([t.encode() for t in part])], ["doc_id", "text"])]))
    found = pa.Table.from_batches(rows).sort_by("key").combine_chunks()
    assert np.unique(found["key"].to_numpy(), return_counts=True)[1].max() > 100_000
    met = list(repeats._meet(crowd)(iter(found.to_batches())))
    if crowd < n:
        met = pa.Table.from_batches(met)
        order = [(c, "ascending") for c in ("name", "key", "doc_id", "uid", "start") if c in met.column_names]
        met = list(repeats._second(iter(met.sort_by(order).combine_chunks().to_batches())))
    assert sum(b.num_rows for b in met) == 0


@pytest.mark.parametrize("most", [64, 1 << 27])
def test_map_of_keys_misses_none(spark, most):
    rows = spark.range(5000).selectExpr("id", "cast(id % 7 as int) uid")
    keys = rows.filter("id % 100 = 3")
    table = repeats.key_map(keys, most)
    names = rows.selectExpr("id", "xxhash64(id, uid) name").toPandas()
    told = repeats.may_have(table, names["name"].to_numpy())
    assert told[names["id"] % 100 == 3].all() and (told.sum() < 1200) == (most > 64)
    assert not repeats.may_have(repeats.key_map(keys.limit(0), most), names["name"].to_numpy()).any()


def test_repeats_go_whatever_the_columns_are_called(spark):
    phrase = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, phrase + " end", 1, "a", 2, 3), (2, "start " + phrase, 4, None, 5, 6), (None, None, 7, "c", 8, 9)],
                               "doc_id bigint, text string, __starts int, __uid string, row int, id int")
    got = {r["doc_id"]: tuple(r) for r in repeats.drop_repeats(df).collect()}
    assert got == {1: (1, phrase + " end", 1, "a", 2, 3), 2: (2, "start ", 4, None, 5, 6), None: (None, None, 7, "c", 8, 9)}
    assert repeats.drop_repeats(df.limit(0)).columns == df.columns


def test_the_stage_links_near_copies_by_their_fingerprints(spark, monkeypatch):
    draw = random.Random(11)
    texts, copies = [], 0
    for i in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(900)]
        near = list(words)
        near[450] = "another"
        texts += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(near)), (10 * i + 2, "  ".join(words).upper())]
        bits = [int.from_bytes(simhash.simhash(" ".join(w).encode(), 4, (42,), False), "big") for w in (words, near)]
        copies += (bits[0] ^ bits[1]).bit_count() <= 4
    assert copies == 12
    monkeypatch.setattr(simhash, "band_links", lambda signed: spark.createDataFrame([], "src bigint, dst bigint"))
    assert sorted(r["doc_id"] for r in simhash.keep_one(table(spark, texts)).collect()) == [10 * i for i in range(12)]


def test_a_task_of_repeats_holds_little_and_lets_words_go():
    """2.9 MB of words, one piece of a batch: the arrays of its rounds are let go, and so are the words when the task ends."""
    import tracemalloc
    rng, words = random.Random(8), [f"{a}{b}{c}{d}" for a in "abcde" for b in "fghij" for c in "klmno" for d in "pqrst"]
    texts = [" ".join(rng.choice(words) for _ in range(500)).encode() for _ in range(1160)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in repeats._find(20)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 50_000 and not repeats.WORDS and most < 200 * 500 * len(texts)
