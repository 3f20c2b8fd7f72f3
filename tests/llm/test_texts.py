"""Fingerprints, HTML, language, packing: brute force, round trips, held-out accuracy and odd rows."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tapeline.llm import fingerprints as fp, html_text, language, packing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def table(spark, texts, parts=3):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in texts], DOCS).repartition(parts)


# ------------------------------------------------------------------ fingerprints

def test_sums_do_not_depend_on_order_and_undo():
    a, b = fp.fingerprint("one two.\nthree.\nfour"), fp.fingerprint("four\nthree.\none two.")
    assert a.text() == b.text() and a.likeness(b) == 1.0
    assert fp.Fingerprint.read(a.text()).remove(["four"]).text() == fp.fingerprint("one two.\nthree.").text()
    assert fp.fingerprint("one two.").join(fp.fingerprint("three.\nfour")).text() == a.text()
    assert fp.fingerprint("x\nx").text() != fp.fingerprint("x").text()
    assert fp.fingerprint("").likeness(fp.fingerprint("x")) == 0.0 and fp.fingerprint(None).likeness(fp.fingerprint(" \n")) == 1.0


def test_likeness_follows_shared_paragraphs():
    lines = ["line %d" % i for i in range(400)]
    whole = fp.fingerprint("\n".join(lines))
    for share in (0.25, 0.5, 0.75):
        keep = int(400 * share)
        other = fp.fingerprint("\n".join(lines[:keep] + ["new %d" % i for i in range(400 - keep)]))
        assert abs(whole.likeness(other) - share) < 0.3
    assert whole.likeness(fp.fingerprint("\n".join("else %d" % i for i in range(400)))) < 0.3


def plain_twins(texts):
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        mine = fp.fingerprint(t)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), mine.text(), fp.fingerprint(edited).text(),
                    mine.likeness(fp.fingerprint(edited)), mine.likeness(fp.fingerprint(nxt))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("buckets", [1, 7, None])
def test_twins_match_brute_force(spark, buckets):
    rng = random.Random(4)
    texts = [(rng.randrange(10 ** 6), "".join(rng.choice("ab é\n.\U0001F600") for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    texts += [(5, None), (6, ""), (7, "x. " * 20_000), (8, "same"), (8, "same"), (9, "one"), (9, "two"), (None, "no id")]
    df = table(spark, texts).selectExpr("*", "1 AS bucket", "2 AS borrowed", "3 AS b")
    got = sorted(map(tuple, fp.edited_twins(df, buckets).collect()), key=repr)
    assert got == plain_twins(texts)


def test_twins_of_one_and_no_document(spark):
    assert [tuple(r) for r in fp.edited_twins(table(spark, [(3, "abcd")])).collect()] == plain_twins([(3, "abcd")])
    assert fp.edited_twins(table(spark, [])).count() == 0
    assert [tuple(r) for r in fp.edited_twins(table(spark, [(None, "abcd")])).collect()] == plain_twins([(None, "abcd")])


# ------------------------------------------------------------------ HTML

PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var a = "</p>";</script></head><body>
<div class="cookie-banner">We use cookies</div><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div id="wrap"><div class="sidebar">Side <a href="x">link</a></div>
<div class="post"><h1>Title &amp; more</h1><p>First  <b>bold</b>
 line<br>next.<p>Second &lt;tag&gt; &#233;&eacute; &nbsp; end.<ul><li>item one<li>item two</ul><blockquote>quote</blockquote>
<form>Enter <input> your name</form><!-- gone <p>x</p> --></div>
<div id="comments"><p>A reader's long comment that says much more than the article does.</p></div></div><footer>Foot</footer></body></html>"""


def test_page_gives_its_article():
    assert html_text.main_text(PAGE) == ("Title & more\n\nFirst bold line next.\n\nSecond <tag> éé end.\n\nitem one\n\nitem two\n\nquote")


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<p>broken <b", "broken <b"), ("<article><p>x</article>", "x"),
    ("<article><header><h1>T</h1></header><p>x</p></article><header>no</header>", "T\n\nx"), ("a &amp b &bogus; &#x41;", "a & b &bogus; A"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<nav>only menu</nav>", ""), ("<p title='a > b'>x</p>", "x"), ("<script>x", "")])
def test_odd_pages(html, text):
    assert html_text.main_text(html) == text


def test_menu_of_links_without_names_is_no_article():
    menu = "<div>" + "".join(f"<a href='/{i}'>Section {i}</a>" for i in range(30)) + "</div>"
    body = "<div>" + "".join(f"<p>{'Words of a paragraph that goes on. ' * 6}</p>" for _ in range(4)) + "</div>"
    text = html_text.main_text(f"<html><body>{menu}{body}</body></html>")
    assert text.count("\n\n") == 3 and "Section" not in text


def test_pages_match_a_plain_reading_of_their_articles(spark):
    import html
    import re
    pages = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("*", "1 AS text", "2 AS __x")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in got.collect():
        inner = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    none = spark.createDataFrame([(1, None, None), (1, None, None)], "page_id bigint, url string, html string")
    assert [tuple(r) for r in html_text.extract(none).collect()] == [(1, None, "", 0)] * 2
    assert html_text.extract(none.limit(0)).count() == 0


# ------------------------------------------------------------------ language

def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs.withColumn("score", docs.doc_id)).alias("g")
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    out = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(out) > 250 and sum(out) / len(out) > 0.97


def test_prediction_does_not_see_labels_and_handles_odd_rows(spark):
    train = [(i, t, l) for i, (t, l) in enumerate([("the and of house", "en"), ("der und die haus", "de")] * 20)]
    extra = [(100, None, "en"), (101, "", None), (102, "12 + 3!", "de"), (103, "Der HAUS und und", "en"), (104, "zzz qqq", None), (None, "the of", None)]
    df = spark.createDataFrame(train + extra, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS source", "2 AS held_out", "3 AS size", "4 AS term")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "de" and got[None][0] == "en"
    assert got[104][0] in ("en", "de")
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(got) - {100, 101, 102}
    assert language.identify(df.limit(0)).count() == 0
    unlabelled = df.where("doc_id = 104").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert language.identify(unlabelled).first()["lang_pred"] == "und"


def test_backoff_takes_the_longest_known_grams():
    tables = [{}, {"a": 0}, {"ab": 0}]
    model = language.Model(["x", "y"], tables, [np.zeros((0, 2)), np.array([[5.0, -5.0]]), np.array([[-1.0, 1.0]])], 2)
    assert model.predict("ab", {})[0] == "y"          # 'ab' hides 'a'
    assert model.predict("ac", {})[0] == "x"
    assert model.predict("...", {}) == ("und", 0.0)


def test_a_copied_page_neither_owns_nor_misses_the_sample(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'one page that was copied', concat('row ', id)) AS text", "'xx' AS lang")
    got = language.sampled(rows, 1000)
    assert 800 < got.count() < 1200 and 380 < got.filter("text like 'one page%'").count() < 620


def test_long_runs_of_letters_are_read_to_their_end(spark):
    """One run whose language changes after 64 letters, in training and in prediction."""
    rng = random.Random(4)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))     # noqa: E731
    labelled = spark.createDataFrame([(run("abc", 9) + " " + run("abc", 300), "x") for _ in range(20)]
                                     + [(run("vwz", 9) + " " + run("abc", 64) + run("vwz", 900), "y") for _ in range(20)], "text string, lang string")
    seen = language.counts(labelled.filter("lang = 'y'")).filter("size = 1 AND term = 'w'").first()["n"]
    assert seen > 5000
    model = language.train(labelled)
    assert model.predict(run("abc", 64) + run("vwz", 600), {})[0] == "y"
    assert model.predict(run("abc", 64), {})[0] == "x"


def test_a_model_is_made_without_an_object_per_row_on_the_driver(spark):
    """20 000 words of four languages are 80 000 rows and more, which as rows take over 30 MB of Python."""
    langs, words = ["de", "en", "es", "fr"], [f"{a}{b}{c}{d}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd" for d in "efghijklmnopqrstuvwx"]
    labelled = spark.createDataFrame([(f"{' '.join(words)} {' '.join(words[::i + 1])}", lang) for i, lang in enumerate(langs)], "text string, lang string")
    tracemalloc.start()
    model = language.train(labelled, longest=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 15_000_000
    assert model.langs == langs and list(model.tables[0]) == sorted(words)
    n = np.array([[1.5 + (k % (i + 1) == 0) for i in range(4)] for k in range(len(words))])
    logs = np.log(n / np.array([len(words) + len(words[::i + 1]) + 0.5 * len(words) for i in range(4)]))
    order = [model.tables[0][w] for w in words]
    assert np.allclose(model.weights[0][order], logs - logs.mean(1, keepdims=True))


def test_a_text_travels_to_the_model_once(spark, monkeypatch):
    """What goes to Python to choose the documents is their own size, and they come back as they were."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(
        spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "the \0 häuser 😀\n und", None, None, 3)],
                              "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    sent, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, *a, **k: sent.append(df) or plain(df, *a, **k))
    kept = language.keep_identified(docs)
    monkeypatch.undo()
    own = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert sent[-1].toArrow().nbytes < 1.5 * own
    assert kept.schema == docs.schema
    before = {r["doc_id"]: r for r in docs.collect()}
    after = {r["doc_id"]: r for r in kept.collect()}
    assert {-1, -2}.isdisjoint(after) and -3 in after and len(after) > 0.9 * len(before)
    assert all(before[k] == r for k, r in after.items())


# ------------------------------------------------------------------ packing

def _path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_ids_are_those_of_the_tokenizers_library(spark):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(_path())
    plain.encode_special_tokens = True
    rng, own = random.Random(1), packing.Encoder(_path(), memory=500)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "don't", "I'll", "12", "3", "!!", "é", "日本", "<|endoftext|>", "\xa0", "x.y", "'s", "\x0b", "_", " ", "﻿", "é", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(40).collect()]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_a_worker_does_not_hold_chunks_after_its_task(spark, monkeypatch):
    """The task is run here, as a worker runs it: the encoder stays, what it learnt from texts does not."""
    docs, made = spark.createDataFrame([(1, "some words of a text"), (2, None)], "doc_id bigint, text string"), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, *a, **k: made.append((df, run)) or plain(df, run, *a, **k))
    packing.pieces(docs, _path())
    (sent, run), own = made[0], packing.encoder(_path())
    out = run(iter(sent.toArrow().combine_chunks().to_batches()))
    assert [b.num_rows for b in out] == [2] and packing.encoder(_path()) is own and not own.known
    own.ids("another text")
    assert own.known
    own.known.clear()


def test_plan_uses_all_pieces_and_fills_exactly():
    rng = np.random.default_rng(2)
    for _ in range(60):
        counts = np.zeros(65, np.int64)
        np.add.at(counts, rng.integers(1, 65, 25), rng.integers(1, 50, 25))
        used = np.zeros(65, np.int64)
        for parts, times in packing.plan(counts, 64):
            assert sum(parts) <= 64 and times > 0
            np.add.at(used, parts, times)
        assert (used == counts).all()
    exact = np.zeros(65, np.int64)
    exact[[40, 24, 30, 20, 14, 16]] = 10          # 40+24, 30+20+14, then 16s four at a time
    assert sum(times for _, times in packing.plan(exact, 64)) == 23


def test_packs_whole_documents_round_trip(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    texts = [(r["doc_id"], r["text"]) for r in docs] + [(9000, None), (9001, ""), (9002, "word " * 30_000), (None, "no id"), (9003, "same"), (9003, "same")]
    df = table(spark, texts, 4).selectExpr("*", "1 AS length", "2 AS rank", "3 AS piece")
    rows = packing.pack(df, _path()).collect()
    encoder, by_doc, by_sequence = packing.Encoder(_path()), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, t in texts:
        ids = encoder.encode(t or "") + np.array([2], "<u4").tobytes()
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        if d == 9003:
            assert len(own) == 2 and own[0]["ids_crc32"] == own[1]["ids_crc32"] == zlib.crc32(ids)
            continue
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 1024 for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at and 0 < r["length"] <= 1024
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at:4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    bound = -(-sum(r["length"] for r in rows) // 1024)
    assert len(by_sequence) <= bound * 1.05 + 1
    assert packing.pack(table(spark, []), _path()).count() == 0


def test_numbers_go_through_without_gathering_a_group(spark):
    df = spark.range(1000).selectExpr("id", "id % 2 AS g")
    got = packing.numbered(df, "g", ["id"], 17).collect()
    for g in (0, 1):
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(500))


def test_added_tokens_are_ids_of_their_own(spark):
    from tokenizers import Tokenizer

    theirs, own, mark = Tokenizer.from_file(_path()), packing.Encoder(_path()), "<|endoftext|>"
    for text in (f"a {mark} b", f"{mark}a b", f"a b\n{mark}", mark, mark * 3, f"x{mark}y  {mark} \u2003{mark}\n\nz", f"<|{mark}|>", "<|endoftext |> <|endoftext", "plain", ""):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(own.ids(f"a {mark} b"), "<u4").tolist() == [64, 220, 50256, 275]
    docs = spark.createDataFrame([(1, f"a {mark} b")], "doc_id bigint, text string")
    assert [r["length"] for r in packing.pieces(docs, _path()).collect()] == [5]


@pytest.mark.parametrize("name", ["layout-with-sidebar", "no-sidebar", "has-banner", "entry-content social-share-enabled",
                                  "page-with-comments", "widget-area content", "skip"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_of_wrappers_do_not_lose_the_article(name, tag):
    inside = "".join(f"<p>Paragraph {i} with some words of text, and more.</p>" for i in range(20))
    got = html_text.main_text(f"<body><nav><a href='/'>Home</a></nav><div class='{name}'><{tag}>{inside}</{tag}></div>"
                              "<div class='sidebar'>Side text</div><div id='comments'><article>A reader says.</article></div></body>")
    assert "Paragraph 0" in got and "Paragraph 19" in got and "Home" not in got and "Side" not in got


def test_parts_of_an_article_stay_unless_clutter_is_their_whole_name_or_links():
    got = html_text.main_text("<body><article><p>Long text of the article here.</p><section id='notice-of-results'><p>Result.</p></section>"
                              "<p class='share-price'>Price is 5.</p><div class='ad'>Buy</div><div class='related-posts'><a href='x'>other</a></div></article></body>")
    assert got == "Long text of the article here.\n\nResult.\n\nPrice is 5."


def test_a_page_of_one_form_or_header_gives_its_text():
    assert html_text.main_text("<body><nav>menu</nav><form><p>All text is here.</p></form><script>x</script></body>") == "All text is here."
