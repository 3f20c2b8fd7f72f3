"""Mixing, URL rules, neighbours, licenses and the pipeline against brute force, with odd rows."""

import collections
import math
import pathlib
import random
import re
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import licenses, mixing, neighbours, urls

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ mixing

def plain_targets(sizes, weights=(3, 1, 2), total=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    want, full = total * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = want - sum(full.values())
        over = [s for s in free if left * weigh[s] / sum(weigh[f] for f in free) > most * sizes[s]]
        if not over:
            return {**full, **{s: left * weigh[s] / sum(weigh[f] for f in free) for s in free}}
        full |= {s: most * sizes[s] for s in over}


def _key(doc_id, q=1.0):
    u = (int(md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:13], 16) + .5) / 2 ** 52
    return -math.log(u) / q


def mixture(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "B", "é", None, "z"]), rng.randint(0, 50), rng.choice([None, .5, 2.0, 0.0])) for i in range(400)]
    rows += [(None, "a", 7, 1.0), (401, "only", None, 1.0), (402, "big", 4000, 1.0), (5, "a", 3, 1.0), (5, "a", 3, 1.0)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, q double").selectExpr("*", "1 AS weight", "2 AS taken", "3 AS target")


@pytest.mark.parametrize("share", [20_000, 7])
def test_mix_matches_brute_force(spark, share):
    rows, df = mixture(spark)
    got = mixing.mix(df, quality="q", share=share).collect()
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["weight"] == 1
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        own = sorted((r for r in got if r["source"] == s), key=lambda r: (_key(r["doc_id"], r["q"] if r["q"] and r["q"] > 0 else 1.0), r["doc_id"] or -1))
        assert sum(r["taken"] for r in own) == round(want[s])
        extra = [r["taken"] - min(2, int(want[s] // sizes[s])) * r["size"] for r in own] if sizes[s] else []
        cut = [i for i, (e, r) in enumerate(zip(extra, own)) if e < r["size"]]
        assert not cut or all(e == 0 for e in extra[cut[0] + 1:])


def test_whole_documents_and_reruns(spark):
    _, df = mixture(spark)
    got = mixing.mix(df, quality="q", whole=True, share=11)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(map(tuple, mixing.mix(df.repartition(7), quality="q", whole=True, share=11).collect()), key=repr)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got.collect())
    assert mixing.mix(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, "a", 0), (2, None, None)], "doc_id bigint, source string, size bigint")
    assert [r["taken"] for r in mixing.mix(empty).collect()] == [0, 0]


def test_no_source_is_gathered(spark):
    """Windows over documents are by source and range of keys."""
    df = spark.range(2000).selectExpr("id AS doc_id", "'one' AS source", "3L AS size")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = mixing.mix(df, share=50)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    windows = [x for x in plan.splitlines() if "Window " in x and "size" in x]
    assert windows and all("__part" in w for w in windows)
    assert mixing.mix(df, share=50).agg(F.sum("taken")).first()[0] == 9000


# ------------------------------------------------------------------ URLs

def plain_verdict(url):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = path = ""
    if rest is not None:
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_match_brute_force(spark):
    odd = [None, "", "no scheme/net", "http://", "http://NET/", "https://a.b.net", "http://x.example.net/en/", "http://x.example.net/en",
           "ftp://Example.COM/de/a?b#c", "http://notexample.com/de/", "http://é.org/fr/É", "http://a.net?x=/en/", "http://a.net#://b.org/fr/",
           "x://y://a.net/", "http://example.net./en/", "http://.net/", "http://a..net/", "http://net:80/", "\nhttp://a.net/\nb", "http://a.net/" + "x" * 5000,
           "http://" + "a." * 300 + "org/fr/"]
    rows = [(i, u) for i, u in enumerate(odd)] + [(1, ""), (None, "http://net/")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'h' AS host", "'p' AS path", "'r' AS rule", "1 AS verdict")
    got = urls.judge(df, urls.rules_table(spark))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(i, *plain_verdict(u)) for i, u in rows], key=repr)
    assert urls.judge(df.limit(0), urls.rules_table(spark)).count() == 0
    none = urls.judge(df, urls.rules_table(spark).limit(0)).collect()
    assert len(none) == len(rows) and {r["verdict"] for r in none} == {"allow"}


def test_short_prefixes_are_confirmed_by_the_digest(spark, monkeypatch):
    monkeypatch.setattr(urls, "SHORT", 1)
    df = spark.createDataFrame([(i, f"http://h{i}.example.org/p{i}") for i in range(300)], "page_id bigint, url string")
    assert urls.judge(df, urls.rules_table(spark)).filter("rule IS NOT NULL").count() == 0


# ------------------------------------------------------------------ neighbours

def vectors(spark, n=1500, dim=16):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, dim))
    rows = [(i, [float(v) for v in np.float32(centres[i % 12] + .3 * rng.standard_normal(dim))]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(30)] + [(9000, None), (9001, []), (9002, [0.0] * dim), (9003, [None] + [1.0] * (dim - 1)),
                                                       (9004, [float("nan")] * dim), (9005, [float("inf")] * dim), (None, rows[1][1]), (9006, [1.0, 2.0]), (0, rows[0][1])]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS key", "2 AS vector", "3 AS block")


def test_neighbours_are_found(spark):
    rows, df = vectors(spark)
    usable = neighbours.usable(df)
    assert usable.count() == 1500 + 30 + 2
    known = {k: np.array(v, np.float32).astype(float) for k, v in rows if k is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    for block in (8192, 200):
        got = neighbours.nearest(usable, usable.filter("key % 20 = 0"), block=block, batch=50).collect()
        by = {}
        for r in got:
            by.setdefault(r["query_id"], []).append(r)
        hits = total = 0
        for q in [k for k in known if k % 20 == 0]:
            own = sorted(by[q], key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(1, 11))
            assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
            exact = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(known[q], v))), k) for k, v in known.items() if k != q)[:10]
            assert all(r["score"] == pytest.approx(math.dist(known[q], known[r["vec_id"]]), rel=1e-12, abs=1e-15) for r in own)
            hits += len({k for _, k in exact} & {r["vec_id"] for r in own})
            total += 10
        assert hits / total > 0.98


def test_few_and_no_candidates(spark):
    df = neighbours.usable(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 0.0])], "vec_id bigint, embedding array<double>"))
    got = neighbours.nearest(df, df.filter("key = 0")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2, 0.0), (2, 1, 1.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    assert neighbours.nearest(df.filter("key = 0"), df.filter("key = 0")).count() == 0


# ------------------------------------------------------------------ licenses

def test_licenses_and_their_inheritance(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/file.py", "code\nno header"), ("a/b/c/own.py", "x\n  licensed under the Apache License, version 2.0\ny"),
             ("a/b/COPYING.txt", "All rights reserved."), ("d/file.py", "licensed words under work this that of many other things and so on"), ("e", None),
             ("top.py", ""), ("a/b/c/deep.py", "the license"), (None, "Released under the MIT License."), ("a/LICENSE", "Released under the MIT License."),
             ("long.py", "word " * 20_000 + "\nLicensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(files, "path string, text string").selectExpr("*", "1 AS license", "2 AS score", "3 AS term", "4 AS dir")
    got = {r["path"]: (r["license"], r["origin"]) for r in licenses.scan(df, licenses.templates_table(spark)).collect()}
    assert got == {"a/LICENSE": ("MIT", "a/LICENSE"), "a/b/file.py": ("proprietary", "a/b/COPYING.txt"), "a/b/c/own.py": ("Apache-2.0", "a/b/c/own.py"),
                   "a/b/COPYING.txt": ("proprietary", "a/b/COPYING.txt"), "d/file.py": (None, None), "e": (None, None), "top.py": (None, None),
                   "a/b/c/deep.py": ("proprietary", "a/b/COPYING.txt"), "long.py": ("CC-BY-NC-4.0", "long.py")}
    assert licenses.scan(df.limit(0), licenses.templates_table(spark)).count() == 0
    assert {r["license"] for r in licenses.scan(df, licenses.templates_table(spark).limit(0)).collect()} == {None}


def cut(text):
    return [w for w in re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", text.lower()) if w not in licenses.FREQUENT]


NOTICES = [*licenses.HEADERS, *licenses.GENERAL, *licenses.TEXTS]
DF = collections.Counter(t for _, n in NOTICES for t in set(cut(n)))


def vector(text):
    v = {t: c * (math.log((len(NOTICES) + 1) / (DF[t] + 1)) + 1) for t, c in collections.Counter(cut(text)).items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / size for t, x in v.items()}


VECTORS = [(license, vector(n), (license, n) in licenses.GENERAL) for license, n in NOTICES]


def plain_best(passages):
    """(general, -score, license) of the best pair of a passage and a template, over all of them."""
    best = (True, 0.0, None)
    for own in map(vector, passages):
        for license, theirs, general in VECTORS:
            score = round(sum(x * theirs.get(t, 0) for t, x in own.items()), 9)
            if score >= licenses.LEAST:
                best = min(best, (general, -score, license)) if best[2] else (general, -score, license)
    return best


def plain_passages(text):
    """All lines, sentences and runs of up to four lines, whatever words they hold, and paragraphs."""
    strip = lambda x: re.sub(r"^[\s/*#;%<>!\"'-]+|[\s/*#<>!\"'-]+$", "", x)        # noqa: E731
    lines = [strip(x) for x in re.split("\r\n|\r|\n", text) if x.strip()]
    out = {" ".join(lines[i:i + k]) for k in range(1, 5) for i in range(len(lines) - k + 1)}
    out |= {x for line in lines for x in re.split(r"(?<=[.;:!?])\s+", line)}
    return out | set(re.split(r"(?:\r?\n[\s/*#;%-]*){2,}|\n[/*#;%-]+(?=\n)", text))


def test_cosine_matches_brute_force(spark):
    """Every passage of every text against every template, without a choice of words before."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("CAST(doc_id AS STRING) AS path", "text")
    got = {r["path"]: (r["license"], r["score"]) for r in licenses.headers(docs, licenses.templates_table(spark)).collect()}
    want = {}
    for r in docs.collect():
        _, minus, license = plain_best(plain_passages(r["text"] or ""))
        if license:
            want[r["path"]] = (license, pytest.approx(-minus, abs=1e-8))
    assert got == want and len(want) > 3


WRAPPED = """#!/usr/bin/env python
# Copyright 2024 The Authors.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
import os"""
GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * It does something useful.
 */
int main() {}"""


def test_wrapped_embedded_and_whole_file_licenses(spark):
    import public_tokenizers
    known = pathlib.Path(public_tokenizers.path("byte_bpe_50k.json")).with_name("LICENSES.txt").read_text()
    start = known.index("Permission is hereby granted")
    mit = "Copyright (c) 2022 Somebody\n\n" + known[start:known.index("SOFTWARE.", start) + 9] + "\n"
    bsd = "Copyright (c) 2020, Someone. All rights reserved.\n\n" + dict(licenses.TEXTS)["BSD-3-Clause"].replace(" and ", "\nand ")
    files = {"w/wrapped.py": (WRAPPED, "Apache-2.0"), "w/gpl.c": (GPL, "GPL-3.0"), "w/spdx.py": ("# SPDX-License-Identifier: MIT\nx = 1", "MIT"),
             "w/spdx2.py": ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
             "w/embedded.md": ("Copyright 2024 The Authors. Licensed under the Apache License, Version 2.0. See LICENSE for details.", "Apache-2.0"),
             "w/acme.py": ("// Copyright (c) 2024 Acme Corp. All rights reserved.", "proprietary"),
             "m/LICENSE": (mit, "MIT"), "b/COPYING.txt": (bsd, "BSD-3-Clause"),
             "g/COPYING": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy", "GPL-3.0"),
             "p/prose.txt": ("He had the license to drive. The software was released in June,\nand the public was free to use it.\n\nNo rights were given.", None),
             "crlf/a.py": ("# Licensed under the\r\n# Apache License,\r\n# Version 2.0.\r\nimport x", "Apache-2.0")}
    df = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string")
    got = {r["path"]: r["license"] for r in licenses.headers(df, licenses.templates_table(spark)).collect()}
    assert got == {p: l for p, (_, l) in files.items() if l}


# ------------------------------------------------------------------ the pipeline

def test_pipeline_is_its_stages(spark, tmp_path):
    import corpus_pipeline
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(7001, "123 !!", "en", "src1", 6), (7002, None, None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            assert docs.filter("doc_id IN (7001, 7002)").count() == 0 and counts[1] == counts[0] - 2
        if name == "near_dedup":
            assert docs.select("text").distinct().count() == docs.count() < counts[1]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "substring_dedup")).collect()}
    mixed = spark.read.parquet(str(tmp_path / "mixing")).collect()
    assert all(texts[r["doc_id"]] == r["text"] for r in mixed)
    pieces = sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in docs.collect())
    ran = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in ran) == pieces
