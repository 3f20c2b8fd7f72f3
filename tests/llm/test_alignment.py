"""Aligned tokens against the libraries and a plain walk over bytes, and odd rows."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tapeline.llm import alignment
from tapeline.llm.packing import SHOWN

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, uid int, rest string, n int"


@pytest.fixture(scope="module")
def plain():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    hidden = [b for b in range(256) if b not in SHOWN]
    byte = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def piece(i):
        return bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, spell):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(spell(i))))
            at = out[-1][2]
        return out, b"".join(map(spell, ids))

    def tokens(text):
        if not text:
            return [], []
        a, raw_a = spans(tok.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(byte[c] for c in tok.id_to_token(i)))
        b, raw_b = spans(pieces.encode(text), piece)
        return (a, b) if raw_a == raw_b == (" " + text).encode() else ([], [])

    def rows(table):
        parts, total = [], Counter()
        for _, text in table:
            a, b = tokens(text)
            links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 400 else swept(a, b)
            total.update(links)
            ends = sorted({x[2] for x in a} & {y[2] for y in b})
            groups, low = [], 0
            for e in ends:
                groups.append(",".join(str(x[0]) for x in a if low < x[2] <= e) + "|" + ",".join(str(y[0]) for y in b if low < y[2] <= e))
                low = e
            parts.append((a, b, links, groups))
        best = Counter()
        for (_, y), n in total.items():
            best[y] = max(best[y], n)
        return [(d, len(a), len(b), len(g), len(links), sum(total[p] == best[p[1]] for p in links), sum(total[p] for p in links),
                 hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for (d, _), (a, b, links, g) in zip(table, parts)], total

    def swept(a, b):
        i = j = 0
        out = []
        while i < len(a) and j < len(b):
            out.append((a[i][0], b[j][0]))
            e, f = a[i][2], b[j][2]
            i, j = i + (e <= f), j + (f <= e)
        return out

    return rows


def texts():
    rng = random.Random(3)
    words = ["the", "alignment", "Tokens", "naïve", "don't", "x=1;", "100000", "日本語", "😀", "aaaa", "\x1c", "\xa0", "　", "\r", "\x0b", "<s>",
             "<0x41>", "<|endoftext|>", "é", "ﬁ", "\0", "﻿", ")\r", "internationalization", "the", "the"]
    out = [(d, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "", "\n", "  ", "\t", "\r\n"]) for _ in range(rng.randint(0, 40)))) for d in range(120)]
    out += [(500, None), (501, ""), (502, " "), (503, "  \n "), (504, "a ▁ b"), (505, "▁"), (None, "no id"), (7, "same row"), (7, "same row"),
            (506, "word " * 3000), (507, "x" * 3000), (508, "\n"), (509, "\t\ta"), (510, "tail  ")]
    return out


@pytest.mark.parametrize("top, parts", [(alignment.TOP, 3), (40, 3), (0, 30)])
def test_rows_match_plain_walk(spark, plain, top, parts):
    df = spark.createDataFrame([(d, t, 1, "r", 2) for d, t in texts()], DOCS).repartition(parts)
    want, total = plain(texts())
    got = alignment.align(df, A, B, ["doc_id", "rest"], top, spell=True)
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(want, key=repr)
    assert all((hashlib.sha256(bytes(r["groups"])).hexdigest() if r["groups"] else "") == r["groups_sha256"] for r in got.collect())
    if top == alignment.TOP:
        assert {(r["a"], r["b"]): r["n"] for r in alignment.pair_table(df, A, B).collect()} == dict(total)


def test_chunks_are_spelled_as_whole_texts(plain):
    """Many random texts, a memory of few chunks, many batches: sizes and groups as in one go."""
    rng = random.Random(9)
    chars = "ab \n\t\r\xa0　é日😀.,'\x1c\x85▁0"
    table = [(i, "".join(rng.choice(chars) for _ in range(rng.randint(0, 30)))) for i in range(3000)]
    want, _ = plain(table)
    own = alignment.Aligner(A, B, memory=50)
    for k in range(0, len(table), 100):
        cuts = [t for _, t in table[k:k + 100]]
        number, bounds = own.index(cuts)
        for i in range(len(cuts)):
            mine = number[bounds[i]:bounds[i + 1]]
            spelled = b";".join(own.spelled[j] for j in mine)
            assert (*own.sizes[mine].sum(0).tolist(), hashlib.sha256(spelled).hexdigest() if len(mine) else "") == (
                *want[k + i][1:5], want[k + i][7]), table[k + i]


def test_no_rows_and_names(spark):
    df = spark.createDataFrame([], DOCS)
    assert alignment.align(df, A, B, ["doc_id", "uid"]).count() == 0 and alignment.pair_table(df, A, B).count() == 0
    with pytest.raises(ValueError):
        alignment.align(df, A, B, ["n_best"])
