"""Quotient filters and phrase mining against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from topicvote.llm import collocations
from topicvote.llm.quotient_filter import Layout, decode, encode, merged, summed

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string, lang string"


def mined(rows, least, top, longest=5):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inner = {
            p[i : i + s] for p, a in often.items() for s in range(2, len(p)) for i in range(len(p) - s + 1)
            if a >= often[p[i : i + s]]
        }
        found = []
        for p, a in often.items():
            if p in inner:
                continue
            cuts = [(counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            (score, k) = min((1000 * a * n[lang] // (x * y), k) for k, (x, y) in enumerate(cuts))
            found.append((" ".join(p), a, *cuts[k], n[lang], score))
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(found[:top])]
    return sorted(out)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "on", "a", "mat", "été", "数", "x" * 40]
    rows = []
    for i in range(n):
        w = [rng.choice(words) + rng.choice(["", "", "", ".", ",\n", "!?", "\t", "\x0b"]) for _ in range(rng.randrange(60))]
        rows.append((i, rng.choice([" ", "  ", "\t "]).join(w), rng.choice(["en", "fr", None])))
    return rows


@pytest.mark.parametrize("words, bits", [(1, 1), (2, 3), (2, 16), (3, 21), (4, 25), (5, 12), (5, 13), (5, 25)])
def test_filters_lose_nothing(words, bits):
    layout, rng = Layout(words, bits), np.random.default_rng(words * bits)
    parts, seen = [], Counter()
    for n in (0, 1, 700, 900):
        rows = rng.integers(0, min(1 << bits, 7), (n, words))
        rows[: n // 2] += (1 << bits) - rows.max(initial=0) - 1
        seen.update(map(tuple, rows.tolist()))
        entries = summed(layout.half, *layout.pack(list(rows.T)))
        parts.append(decode(layout.half, encode(layout.half, entries)))
    large = Layout(words, bits).pack([np.zeros(1, np.int64)] * words)
    seen[(0,) * words] += 10**12
    parts.append(decode(layout.half, encode(layout.half, (*large, np.array([10**12])))))
    left, right, counts = merged(layout.half, parts)
    assert dict(zip(map(tuple, layout.unpack(left, right).tolist()), counts.tolist(), strict=True)) == seen
    order = list(zip(left.tolist(), right.tolist(), strict=True))
    assert order == sorted(set(order))


@pytest.mark.parametrize("table_bytes", [32 << 20, 0])
def test_phrases(spark, monkeypatch, table_bytes):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 64)
    rows = texts(120)
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=4, top=50, table_bytes=table_bytes)
    assert sorted(map(tuple, got.collect())) == mined(rows, 4, 50)


def test_common_case_and_odd_rows(spark):
    """Nulls, empty and repeated rows, clashing names, a column with a dot, ties in the score."""
    rows = [(1, None, "en"), (None, "", None), (2, "a b a b a b", "en"), (2, "a b a b a b", "en"),
            (3, "c d. c d. e f; e f", None), (4, ". , !", "fr"), (5, "\x1c \x85 \x1c \x85", "fr")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", n int, word int, `a.b` int")
    got = sorted(map(tuple, collocations.collocations(docs, least=2).collect()))
    assert got == mined(rows, 2, 2000)
    assert any(r[2] == "\x1c \x85" for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(docs, table_bytes=-1).collect() == []


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 50)
    text = " ".join(["one two three", "y" * 170, "four. five"] * 40)
    assert [w for part in collocations.tokens(text.encode()) for w in part] == (
        text.replace(".", " .").encode().split()
    )


def test_products_beyond_64_bits(spark):
    """Scores of counts as large as a very large corpus has."""
    phrases = spark.createDataFrame([(2, [1, 2], 10**13), (2, [2, 1], 10**13 - 7)], "k int, ids array<int>, a bigint")
    single = spark.createDataFrame(
        [(1, "en", 3 * 10**13, 10**16 + 3), (2, "en", 10**13 + 1, 10**16 + 3)], "id int, lang string, a bigint, n bigint"
    )
    got = {r["key"]: r["score"] for r in collocations.scored(phrases, single).collect()}
    n, product = 10**16 + 3, 3 * 10**13 * (10**13 + 1)
    assert got == {"1 2": 1000 * 10**13 * n // product, "2 1": 1000 * (10**13 - 7) * n // product}
