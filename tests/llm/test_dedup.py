"""Exact and near duplicates against plain versions."""

import hashlib
import random

import brute
import numpy as np
import pytest

from topicvote.llm import exact_dedup, simhash
from topicvote.llm.components import connected

DOCS = "doc_id bigint, text string, digest string, row int"


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "d", 0) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def test_copies_against_brute_force(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab \t\n") for _ in range(draw.randint(0, 4))) for _ in range(300)]
    texts += [None, "", "é" * 5000, "é" * 5000 + " "]
    got = {r["doc_id"]: r for r in exact_dedup.mark_copies(frame(spark, texts)).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(brute.BLANK.sub("", t or ""), []).append(i)
    assert len(got) == len(texts)
    for text, members in groups.items():
        keep = min(members, key=lambda i: (-len(texts[i] or ""), i))
        for i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(members), i == keep)
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_kept_rows_and_both_ways_to_the_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "bounded_broadcast", lambda df, size: df if limit else None)
    df = frame(spark, ["a b", "ab", "ab", "c", "c", None, ""], [5, 3, 4, 7, 7, None, 9])
    got = sorted(exact_dedup.drop_copies(df).collect(), key=str)
    assert [(r["doc_id"], r["text"]) for r in got] == [(5, "a b"), (7, "c"), (9, "")]
    assert exact_dedup.drop_copies(df).columns == df.columns


def test_unique_rows_are_not_candidates(spark):
    df = frame(spark, [f"text {i}" for i in range(2000)] + ["text 1"])
    digests = df.select(exact_dedup.digest(df["text"]).alias("digest"))
    marked = exact_dedup.repeated_filter(digests, 2001)
    flagged = exact_dedup.flag_repeated(digests, marked, 2001).filter("repeated").count()
    assert 2 <= flagged < 100


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.mark_copies(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0


def test_golay_anchors_cover():
    values = np.random.default_rng(2).integers(0, 1 << 23, 5000)
    home = simhash.anchors(values, False)[:, 0]
    assert np.bitwise_count(home ^ values).max() <= 3
    for bit in range(23):
        other = simhash.anchors(values ^ (1 << bit), True)
        assert np.bitwise_count(other ^ (values ^ (1 << bit))[:, None]).max() <= 4
        assert (other == home[:, None]).any(axis=1)[np.bitwise_count(values) % 2 == 0].all()


def test_fingerprints(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["Ab", "c\t", "É", "x y", "\n"]) for _ in range(n)) for n in range(60)]
    texts += [None, "", " \n", "one", "word " * 20000]
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(frame(spark, texts)).collect()}
    assert got == {i: brute.fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [20_000, 40])
def test_links_lose_nothing(spark, most):
    draw = random.Random(4)
    fps = [draw.getrandbits(64) for _ in range(150)]
    for n in range(5):
        fps += [f ^ sum(1 << b for b in draw.sample(range(64), n)) for f in fps[:40]]
    fps += [fps[0] ^ sum(1 << b for b in draw.sample(range(64), 3)) for _ in range(120)]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in set(fps)]
    links = simhash.near_links(spark.createDataFrame(signed, "fp bigint").repartition(3), most=most)
    roots = {r["node"] & (1 << 64) - 1: r["root"] for r in connected(links).collect()}
    expected = brute.components([(f, f) for f in set(fps)])
    same = {}
    for f in set(fps):
        same.setdefault(expected[f], set()).add(roots.get(f, f))
    assert all(len(x) == 1 for x in same.values())
    assert len({next(iter(x)) for x in same.values()}) == len(same)


def test_groups_and_kept_rows(spark):
    draw = random.Random(5)
    base = [" ".join(draw.choice("abcdefgh") * 3 for _ in range(400)) for _ in range(12)]
    texts = base + [b + " end" for b in base[:6]] + [base[0], None, "", "\n"]
    ids = [*range(100, 100 + len(texts) - 1), 3]
    df = frame(spark, texts, ids)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()}
    assert got == brute.components([(i, brute.fingerprint(t)) for i, t in zip(ids, texts, strict=True)])
    kept = sorted(r["doc_id"] for r in simhash.drop_near_copies(df, words=4).collect())
    assert kept == sorted(set(got.values()))


def test_long_paths_are_connected(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)]
    rows = connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len({r["root"] for r in rows if r["node"] < 1000}) == 1
    assert len({r["root"] for r in rows if r["node"] >= 1000}) == 1
    assert len(rows) == 301 + 400


def test_repeated_ids_lose_no_text(spark):
    """Of each group one row stays, whatever the ids are."""
    one, other = (" ".join(f"{w}{k}" for k in range(200)) for w in "vw")
    rows = [(0, one), (1, other), (1, one + " end"), (1, other), (None, one), (None, "alone a b c d"), (7, None), (7, "")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, row int, _row int")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert len(got) == 4
    assert {(0, one), (1, other), (None, "alone a b c d")} <= set(got)
    assert sum(i == 7 for i, _ in got) == 1
    assert simhash.drop_near_copies(docs.limit(0)).collect() == []
