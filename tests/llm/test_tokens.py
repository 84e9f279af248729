"""Encoding, decoding and packing against the tokenizer library and plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topicvote.llm import bpe, packing

PATH = public_tokenizers.path(bpe.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id bigint, text string, length int, ids string, at int"
FIXED = [
    None, "", " ", "\n", " a", "a ", "a\n\nb", "a  b", "it's don 't", "<|endoftext|>", "x<|endoftext|> y",
    "a" * 3000, "\0a b", "a\tb c", "é ü ñ", "日本語 テスト 🎉🎉", "\U00019088蕄", "word " * 5000,
]


def texts():
    draw = random.Random(6)
    letters = "abcdefgh  \n\t'.,!?0123éüßñ日🎉<|>ABCstrei"
    return FIXED + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 80))) for _ in range(400)]


def frame(spark, values):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(values)], SCHEMA)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_round_trip_and_digests(spark):
    df = frame(spark, texts())
    encoded = bpe.encode(df)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()}
    rows = {r["doc_id"]: r for r in bpe.digests(df).collect()}
    for i, text in enumerate(texts()):
        expected = library_ids(text)
        assert ids[i] == expected
        assert back[i] == (text or "")
        written = ",".join(map(str, expected))
        assert rows[i]["n_tokens"] == len(expected)
        assert rows[i]["ids_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        decoded = LIBRARY.decode(expected, skip_special_tokens=False)
        assert rows[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_broken_bytes_decode_alike():
    draw = random.Random(7)
    vocab = bpe.vocabulary(PATH)
    for _ in range(300):
        ids = [draw.randrange(50257) for _ in range(draw.randint(1, 12))]
        assert vocab.decode(np.array(ids)) == LIBRARY.decode(ids, skip_special_tokens=False)


def best_fit_decreasing(lengths, capacity):
    """Number of sequences when pieces are placed one by one."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("capacity", [1, 7, 64, 1024])
def test_plan_is_best_fit(capacity):
    draw = random.Random(8)
    lengths = [draw.randint(1, capacity) for _ in range(500)] + [max(1, capacity // 3)] * 400
    used = defaultdict(list)
    seen = Counter()
    for length, low, high, first, each, at in packing.plan(Counter(lengths), capacity):
        for n in range(high - low):
            used[first + n // each].append((at + n % each * length, length))
        assert low == seen[length]
        seen[length] = high
    assert seen == Counter(lengths)
    for parts in used.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= capacity
    assert len(used) == best_fit_decreasing(lengths, capacity)


def test_pieces_and_places(spark):
    values = texts()
    rows = packing.pack_documents(frame(spark, values), keep_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(values):
        ids = [*library_ids(text), packing.END_ID]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // 1024)))
        assert [x for r in parts for x in r["ids"]] == ids
        assert all(r["length"] == 1024 for r in parts[1:])
        for r in parts:
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids"] == own and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert parts[-1][0] + parts[-1][1] <= 1024
    assert len(by_sequence) == best_fit_decreasing([r["length"] for r in rows], 1024)


def test_repeated_rows_and_empty_table(spark):
    rows = packing.pack_documents(spark.createDataFrame([(1, "a b", 1, "", 1)] * 50 + [(None, None, 1, "", 1)], SCHEMA))
    places = {(r["sequence_id"], r["offset"]) for r in rows.collect()}
    assert len(places) == 51
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(empty).count() == 0
    assert bpe.digests(empty).count() == 0
