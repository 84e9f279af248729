"""Byte-pair encoding by backtracking, and decoding by an offset table.

The vocabulary file is read, never trained or copied. From its merges comes a table of which two
tokens may stand side by side: a pair is compatible if no merge would ever have joined something
across its border. An encoding whose neighbours are all compatible is the one the merges give.

The encoder finds the longest token at every position in one run of an Aho-Corasick automaton,
takes it, and steps back to a shorter prefix token, or over the token before, if the pair is not
compatible or the position is known to lead nowhere. Each position fails at most once, so the
time is linear in the length of the text.

Null texts are empty and have no ids. The string of the special token in a text is that token.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from topicvote.llm.common import column, map_rows, text_slices
from topicvote.llm.word_cache import CACHE_WORDS, WordEncoder, pre_tokens
from topicvote.session import ship_package

TOKENIZER = "byte_bpe_50k.json"
PAIR_SLOTS = 1 << 20
LONG_PIECE = 64
CUT = "\u0100"  # between texts whose letters are bytes
NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Tables of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = set(special.values())
        size = max([*ids.values(), *special.values()]) + 1
        self.bytes = [b""] * size
        for token, at in ids.items():
            if token not in special:
                self.bytes[at] = bytes(letters[c] for c in token)
        for token, at in special.items():
            self.bytes[at] = token.encode()
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.rank = [-1] * size
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.merges[a, b] = rank
            if self.halves[whole] is None:
                self.halves[whole], self.rank[whole] = (a, b), rank
        by_bytes = {b: at for at, b in enumerate(self.bytes) if at not in special.values()}
        self.length = [len(b) for b in self.bytes]
        self._right = [self._spine(t, 1) for t in range(size)]
        self._left = [self._spine(t, 0) for t in range(size)]
        self._pair = np.full(PAIR_SLOTS, -1, np.int64)
        self._fits = np.zeros(PAIR_SLOTS, bool)
        self._met: dict[str, bytes] = {}
        self.single = np.array([by_bytes[bytes([b])] for b in range(256)])
        self.automaton = ahocorasick.Automaton()
        whole = set()
        for text, at in by_bytes.items():
            half = self.halves[at]
            # A token that its own halves would never form cannot occur.
            if text and (half is None or self._compatible(*half, below=self.rank[at])):
                whole.add(at)
                if len(text) > 1:
                    self.automaton.add_word(text.decode("latin-1"), at)
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for at in whole:
            text = self.bytes[at]
            self.shorter[at] = next(
                (p for k in range(len(text) - 1, 0, -1) if (p := by_bytes.get(text[:k])) in whole), -1
            )
        self.shorter, self.sizes = np.array(self.shorter), np.array(self.length)
        self.offsets = np.concatenate(([0], np.cumsum(self.length)))
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.decimal = [str(i) for i in range(size)]

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the outermost byte on one side up to the token: each part, and the rank of the
        merge that takes it into the next."""
        spine, above = [], NEVER
        while True:
            spine.append((token, above))
            half = self.halves[token]
            if half is None:
                return spine[::-1]
            above, token = self.rank[token], half[side]

    def _compatible(self, left: int, right: int, below: int = NEVER) -> bool:
        """Whether no merge of a rank under ``below`` crosses the border of two tokens."""
        xs, ys = self._right[left], self._left[right]
        i = j = 0
        while True:
            (x, up_x), (y, up_y) = xs[i], ys[j]
            across = self.merges.get((x, y), NEVER)
            if across < below and across < up_x and across <= up_y:
                return False
            if up_x == up_y == NEVER:
                return True
            if up_x <= up_y:
                i += 1
            else:
                j += 1

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same for many pairs, by a table of the pairs met before."""
        pairs = left << 32 | right
        slot = (left * 40503 ^ right) & (PAIR_SLOTS - 1)
        new = np.flatnonzero(self._pair[slot] != pairs)
        answer = self._fits[slot]
        if len(new):
            unseen, where = np.unique(pairs[new], return_inverse=True)
            fits = np.array([self._compatible(p >> 32, p & 0xFFFFFFFF) for p in unseen.tolist()], bool)
            answer[new] = fits[where]
            at = ((unseen >> 32) * 40503 ^ unseen & 0xFFFFFFFF) & (PAIR_SLOTS - 1)
            # Of pairs that share a slot the last stays, with its own answer.
            last = len(at) - 1 - np.unique(at[::-1], return_index=True)[1]
            self._pair[at[last]], self._fits[at[last]] = unseen[last], fits[last]
        return answer

    def encode_piece(self, text: str) -> list[int]:
        """Ids of one pre-token of any length."""
        data = text.encode()
        length, size = self.length, len(data)
        longest = self.single[np.frombuffer(data, np.uint8)].tolist()
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end - length[token] + 1] = token  # later ends are longer
        if size and length[longest[0]] == size:
            return [longest[0]]
        open_ = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            end = at + length[token]
            if open_[end] and (not out or self._compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < size:
                    token = longest[at]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of many short pre-tokens: the same steps as in ``encode_piece``, one step of all of
        them at a time. The token before is found by ``back``, the start of what ends at a place."""
        if not texts:
            return []
        raw = [t.encode() for t in texts]
        data = [t.decode("latin-1") for t in raw]
        sizes = np.array([len(t) for t in data])
        start = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        stop = start + sizes
        joined = CUT.join(data)
        longest = self.single[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
        hits = np.fromiter(self.automaton.iter(joined), np.dtype([("end", np.int64), ("token", np.int64)]))
        longest[hits["end"] - self.sizes[hits["token"]] + 1] = hits["token"]
        open_ = np.ones(len(joined) + 1, bool)
        chosen, back = np.full_like(longest, -1), np.full_like(longest, -1)
        word, at = np.arange(len(data)), start.copy()
        token = longest[at]
        while len(word):
            end = at + self.sizes[token]
            fits = open_[end]
            check = np.flatnonzero(fits & (at > start[word]))
            fits[check] = self.compatible(chosen[back[at[check]]], token[check])
            taken, left = np.flatnonzero(fits), np.flatnonzero(~fits)
            chosen[at[taken]], back[end[taken]] = token[taken], at[taken]
            at[taken] = end[taken]
            token[taken] = longest[at[taken]]
            shorter = self.shorter[token[left]]
            stuck = left[shorter < 0]
            token[left] = shorter
            open_[at[stuck]] = False
            at[stuck] = back[at[stuck]]
            token[stuck] = chosen[at[stuck]]
            going = at < stop[word]
            word, at, token = word[going], at[going], token[going]
        used = np.zeros(len(joined) + 1, bool)
        at, first = stop, start
        while len(at):
            at = back[at]
            used[at] = True
            at, first = at[at > first], first[at > first]
        places = np.flatnonzero(used)
        ids = chosen[places].astype("<u4").tobytes()
        cuts = 4 * np.searchsorted(places, np.append(start, len(joined) + 1))
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of texts; pre-tokens met before are looked up."""
        if len(self._met) > CACHE_WORDS:
            self._met = {}
        met, split = self._met, [pre_tokens(w) for w in words]
        new = list(set().union(*split).difference(met))
        long = [p for p in new if len(p) > LONG_PIECE]
        short = [p for p in new if len(p) <= LONG_PIECE]
        met.update(zip(short, self.encode_pieces(short), strict=True))
        met.update((p, np.array(self.encode_piece(p), "<u4").tobytes()) for p in long)
        out = [b"".join(map(met.__getitem__, parts)) for parts in split]
        for piece in long:
            del met[piece]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes lie in one table at known offsets; bytes that are not
        UTF-8 become replacement characters."""
        begins = self.offsets[ids]
        sizes = self.offsets[ids + 1] - begins
        ends = np.cumsum(sizes)
        if not len(ids):
            return ""
        where = np.arange(ends[-1]) + np.repeat(begins - (ends - sizes), sizes)
        return self.blob[where].tobytes().decode("utf-8", "replace")


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(vocabulary(path).encode_words)


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str = TOKENIZER) -> DataFrame:
    """doc_id, ids: array<int> for every row."""
    return _run(docs, id_column, text_column, name, "ids array<int>", _ids)


def _ids(vocab: Vocabulary, ids: np.ndarray):
    return (ids.astype(np.int32),)


def decode(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", name: str = TOKENIZER) -> DataFrame:
    """doc_id, text of every row of ids; null ids give an empty text."""
    ship_package(encoded.sparkSession)

    def run(batch):
        vocab = vocabulary(public_tokenizers.path(name))
        texts = [vocab.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(column(encoded, id_column).alias("doc_id"), column(encoded, ids_column).alias("ids"))
    return map_rows(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes every text in one pass."""
    return _run(
        docs, id_column, text_column, name, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests
    )


def _digests(vocab: Vocabulary, ids: np.ndarray):
    written = ",".join(map(vocab.decimal.__getitem__, ids.tolist()))
    decoded = vocab.decode(ids).encode()
    return len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _run(docs, id_column, text_column, name, schema, answer) -> DataFrame:
    ship_package(docs.sparkSession)

    def run(batch):
        path = public_tokenizers.path(name)
        vocab, encode_texts = vocabulary(path), encoder(path)
        rows = [
            answer(vocab, np.frombuffer(ids, "<u4").astype(np.int64))
            for _, texts in text_slices(batch)
            for ids in encode_texts(texts)
        ]
        columns = [pa.array(values) for values in zip(*rows, strict=True)]
        names = [part.split()[0] for part in schema.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    rows = docs.select(column(docs, id_column).alias("doc_id"), column(docs, text_column).alias("text"))
    return map_rows(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")
