"""Quality rules: how far a document's characters and common words are from its language.

A first pass over all documents sums, for each language, the characters of every class and the
counts of its words; the ``COMMON_WORDS`` most frequent are its common words (ties by the word).
A second pass compares each document's two histograms with those of its language by the
Jensen-Shannon distance (base 2, 0 to 1). A document fails if a histogram is too far away and long
enough to be judged: ``MIN_CHARS`` characters and ``MIN_WORDS`` words. Shorter ones pass this part.

Fixed rules fail a document with fewer than 50 words, or with over half of its words inside
windows of three words that occur twice or more. Null texts have no words, a null language is a
language of its own. References reach the driver: one row for each language and class or word.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from topicvote.llm.common import column, map_rows
from topicvote.session import materialise, ship_package

COMMON_WORDS = 200
MIN_CHARS = 200
MIN_WORDS = 100
MAX_CHAR_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.58
FOREIGN_PART = 0.9
EXPECTED_COMMON = 20
LEAST_WORDS = 50
REPEATED_SHARE = 50
WINDOW = 3
HELD_WORDS = 500_000

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "blank", "stop", "symbol", "other", "beyond")


def _class_table() -> np.ndarray:
    """The class of each byte; bytes that continue a code point have none (the last number)."""
    table = np.full(256, 6)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[[9, 10, 11, 12, 13, 32]] = 3
    table[list(b".,;:!?'\"()-")] = 4
    table[list(SYMBOLS)] = 5
    table[128:192], table[192:] = 8, 7
    return table


BYTE_CLASS = _class_table()


def char_classes(data: bytes) -> np.ndarray:
    """Code points of each class."""
    byte_counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return np.bincount(BYTE_CLASS, byte_counts, minlength=9)[:8].astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that occurs at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    inside = np.zeros(len(words), bool)
    for at in range(WINDOW):
        inside[at : at + n] |= counts[which] > 1
    return int(inside.sum())


def duplicate_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def distance(left: np.ndarray, right: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; one without entries is nowhere."""
    a, b = left.sum(), right.sum()
    if not a or not b:
        return 0.0
    p, q = left / a, right / b
    m = (p + q) / 2
    half = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return math.sqrt(max(0.0, (half(p) + half(q)) / 2))


@dataclass
class Reference:
    """A language: characters of each class, places of its common words, and their counts with
    that of all other words at the end."""

    classes: np.ndarray
    places: dict[bytes, int]
    words: np.ndarray

    @cached_property
    def common_share(self) -> float:
        return 1 - float(self.words[-1]) / max(1.0, float(self.words.sum()))

    @cached_property
    def without_common(self) -> float:
        """The distance of a text without any common word."""
        none = np.zeros(len(self.words))
        none[-1] = 1
        return distance(none, self.words)

    def is_foreign(self, own: np.ndarray, by_words: float) -> bool:
        n = own.sum()
        return bool(
            n * self.common_share >= EXPECTED_COMMON
            and n - own[-1] < n * self.common_share / 2
            and by_words >= FOREIGN_PART * self.without_common
        )


def references(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", common: int = COMMON_WORDS
) -> dict[str | None, Reference]:
    """References of all languages of ``docs``, from all documents."""
    ship_package(docs.sparkSession)

    def run(batches):
        counts: dict[str | None, Counter] = {}

        def rows():
            found = [(lang, None if k is None else k, n) for lang, c in counts.items() for k, n in c.items()]
            columns = zip(*found, strict=True)
            kinds = (pa.string(), pa.binary(), pa.int64())
            out = [pa.array(list(v), t) for v, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(out, ["lang", "word", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                data = (text.as_py() or "").encode()
                counter = counts.setdefault(lang.as_py(), Counter())
                counter.update(data.split())
                for k, n in enumerate(char_classes(data).tolist()):
                    counter[b" %d" % k] += n  # no word begins with a blank
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield rows()
                counts = {}
        if any(counts.values()):
            yield rows()

    rows = docs.select(
        column(docs, text_column).alias("text"), column(docs, lang_column).cast("string").alias("lang")
    )
    partial = rows.mapInArrow(run, "lang string, word binary, n bigint")
    totals = materialise(partial.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word_totals")
    is_class = F.substring("word", 1, 1) == F.lit(b" ")
    order = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    words = totals.filter(~is_class)
    top = words.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= common)
    every = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out: dict[str | None, Reference] = {}
    for r in totals.filter(is_class).collect():
        own = out.setdefault(r["lang"], Reference(np.zeros(len(CLASSES)), {}, np.zeros(common + 1)))
        own.classes[int(r["word"])] = r["n"]
    for r in every.collect():
        out[r["lang"]].words[-1] = r["n"]
    for r in top.collect():
        own = out[r["lang"]]
        own.places[bytes(r["word"])] = r["place"] - 1
        own.words[r["place"] - 1] = r["n"]
        own.words[-1] -= r["n"]
    return out


def judge(text: str | None, reference: Reference | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance, word_distance."""
    data = (text or "").encode()
    words = data.split()
    classes = char_classes(data)
    repeats = repeated_words(words)
    chars = int(classes.sum())
    failed = len(words) < LEAST_WORDS or 100 * repeats > REPEATED_SHARE * len(words)
    by_chars = by_words = 0.0
    foreign = False
    if reference is not None:
        by_chars = distance(classes, reference.classes)
        own = np.zeros(len(reference.words))
        for word, n in Counter(words).items():
            own[reference.places.get(word, -1)] += n
        by_words = distance(own, reference.words)
        foreign = reference.is_foreign(own, by_words)
    far = (chars >= MIN_CHARS and by_chars > MAX_CHAR_DISTANCE) or (
        len(words) >= MIN_WORDS and (foreign or by_words > MAX_WORD_DISTANCE)
    )
    return (
        len(words),
        chars - int(classes[3]),
        int(classes[5]),
        duplicate_lines(data),
        repeats,
        failed,
        not failed and not far,
        by_chars,
        by_words,
    )


VERDICTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, char_distance double, word_distance double"
)


def verdicts(
    docs: DataFrame,
    known: dict[str | None, Reference],
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """doc_id and ``VERDICTS`` for every row."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(known)
    names = ["doc_id", *[part.split()[0] for part in VERDICTS.split(", ")]]

    def run(batch):
        texts, langs = batch.column("text"), batch.column("lang")
        found = [judge(t.as_py(), model.value.get(x.as_py())) for t, x in zip(texts, langs, strict=True)]
        columns = [batch.column("doc_id"), *[pa.array(v) for v in zip(*found, strict=True)]]
        yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(
        column(docs, id_column).alias("doc_id"),
        column(docs, text_column).alias("text"),
        column(docs, lang_column).cast("string").alias("lang"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, run, f"doc_id {kind}, {VERDICTS}")
