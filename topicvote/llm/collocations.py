"""Phrases that occur together more often than their parts say, counted in quotient filters.

One pass counts the words of every language. A phrase of ``least`` occurrences consists of words of
as many, so only these get numbers, and the texts are written once more as such numbers (0 for any
other word and for the end of a piece). A second pass counts pairs of words, a third phrases of
three and more words. Tasks sum what they have buffered in quotient filters (``quotient_filter``),
cut them into shards by the leading bits and give out a filter for each; Spark deals them out by
shard, where the sorted filters are merged. A phrase that is everywhere is one entry of every
filter, so there is no hot key, and the shards grow in number with the input.

Two tables go to all tasks if they are small as measured, and have another way beyond that: the
numbers of the words (else the words are joined with them), and the pairs of ``least`` occurrences,
which spare the third pass phrases that cannot have as many (else it counts them all). The result
is the same in any case.

Null languages are ``und``, null texts empty. Empty texts have no words; an empty table gives an
empty result. Equal rows all count. Very long texts are read in pieces of ``CHUNK`` bytes, but stay
whole: phrases go across. Other columns are not read. There may be up to 2^25 - 1 words of ``least``
occurrences in all languages together.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from topicvote.llm.common import BROADCAST_BYTES, column, join_groups, map_rows
from topicvote.llm.quotient_filter import Layout, decode, encode, merged, summed
from topicvote.session import materialise, ship_package

LEAST = 100
LONGEST = 5
TOP = 2000
UNKNOWN = "und"
BREAK = b"."
BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes(
    BREAK[0] if c in BREAKS else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256)
)
CHUNK = 1 << 22
HELD_WORDS = 300_000
HELD_NUMBERS = 1 << 21
SHARD_WORDS = 1 << 20
MERGED_ENTRIES = 1 << 21
WORD_BYTES = 24
RANK_PARTS = 64


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The folded words of a text in lists, ``BREAK`` where a piece ends."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = at + CHUNK
        if end < len(folded):
            cut = max(folded.rfind(b" ", at, end), folded.rfind(BREAK, at, end))
            while cut < 0 and end < len(folded):  # a word longer than a chunk
                end += CHUNK
                cut = max(folded.rfind(b" ", at, end), folded.rfind(BREAK, at, end))
            end = cut + 1 if end < len(folded) else len(folded)
        yield folded[at:end].replace(BREAK, b" . ").split()
        at = end


def _rows(docs: DataFrame, text_column: str, language_column: str) -> DataFrame:
    language = F.coalesce(column(docs, language_column).cast("string"), F.lit(UNKNOWN))
    return docs.select(language.alias("lang"), column(docs, text_column).alias("text"))


def word_counts(docs: DataFrame, text_column: str = "text", language_column: str = "lang") -> DataFrame:
    """lang, word, n: all words of all languages, written."""
    ship_package(docs.sparkSession)

    def run(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def flush():
            for lang, counts in held.items():
                counts.pop(BREAK, None)
                words = pa.array(list(counts), pa.binary()).cast(pa.string())
                n = pa.array(list(counts.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), words, n], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                for part in tokens(text.as_py() or b""):
                    held[lang].update(part)
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    partial = _rows(docs, text_column, language_column).mapInArrow(run, "lang string, word string, n bigint")
    return materialise(partial.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")


def numbered(words: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, word, n, id: the words of ``least`` occurrences, numbered from 1 without gaps; written."""
    frequent = words.filter(F.col("n") >= least).withColumn("place", F.monotonically_increasing_id())
    placed = materialise(frequent, "frequent")
    part = F.shiftright("place", 33)
    first, offsets = 1, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets += [F.lit(r["part"]), F.lit(first)]
        first += r["count"]
    if not offsets:
        return placed.select("lang", "word", "n", F.col("place").cast("int").alias("id"))
    start = F.element_at(F.create_map(*offsets), part)
    number = start + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(placed.select("lang", "word", "n", number.cast("int").alias("id")), "vocabulary")


def coded_by_table(docs: DataFrame, vocabulary: DataFrame, text_column: str, language_column: str) -> DataFrame:
    """ids: a row for each text, by a table of the words that every task has."""
    table: dict[str, dict[bytes, int]] = defaultdict(dict)
    rows = vocabulary.select("lang", "word", "id").toArrow()
    for lang, word, number in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        table[lang][word.encode()] = number
    sent = docs.sparkSession.sparkContext.broadcast(dict(table))

    def run(batch):
        known = sent.value
        out = []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            get = known.get(lang, {}).get
            parts = [[get(word, 0) for word in part] for part in tokens(text.as_py() or b"")]
            out.append(np.concatenate([np.array(p, np.int32) for p in [*parts, [0]]]))
        starts = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(starts, pa.array(np.concatenate(out) if out else np.empty(0, np.int32)))
        yield pa.RecordBatch.from_arrays([lists], ["ids"])

    return map_rows(_rows(docs, text_column, language_column), run, "ids array<int>")


def coded_by_join(docs: DataFrame, vocabulary: DataFrame, text_column: str, language_column: str) -> DataFrame:
    """The same for a vocabulary of any size: the words are joined with their numbers and come
    back together by text. The commonest words stay where they are (``join_groups``)."""

    def run(batch):
        for row, lang, text in zip(
            *(batch.column(c).to_pylist() for c in ("row", "lang")), batch.column("text").cast(pa.binary()), strict=True
        ):
            at = 0
            for part in tokens(text.as_py() or b""):
                words = pa.array(part, pa.binary()).cast(pa.string())
                places = pa.array(np.arange(at, at + len(part)))
                columns = [pa.array([row] * len(part), pa.int64()), pa.array([lang] * len(part), pa.string()), places, words]
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, ["row", "lang", "at", "word"])

    key = F.concat("lang", F.lit(" "), "word").alias("key")  # no word holds a blank
    rows = materialise(_rows(docs, text_column, language_column).withColumn("row", F.monotonically_increasing_id()), "rows")
    words = map_rows(rows, run, "row bigint, lang string, at bigint, word string").select("row", "at", key)
    joined = join_groups(materialise(words, "tokens"), vocabulary.select(key, "id"), "key", "left")
    pairs = F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", F.lit(0)).alias("id"))))
    ids = F.concat(F.transform(pairs, lambda p: p["id"]), F.array(F.lit(0)))
    return joined.groupBy("row").agg(ids.alias("ids")).select("ids")


def _flushed(sizes: list[int], bits: int, shard_bits: int, pairs: np.ndarray | None):
    """Sums buffered numbers in filters: a row for each phrase length and shard."""

    def near(numbers: np.ndarray) -> np.ndarray:
        """Where a pair of ``pairs`` begins."""
        both = (numbers[:-1] << bits) | numbers[1:]
        place = np.minimum(np.searchsorted(pairs, both), max(0, len(pairs) - 1))
        return pairs[place] == both if len(pairs) else np.zeros(len(both), bool)

    def filters(numbers: np.ndarray):
        close = None if pairs is None else near(numbers)
        for k in sizes:
            count = len(numbers) - k + 1
            if count <= 0:
                continue
            marks, needed = (numbers > 0, k) if close is None else (close, k - 1)
            here = marks[:count].copy()
            for j in range(1, needed):
                here &= marks[j : j + count]
            at = np.flatnonzero(here)
            if not len(at):
                continue
            layout = Layout(k, bits)
            left, right, counts = summed(layout.half, *layout.pack([numbers[at + j] for j in range(k)]))
            used = min(shard_bits, layout.half)
            shards = left >> np.uint64(layout.half - used) if used else np.zeros_like(left)
            edge = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True])))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                yield k, int(shards[a]), encode(layout.half, (left[a:b], right[a:b], counts[a:b]))

    def flush(held):
        rows = list(filters(np.concatenate(held).astype(np.int64)))
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[2] for r in rows], pa.binary())], ["k", "shard", "data"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.column("ids").slice(first, 64).flatten().to_numpy()
                held.append(part)
                size += len(part)
                if size >= HELD_NUMBERS:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _merged(bits: int, least: int):
    """k, ids, a of rows (k, shard, data) sorted by k and shard: filters of a shard merged."""

    def run(batches):
        shard, waiting, size, done = None, [], 0, None

        def merge():
            half = Layout(shard[0], bits).half
            parts = [decode(half, d) for d in waiting]
            return merged(half, parts if done is None else [done, *parts])

        def out(entries):
            left, right, counts = entries
            often = counts >= least
            words = Layout(shard[0], bits).unpack(left[often], right[often]).astype(np.int32)
            n = len(words)
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * shard[0], pa.array(words.ravel()))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard[0], np.int32)), lists, pa.array(counts[often])], ["k", "ids", "a"]
            )

        for batch in batches:
            for k, number, data in zip(*(batch.column(c) for c in ("k", "shard", "data")), strict=True):
                here = (k.as_py(), number.as_py())
                if here != shard:
                    if shard is not None:
                        yield out(merge())
                    shard, waiting, size, done = here, [], 0, None
                waiting.append(data.as_py())
                size += len(waiting[-1])
                if size >= MERGED_ENTRIES * 4:
                    done, waiting, size = merge(), [], 0
        if shard is not None:
            yield out(merge())

    return run


def phrase_counts(
    coded: DataFrame, sizes: list[int], bits: int, total: int, least: int = LEAST, pairs: np.ndarray | None = None
) -> DataFrame:
    """k, ids, a: phrases of the given numbers of words with ``least`` occurrences, written.

    ``coded`` has ids (written); ``total`` is the number of words, from which the number of shards
    follows; ``pairs`` are the sorted pairs of words (first << bits | second) outside of which no
    longer phrase needs counting."""
    shard_bits = max(0, (total // SHARD_WORDS).bit_length())
    filters = coded.select("ids").mapInArrow(_flushed(sizes, bits, shard_bits, pairs), "k int, shard bigint, data binary")
    dealt = filters.repartition("k", "shard").sortWithinPartitions("k", "shard")
    return materialise(dealt.mapInArrow(_merged(bits, least), "k int, ids array<int>, a bigint"), "phrases")


def _key(ids: Column) -> Column:
    return F.concat_ws(" ", ids.cast("array<string>"))


def scored(phrases: DataFrame, single: DataFrame) -> DataFrame:
    """key, ids, a, l, r, n, score of candidates ``phrases`` (ids, a); ``single`` (id, lang, a, n) has
    the words. The lowest score of all cuts counts, of equal ones that of the first."""
    known = phrases.select(_key(F.col("ids")).alias("key"), "a").unionByName(
        single.select(F.col("id").cast("string").alias("key"), "a")
    )
    known = materialise(known, "known")
    cuts = phrases.select(
        _key(F.col("ids")).alias("whole"),
        F.get("ids", F.lit(0)).alias("id"),
        F.col("a").alias("both"),
        F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("cut"),
        "ids",
    ).select(
        "whole",
        "id",
        "both",
        "cut",
        _key(F.slice("ids", F.lit(1), F.col("cut"))).alias("left"),
        _key(F.slice("ids", F.col("cut") + 1, F.size("ids"))).alias("right"),
    )
    halves = join_groups(materialise(cuts, "cuts"), known.toDF("left", "l"), "left")
    parts = join_groups(materialise(halves, "halves"), known.toDF("right", "r"), "right")
    totals = single.select("id", "lang", "n")
    rows = join_groups(materialise(parts, "parts"), totals, "id")
    wide = "decimal(38,0)"
    score = F.expr(f"(CAST(1000 AS {wide}) * CAST(both AS decimal(20,0)) * n) DIV (CAST(l AS {wide}) * r)")
    rows = rows.withColumn("score", score)
    best = rows.groupBy("whole").agg(
        F.min_by(F.struct("lang", F.col("both").alias("a"), "l", "r", "n", "score"), F.struct("score", "cut")).alias("b")
    )
    return best.select(F.col("whole").alias("key"), "b.*")


def inner_phrases(phrases: DataFrame, share: int = 100) -> DataFrame:
    """key: the candidates that lie inside a longer one with at least ``share`` of 100 of their
    occurrences."""
    inside = phrases.filter("k > 2").select(
        "a",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), F.col("k") - 1),
                    lambda size: F.transform(
                        F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.slice("ids", at, size)
                    ),
                )
            )
        ).alias("part"),
    )
    most = inside.groupBy(_key(F.col("part")).alias("key")).agg(F.max("a").alias("longer"))
    own = phrases.select(_key(F.col("ids")).alias("key"), "a")
    return own.join(most, "key").filter(F.col("longer") * 100 >= F.col("a") * share).select("key")


def with_text(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``rows`` (key) with ``phrase``: the words instead of their numbers."""
    placed = rows.select("key", F.posexplode(F.split("key", " ").cast("array<int>")).alias("at", "id"))
    words = join_groups(materialise(placed, "placed"), vocabulary.select("id", "word"), "id")
    ordered = F.array_sort(F.collect_list(F.struct("at", "word")))
    phrase = F.concat_ws(" ", F.transform(ordered, lambda x: x["word"]))
    return rows.join(words.groupBy("key").agg(phrase.alias("phrase")), "key")


def collocations(
    docs: DataFrame,
    text_column: str = "text",
    language_column: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int | None = TOP,
    share: int = 100,
    table_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every language (all if None)."""
    words = word_counts(docs, text_column, language_column)
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    vocabulary = numbered(words, least)
    size, length = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    bits = max(1, size.bit_length())
    code = coded_by_table if length + WORD_BYTES * size <= table_bytes else coded_by_join
    coded = materialise(code(docs, vocabulary, text_column, language_column), "coded")
    two = phrase_counts(coded, [2], bits, total, least)
    known = None
    if two.count() * 8 <= table_bytes:
        table = two.select(F.shiftleft(F.get("ids", F.lit(0)).cast("bigint"), bits).bitwiseOR(F.get("ids", F.lit(1)).cast("bigint")).alias("pair")).toArrow()
        known = np.sort(table.column("pair").to_numpy().astype(np.int64))
    phrases = two
    if longest > 2:
        phrases = two.unionByName(phrase_counts(coded, list(range(3, longest + 1)), bits, total, least, known))
    single = materialise(vocabulary.withColumnRenamed("n", "a").join(totals, "lang").select("id", "lang", "a", "n"), "single")
    found = scored(phrases, single).join(inner_phrases(phrases, share), "key", "left_anti")
    rows = with_text(materialise(found, "scored"), vocabulary)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:  # the first of a part before the first of all, so that no task ranks more than those
        part = W.partitionBy("lang", "part").orderBy(*order)
        rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(RANK_PARTS)))
        rows = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
