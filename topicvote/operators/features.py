"""Vocabulary, term counts and inverse document frequency weights.

A document's counts are made inside its row (no shuffle of document-term pairs), a batch of rows at a
time, and the weights stay in a vector of the vocabulary's length that linear models fold into their
coefficients. The column of words may hold tokens or lower-cased text, which is split where it is counted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicvote.functions.text import split_tokens, tokenize
from topicvote.session import materialise, ship_package

VOCABULARY_SIZE = 262_144
BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_TERMS = 1 << 19
RANGES = 1024
PIECE_TOKENS = 1 << 21
TOKEN_BYTES = 8


def with_words(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Drops rows with a null anywhere and replaces the text by its tokens."""
    return corpus.na.drop().withColumn("words", tokenize(text)).drop(text)


def with_plain(corpus: DataFrame, text: str = "text") -> DataFrame:
    """As ``with_words``, with lower-cased text for ``words``: its tokens are split where they are counted."""
    return corpus.na.drop().withColumn("words", F.lower(text)).drop(text)


def _pieces(batch: pa.RecordBatch, words: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that have about ``PIECE_TOKENS`` tokens together, or a row that has more."""
    column = batch.column(words)
    if pa.types.is_list(column.type):
        sizes = column.value_lengths().fill_null(0).to_numpy()
    else:
        sizes = pc.binary_length(column).fill_null(0).to_numpy() // TOKEN_BYTES
    ends = np.append(np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE_TOKENS)) + 1, batch.num_rows)
    start = 0
    for end in ends:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def _coded(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row of every token, its number among the distinct ones, and these."""
    lists = words if pa.types.is_list(words.type) else split_tokens(words)
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    coded = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(sizes)), sizes), coded.indices.to_numpy(), coded.dictionary


def _runs(rows: np.ndarray, codes: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of every row and code, in this order."""
    pairs = np.sort(rows * n_codes + codes)
    heads = np.flatnonzero(np.diff(pairs, prepend=-1))
    own = pairs[heads]
    return own // n_codes, own % n_codes, np.diff(heads, append=len(pairs))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in _pieces(batch, "words"):
            rows, codes, terms = _coded(piece.column("words"))
            if not len(codes):
                continue
            _, once, counts = _runs(rows, codes, len(terms))
            df = np.bincount(once, minlength=len(terms))
            tc = np.bincount(once, counts, len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([terms, pa.array(df), pa.array(tc)], ["term", "df", "tc"])


def term_statistics(docs: DataFrame, words: str = "words") -> DataFrame:
    """(term, df, tc): documents with the term and its total count, in one pass.

    Tasks count the distinct terms of some thousand documents at a time; these counts are added map-side,
    so a term that is in every document costs one row per task.
    """
    ship_package(docs.sparkSession)
    counted = docs.select(F.col(words).alias("words")).mapInArrow(_term_counts, "term string, df bigint, tc bigint")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tc").alias("tc"))


def _known_terms(words: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's counts begin (one more at the end), the places of its terms among ``terms``, and their
    counts; tokens that are not among them do not count."""
    rows, codes, found = _coded(words)
    places = pc.index_in(found, value_set=terms).fill_null(-1).to_numpy()[codes]
    known = places >= 0
    own, ids, counts = _runs(rows[known], places[known], max(1, len(terms)))
    starts = np.searchsorted(own, np.arange(len(words) + 1))
    return starts, ids, counts


def counted_terms(docs: DataFrame, terms: Sequence[str], words: str = "words", vector: str | None = None) -> DataFrame:
    """``docs`` with, in place of the words, ``term_ids`` (places among ``terms``, in their order) and ``tfs``, counted
    inside the row; or with these two in one ``vector`` of that name."""
    ship_package(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != words]
    known, names = pa.array(terms, pa.string()), [f.name for f in kept]
    if vector:
        added = [T.StructField(vector, VectorUDT())]
    else:
        added = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("term_ids", "tfs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, words):
                starts, ids, counts = _known_terms(piece.column(words), known)
                starts = pa.array(starts.astype(np.int32))
                kinds = (np.int32, float if vector else np.int32)
                lists = [pa.ListArray.from_arrays(starts, pa.array(v.astype(k))) for v, k in zip((ids, counts), kinds, strict=True)]
                if vector:
                    n = piece.num_rows
                    head = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(known), np.int32))]
                    lists = [pa.StructArray.from_arrays([*head, *lists], ["type", "size", "indices", "values"])]
                columns = [piece.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, *lists], [*names, *[f.name for f in added]])

    return docs.mapInArrow(run, T.StructType([*kept, *added]))


def vocabulary_terms(
    docs: DataFrame,
    min_df: int = 5,
    max_df: float | None = None,
    size: int = VOCABULARY_SIZE,
    words: str = "words",
) -> DataFrame:
    """(term, df, tc) of the ``size`` most frequent terms with at least ``min_df`` (and at most
    ``max_df``) documents; equal counts in the order of the terms.

    No task ranks all terms: counts of terms by ever smaller ranges of the count tell the least count
    that gets in; of the terms with just this count, which are sorted by range over many tasks, the
    first are taken by their numbers in their tasks.
    """
    stats = term_statistics(docs, words).where(F.col("df") >= min_df)
    if max_df is not None:
        stats = stats.where(F.col("df") <= max_df)
    stats = materialise(stats, "terms")
    n, low, high = stats.agg(F.count("*"), F.min("tc"), F.max("tc")).first()
    if n <= size:
        return stats
    wanted = size
    while low < high:  # wanted is what is left to take from the counts low to high
        width = -(-(high - low + 1) // RANGES)
        number = F.floor((F.col("tc") - low) / width).cast("int")
        inside = stats.where(F.col("tc").between(low, high))
        counts = dict(inside.groupBy(number.alias("r")).count().collect())
        for r in sorted(counts, reverse=True):
            if counts[r] >= wanted:
                low, high = low + r * width, min(high, low + (r + 1) * width - 1)
                break
            wanted -= counts[r]
    columns = stats.columns
    ties = stats.where(F.col("tc") == low).repartitionByRange("term").sortWithinPartitions("term")
    ties = materialise(ties.withColumn("place", F.monotonically_increasing_id()), "ties")
    task = F.shiftright("place", 33)
    end = None
    for r in ties.groupBy(task.alias("task")).count().orderBy("task").collect():
        if r["count"] >= wanted:
            end = (r["task"] << 33) + wanted
            break
        wanted -= r["count"]
    first = ties.where(F.col("place") < end).select(*columns)
    return stats.where(F.col("tc") > low).unionByName(first)


def trimmed_terms(docs: DataFrame, min_df: int, max_share: float, words: str = "words") -> DataFrame:
    """(term, df, block): all terms in at least ``min_df`` documents and at most this share of them, the
    commonest first, in blocks that are small enough to be sent to all tasks; written."""
    n_docs = docs.count()
    stats = term_statistics(docs, words).where(
        (F.col("df") >= min_df) & (F.col("df") <= max_share * n_docs)
    )
    ordered = stats.select("term", "df").repartitionByRange(F.desc("df"), "term")
    placed = materialise(
        ordered.sortWithinPartitions(F.desc("df"), "term").withColumn("place", F.monotonically_increasing_id()),
        "kept_terms",
    )
    task = F.shiftright("place", 33)
    before, starts = 0, []
    for r in placed.groupBy(task.alias("task")).count().orderBy("task").collect():
        starts += [F.lit(r["task"]), F.lit(before)]
        before += r["count"]
    if not starts:
        return placed.select("term", "df", F.lit(0).alias("block"))
    number = F.element_at(F.create_map(*starts), task) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select("term", "df", F.floor(number / BLOCK_TERMS).cast("int").alias("block"))


def _blocks(terms: DataFrame) -> Iterator[list[str]]:
    """The terms of each block, one block after the other."""
    n_blocks = terms.agg(F.max("block")).first()[0]
    for block in range(0 if n_blocks is None else n_blocks + 1):
        table = terms.where(F.col("block") == block).orderBy(F.desc("df"), "term").select("term").toArrow()
        yield table.column("term").to_pylist()


def trimmed_rows(docs: DataFrame, terms: DataFrame, words: str = "words") -> tuple[list[str], DataFrame]:
    """The terms of all blocks of ``terms`` one after the other, and ``docs`` with ``term_ids`` (places among
    these) and ``tfs``, counted inside the row."""
    names = [name for block in _blocks(terms) for name in block]
    return names, counted_terms(docs, names, words)


def trimmed_counts(
    docs: DataFrame, min_df: int, max_share: float, words: str = "words"
) -> DataFrame:
    """(doc_id, term, tf) of all terms in at least ``min_df`` documents and at most this share of
    them, however many terms that are. Counts are made inside the rows of the documents, a block of
    terms at a time, and nothing is shuffled by document and term."""
    parts = []
    for names in _blocks(trimmed_terms(docs, min_df, max_share, words)):
        counted = counted_terms(docs.select("doc_id", words), names, words)
        table = docs.sparkSession.createDataFrame(pa.table({"term_id": np.arange(len(names), dtype=np.int32), "term": names}))
        rows = entries(counted, "doc_id").join(F.broadcast(table), "term_id")
        parts.append(rows.select("doc_id", "term", F.col("tf").cast("int").alias("tf")))
    if not parts:
        return docs.select("doc_id", F.lit("").alias("term"), F.lit(0).alias("tf")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Vocabulary:
    """Terms with their document frequency; at most ``size`` of them, so this is the one table
    that may live on the driver. A term's number is its place in the count model."""

    model: CountVectorizerModel
    terms: list[str]
    df: np.ndarray
    n_docs: int

    @property
    def idf(self) -> np.ndarray:
        return np.log((self.n_docs + 1.0) / (self.df + 1.0))

    def __len__(self) -> int:
        return len(self.terms)

    def table(self, df: DataFrame) -> DataFrame:
        """(term_id, term, df, idf), broadcast in a join if its measured size allows it."""
        columns = {
            "term_id": np.arange(len(self), dtype=np.int32),
            "term": self.terms,
            "df": self.df,
            "idf": self.idf,
        }
        table = pa.table(columns)
        out = df.sparkSession.createDataFrame(table)
        return F.broadcast(out) if table.nbytes <= BROADCAST_BYTES else out


def fit_vocabulary(docs: DataFrame, min_df: int = 5, max_df: float | None = None,
                   size: int = VOCABULARY_SIZE) -> Vocabulary:
    """The terms are chosen by ``vocabulary_terms``. The count model is fitted on that table, one
    row per term, so the terms get to the JVM's dictionary without a detour."""
    table = vocabulary_terms(docs, min_df, max_df, size).select("term", "df").toArrow()
    one_each = docs.sparkSession.createDataFrame(table).select(F.array("term").alias("words"))
    model = CountVectorizer(
        inputCol="words", outputCol="raw_features", minDF=1.0, vocabSize=size
    ).fit(one_each)
    terms = model.vocabulary
    known = dict(zip(table.column("term").to_pylist(), table.column("df").to_pylist(), strict=True))
    return Vocabulary(model, terms, np.array([known[t] for t in terms], dtype=np.int64), docs.count())


def count_vectors(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Replaces the words by ``raw_features``, a sparse vector of term counts."""
    return counted_terms(docs, vocabulary.terms, vector="raw_features")


def with_arrays(counted: DataFrame, vector: str = "raw_features") -> DataFrame:
    """Adds ``term_ids`` and ``tfs``, the two arrays that make up the count vector."""
    raw = F.unwrap_udt(vector)
    return counted.withColumns(
        {
            "term_ids": raw.getField("indices"),
            "tfs": raw.getField("values").cast("array<int>"),
        }
    )


def tfidf_vectors(counted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds ``features``, the weighted vectors the library's own learners read."""
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense(vocabulary.idf), inputCol="raw_features", outputCol="features"
    )
    return weigh.transform(counted)


def entries(counted: DataFrame, *keep: str | Column) -> DataFrame:
    """One row per document and term: ``term_id`` and ``tf`` besides the kept columns."""
    pairs = F.explode(F.arrays_zip("term_ids", "tfs"))
    return counted.select(*keep, pairs.alias("e")).select(
        *[k for k in keep if isinstance(k, str)],
        F.col("e.term_ids").alias("term_id"),
        F.col("e.tfs").alias("tf"),
    )


def tfidf_terms(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, term, tf, tfidf) for every document and vocabulary term in it."""
    counted = with_arrays(count_vectors(docs.select("doc_id", "words"), vocabulary))
    rows = entries(counted, "doc_id")
    return rows.join(vocabulary.table(docs), "term_id").select(
        "doc_id", "term", "tf", (F.col("tf") * F.col("idf")).alias("tfidf")
    )


def dense_vectors(df: DataFrame, array: str, output: str = "features") -> DataFrame:
    """An array column as a vector."""
    return df.withColumn(output, array_to_vector(F.col(array).cast("array<double>")))
