"""Text cleaning and tokenising as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from topicvote.constants import DELETED_CHARACTERS, STOPWORDS

# A word is a run of letters, digits and underscores in any script, with single apostrophes inside.
WORD_OR_GAP = r"([\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)*|[^\p{L}\p{N}_]+)"
BEYOND_16_BITS = r"[^\x{10000}-\x{10FFFF}]"
WHITESPACE = r"[ \t\n\x0B\f\r]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remove_digits(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), "[0-9]+", "")


def remove_punctuation(text: str | Column) -> Column:
    """Drops the ASCII punctuation characters."""
    return F.regexp_replace(_col(text), r"\p{Punct}+", "")


def squeeze_whitespace(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), WHITESPACE, " ")


def delete_characters(text: str | Column, characters: str = DELETED_CHARACTERS) -> Column:
    return F.translate(_col(text), characters, "")


def remove_words(text: str | Column, words: Sequence[str] = STOPWORDS) -> Column:
    """Drops whole words; the characters around them stay. In a run with an apostrophe the longest
    listed words go, so "don't" goes as a whole and "she's" leaves "'s" unless it is listed."""
    runs = F.regexp_extract_all(_col(text), F.lit(WORD_OR_GAP), F.lit(1))
    listed = "|".join(re.escape(w) for w in sorted(words, reverse=True))
    inside = rf"(?<![\p{{L}}\p{{N}}_])(?:{listed})(?![\p{{L}}\p{{N}}_])"

    def left(run: Column) -> Column:
        return F.when(run.contains("'"), F.regexp_replace(run, inside, "")).when(~run.isin(*words), run).otherwise("")

    return F.array_join(F.transform(runs, left), "")


def assemble_text(*parts: str | Column) -> Column:
    """Joins the parts with a blank; a null part counts as the empty string."""
    return F.concat_ws(" ", *[F.coalesce(_col(p), F.lit("")) for p in parts])


def clean_text(text: str | Column, stem: bool = True) -> Column:
    """The cleaning chain of the start corpus. ``stem=False`` leaves the stemmer out, and with
    it everything that needs Python."""
    cleaned = squeeze_whitespace(remove_punctuation(remove_digits(text)))
    cleaned = delete_characters(remove_words(F.lower(cleaned)))
    if stem:
        from topicvote.functions.stemmer import stem_text

        cleaned = remove_words(stem_text(cleaned))
    return squeeze_whitespace(cleaned)


def tokenize(text: str | Column, min_length: int = 2) -> Column:
    """Lower-cased tokens between whitespace, short ones dropped. The length is in UTF-16 units, so
    a character beyond 16 bits counts twice."""

    def long_enough(w: Column) -> Column:
        return (F.length(w) >= min_length) | (
            F.length(w) + F.length(F.regexp_replace(w, BEYOND_16_BITS, "")) >= min_length
        )

    return F.filter(F.split(F.lower(_col(text)), WHITESPACE), long_enough)


def split_tokens(lowered: pa.Array) -> pa.ListArray:
    """In a task: the tokens that ``tokenize`` makes of lower-cased texts; a null text has none. A single
    character that UTF-8 needs four bytes for has two UTF-16 units."""
    tokens = pc.ascii_split_whitespace(lowered)
    sizes, flat = tokens.value_lengths().fill_null(0).to_numpy(), tokens.flatten()
    long_enough = pc.or_(pc.greater(pc.utf8_length(flat), 1), pc.greater(pc.binary_length(flat), 3))
    before = np.append(0, np.cumsum(long_enough.to_numpy(zero_copy_only=False)))
    starts = before[np.append(0, np.cumsum(sizes))]
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), flat.filter(long_enough))


def feature_tokens(text: str | Column, stem: bool = True) -> Column:
    """Tokens of the document-feature matrix: no punctuation or numbers, lower case, no stop
    words, stemmed."""
    plain = F.lower(remove_digits(remove_punctuation(text)))
    tokens = F.filter(
        F.split(plain, WHITESPACE), lambda w: (w != "") & ~w.isin(*STOPWORDS)
    )
    if stem:
        from topicvote.functions.stemmer import stem_tokens

        tokens = stem_tokens(tokens)
    return tokens


def query_title(title: str | Column) -> Column:
    """Search form of a title: no punctuation of any script (signs like $ stay), lower case, no
    stop words, joined by '+'."""
    words = F.split(F.lower(F.regexp_replace(_col(title), r"\p{P}+", "")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*STOPWORDS)), "+")


def short_query_title(title: str | Column, n_words: int = 3) -> Column:
    """Fallback search form: the first words of the lower-cased title."""
    return F.array_join(F.slice(F.split(F.lower(_col(title)), " "), 1, n_words), "+")
