"""English suffix stripping (Porter's second stemmer, the 'english' one of Snowball).

The words never leave their row: a text or token array is stemmed inside an Arrow batch, and a
bounded cache per worker means each distinct word is worked out about once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from topicvote.session import ship_package

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"

# Exceptional forms and replacement tables of the published algorithm.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_STEP_1A = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
    "ate", "iti", "ous", "ive", "ize", "ion",
]

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _longest(word: str, endings) -> str | None:
    found = [e for e in endings if word.endswith(e)]
    return max(found, key=len) if found else None


def _regions(word: str) -> tuple[int, int]:
    for start in ("gener", "commun", "arsen"):
        if word.startswith(start):
            r1 = len(start)
            break
    else:
        hit = _REGION.search(word)
        r1 = hit.end() if hit else len(word)
    hit = _REGION.search(word, r1)
    return r1, hit.end() if hit else len(word)


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _plural(word: str) -> str:
    ending = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        return word[:-2]
    if ending in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if ending == "s" and _has_vowel(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    ending = _longest(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if ending is None:
        return word
    base = word[: -len(ending)]
    if ending in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else word
    if not _has_vowel(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(DOUBLES):
        return base[:-1]
    if r1 >= len(base) and _SHORT_END.search(base):
        return base + "e"
    return base


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one lower-case word; words with other letters come back as they are."""
    if len(word) < 3:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = word.removeprefix("'")
    word = re.sub(r"(^|[aeiouy])y", lambda m: m.group(1) + "Y", word)
    r1, r2 = _regions(word)

    for ending in ("'s'", "'s", "'"):
        if word.endswith(ending):
            word = word[: -len(ending)]
            break
    word = _plural(word)
    if word in KEPT_AFTER_STEP_1A:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    ending = _longest(word, STEP_2)
    if ending and len(word) - len(ending) >= r1:
        base = word[: -len(ending)]
        allowed = (ending != "ogi" or base.endswith("l")) and (
            ending != "li" or base[-1:] in tuple(LI_ENDINGS)
        )
        if allowed:
            word = base + STEP_2[ending]

    ending = _longest(word, STEP_3)
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word[: -len(ending)] + STEP_3[ending]

    ending = _longest(word, STEP_4)
    if ending and len(word) - len(ending) >= r2:
        base = word[: -len(ending)]
        if ending != "ion" or base.endswith(("s", "t")):
            word = base

    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def _stem_values(words: pa.Array) -> pa.Array:
    """Stems each distinct word of a batch once."""
    coded = words.dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    return stems.take(coded.indices)


def _stem_lists(tokens: pa.Array) -> pa.Array:
    whole = pa.concat_arrays([tokens])
    return pa.ListArray.from_arrays(whole.offsets, _stem_values(whole.values), mask=whole.is_null())


def _stem_texts(texts: pa.Array) -> pa.Array:
    """Words are what stands between single blanks."""
    return pc.binary_join(_stem_lists(pc.split_pattern(texts, " ")), " ")


def stem_text(text: str | Column) -> Column:
    """Stems the words between blanks."""
    ship_package()
    return F.arrow_udf(_stem_texts, "string")(text)


def stem_tokens(tokens: str | Column) -> Column:
    ship_package()
    return F.arrow_udf(_stem_lists, "array<string>")(tokens)


def stem_word(word: str | Column) -> Column:
    ship_package()
    return F.arrow_udf(_stem_values, "string")(word)
