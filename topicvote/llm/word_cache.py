"""Token ids of texts by way of their distinct words.

The pre-tokenizer never joins what stands on both sides of a single blank or line break between
two other characters; the blank goes with the word after it. A text is therefore cut there by
string methods, and only words that are new to the worker are encoded. A text with any other
white space is cut by the full pattern.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import regex

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
CACHE_WORDS = 250_000
LONG_WORD = 256

# Letters and numbers that came after Unicode 16. The installed `regex` knows them,
# the tokenizer does not and takes them for signs.
NEWER = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱"
    r"꭬-꭭\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f"
    r"\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    r"\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    r"\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
PRETOKENS = regex.compile(
    public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]")
    .replace(r"?\p{L}", rf"?[\p{{L}}--[{NEWER}]]")
    .replace(r"?\p{N}", rf"?[\p{{N}}--[{NEWER}]]"),
    regex.V1,
)
# All white space but blank and line break, and the character that marks cuts.
ODD = "\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(
    map(chr, range(0x2000, 0x200B))
)
TWICE = ("  ", " \n", "\n ", "\n\n")


def pieces(text: str) -> list[str]:
    """Pieces of a text without special tokens whose ids do not depend on their neighbours."""
    if not text:
        return []
    if text[0] in " \n" or text[-1] in " \n" or any(c in text for c in TWICE) or any(c in text for c in ODD):
        return PRETOKENS.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def pre_tokens(text: str) -> list[str]:
    """What ``PRETOKENS`` finds in a text; plain words are told by their letters."""
    body = text[1:] if text[:1] == " " else text
    if body.isalpha():
        return [text]
    if body[-1:] in (".", ",") and body[:-1].isalpha():
        return [text[:-1], text[-1]]
    return PRETOKENS.findall(text)


class WordEncoder:
    """Ids (little-endian unsigned 32 bit) of whole texts; ``encode`` gives those of pieces.

    Up to ``CACHE_WORDS`` pieces are remembered, longer ones than ``LONG_WORD`` never."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self._encode = encode
        self._ids: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            parts = []
            for k, plain in enumerate(text.split(SPECIAL)):
                if k:
                    parts.append(SPECIAL)
                parts += pieces(plain)
            cut.append(parts)
        if len(self._ids) > CACHE_WORDS:
            self._ids = {}
        self._ids[SPECIAL] = SPECIAL_ID.to_bytes(4, "little")
        ids = self._ids
        new = list(set().union(*cut).difference(ids))
        ids.update(zip(new, self._encode(new), strict=True))
        out = [b"".join(map(ids.__getitem__, parts)) for parts in cut]
        for word in new:
            if len(word) > LONG_WORD:
                del ids[word]
        return out
