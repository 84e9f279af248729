"""Reproducible draws: every random choice is a function of a key and a seed.

One md5 per row gives a number in [0, P); each (topic, replicate) then permutes that number
with a multiply-add modulo the prime P. A retried task makes the same choices, and the
arithmetic is plain enough to repeat in any SQL engine.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2**31 - 1
DEFAULT_SEED = 1830


def row_hash(key: str | Column, seed: int | str = DEFAULT_SEED) -> Column:
    """A number in [0, P) for each row."""
    column = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), column.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(P)


def draw_coefficients(*key: object) -> tuple[int, int]:
    """Multiplier and offset of the draw named by ``key``."""
    digest = hashlib.md5("|".join(str(k) for k in key).encode()).hexdigest()
    return int(digest[:8], 16) % (P - 1) + 1, int(digest[8:16], 16) % P


def draw(hashed: str | Column, *key: object) -> Column:
    """The draw of a row (a number in [0, P)) for ``key``."""
    column = F.col(hashed) if isinstance(hashed, str) else hashed
    a, b = draw_coefficients(*key)
    return (column * F.lit(a).cast("bigint") + F.lit(b).cast("bigint")) % F.lit(P)


def split_number(key: str | Column, parts: int, seed: int | str = DEFAULT_SEED) -> Column:
    """A random part number 1..parts."""
    return (row_hash(key, seed) % F.lit(parts) + 1).cast("int")


def split_by_share(key: str | Column, share: float, seed: int | str = DEFAULT_SEED) -> Column:
    """'train' for about ``share`` of the rows, 'test' for the others."""
    return F.when(row_hash(key, seed) < F.lit(share * P), "train").otherwise("test")
