"""Counting quotient filters that lose nothing: compact, sorted counters of packed n-grams.

An n-gram of k word numbers of ``bits`` bits is one number of k * bits bits, held as two halves. A
Feistel network permutes these numbers one to one, so that the entries spread evenly. The leading
bits of the permuted number are its quotient, all others its remainder. A filter holds its entries
in the order of the quotient and then of the remainder: the gaps between quotients, the remainders
in as few whole bytes as they take, and the counts, both small numbers with a place for the rare
large ones. Since the remainder is kept in full, the number and from it the words can be got back,
counts are exact, and filters of different quotient widths can be merged.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

ROUNDS = 4
MAX_BITS = 25
_HEADER = struct.Struct("<QB")
_LARGE = 255


def _mixed(x: np.ndarray, number: int) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15 * (number + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Layout:
    """Numbers of ``words`` words of ``bits`` bits."""

    words: int
    bits: int

    def __post_init__(self):
        if not 0 < self.bits <= MAX_BITS or not 0 < self.words * self.bits <= 128:
            raise ValueError(f"{self.words} words of {self.bits} bits do not fit 128 bits")

    @property
    def half(self) -> int:
        return -(-self.words * self.bits // 2)

    @property
    def _mask(self) -> np.uint64:
        return np.uint64((1 << self.half) - 1)

    def _places(self):
        for k in range(self.words):
            yield k, self.bits * (self.words - 1 - k)

    def pack(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The permuted numbers of n-grams, as two halves; a column for each word."""
        left = np.zeros(len(columns[0]), np.uint64)
        right = left.copy()
        for k, place in self._places():
            word = columns[k].astype(np.uint64)
            if place < self.half:
                right |= (word << np.uint64(place)) & self._mask
                if place + self.bits > self.half:
                    left |= word >> np.uint64(self.half - place)
            else:
                left |= word << np.uint64(place - self.half)
        for number in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, number) & self._mask)
        return left, right

    def unpack(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The words of permuted numbers, a row for each."""
        for number in reversed(range(ROUNDS)):
            left, right = right ^ (_mixed(left, number) & self._mask), left
        out = np.empty((len(left), self.words), np.int64)
        for k, place in self._places():
            if place < self.half:
                word = right >> np.uint64(place)
                if place + self.bits > self.half:
                    word |= left << np.uint64(self.half - place)
            else:
                word = left >> np.uint64(place - self.half)
            out[:, k] = word & np.uint64((1 << self.bits) - 1)
        return out


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # left, right, count


def summed(half: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None) -> Entries:
    """Entries in order, each number once, with the sum of its counts (one for each if None)."""
    if 2 * half <= 64:
        numbers = left << np.uint64(half) | right
        order = np.argsort(numbers, kind="stable")
    else:
        order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.ones(len(left), bool)
    first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    heads = np.flatnonzero(first)
    if counts is None:
        total = np.diff(heads, append=len(left))
    else:
        total = np.add.reduceat(counts[order], heads) if len(heads) else counts[:0]
    return left[heads], right[heads], total.astype(np.int64)


def _small(values: np.ndarray) -> bytes:
    large = values >= _LARGE
    return np.where(large, _LARGE, values).astype(np.uint8).tobytes() + values[large].astype("<u8").tobytes()


def _large(buffer: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    values = np.frombuffer(buffer, np.uint8, n, at).astype(np.uint64)
    large = np.flatnonzero(values == _LARGE)
    values[large] = np.frombuffer(buffer, "<u8", len(large), at + n)
    return values, at + n + 8 * len(large)


def _bytes(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _numbers(buffer: memoryview, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(buffer, np.uint8, n * width, at).reshape(n, width)
    return wide.view("<u8").ravel(), at + n * width


def encode(half: int, entries: Entries) -> bytes:
    """A filter of sorted entries, with about one quotient for each of them."""
    left, right, counts = entries
    quotient_bits = min(half, max(0, len(left) - 1).bit_length())
    rest = half - quotient_bits
    quotients = left >> np.uint64(rest) if rest < 64 else np.zeros_like(left)
    remainders = left & np.uint64((1 << rest) - 1)
    parts = [
        _HEADER.pack(len(left), quotient_bits),
        _small(np.diff(quotients, prepend=np.uint64(0))),
        _small((counts - 1).astype(np.uint64)),
        _bytes(remainders, -(-rest // 8)),
        _bytes(right, -(-half // 8)),
    ]
    return b"".join(parts)


def decode(half: int, data: bytes) -> Entries:
    n, quotient_bits = _HEADER.unpack_from(data)
    rest, buffer = half - quotient_bits, memoryview(data)
    gaps, at = _large(buffer, _HEADER.size, n)
    counts, at = _large(buffer, at, n)
    remainders, at = _numbers(buffer, at, n, -(-rest // 8))
    right, at = _numbers(buffer, at, n, -(-half // 8))
    quotients = np.cumsum(gaps, dtype=np.uint64)
    left = quotients << np.uint64(rest) | remainders if rest < 64 else remainders
    return left, right, counts.astype(np.int64) + 1


def merged(half: int, parts: list[Entries]) -> Entries:
    """One run of sorted entries out of several."""
    if len(parts) == 1:
        return parts[0]
    return summed(half, *(np.concatenate(columns) for columns in zip(*parts, strict=True)))
