"""Words of a text column and hashes of word windows, in NumPy, straight from Arrow buffers.

All hashes are polynomials over 64-bit integers, taken from running sums, then mixed. They do not depend on the process
or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20  # bytes of text that are handled at once
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_U = np.uint64


def separators(characters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters)] = True
    return found


SPACES = separators(b" \t\n\v\f\r")
NOT_ALNUM = separators(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, BLOCK + 64), base, _U)
        factors[0] = 1
        have = _powers[base] = np.cumprod(factors)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _spans(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span; equal contents give equal hashes wherever they stand."""
    n = len(values)
    sums = np.zeros(n + 1, _U)
    np.cumsum(values * powers(base, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(pow(base, -1, 1 << 64), n + 1)[starts] + (ends - starts).astype(_U))


@dataclass
class Words:
    """Words of some texts: byte spans, and for each text the index of its first word (one more entry at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U)
        return _spans(self.data.astype(_U) + _U(1), _BYTE_BASE, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word index) and hashes of all windows of n words, each inside one text."""
        end = np.repeat(self.first[1:], np.diff(self.first))
        at = np.arange(len(hashes))
        at = at[at + n <= end]
        if not len(at):
            return at, np.zeros(0, _U)
        return at, _spans(hashes, _WORD_BASE, at, at + n)

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        """One hash per text over all its words."""
        if not len(hashes):
            return np.zeros(len(self.first) - 1, _U)
        return _spans(hashes, _WORD_BASE, self.first[:-1], self.first[1:])


def split(data: np.ndarray, offsets: np.ndarray, between: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    word = ~between[data]
    filled = offsets[:-1] < offsets[1:]
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about BLOCK bytes; a null text counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(texts: pa.Array, between: np.ndarray = SPACES, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    for row, end, data, offsets in blocks(texts):
        yield row, end, split(data, offsets, between, lower)
