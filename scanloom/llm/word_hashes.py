"""Hashes of words and of runs of words, for many texts at once.

A word's hash is a polynomial of its bytes, lower-cased by a table of byte
values, and comes from sums over the whole buffer; a run's hash is a polynomial
of its words' hashes.  All are of 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once.
HASHED_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15
#: Bytes between words: the ASCII white space, or every ASCII character but letters and digits.
WHITE_SPACE = frozenset([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = frozenset(range(128)) - frozenset(range(0x30, 0x3A)) - frozenset(range(0x41, 0x5B)) - frozenset(range(0x61, 0x7B))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size if len(out) else 0):
        out = out * np.uint64(_P) + words[k : len(words) - size + k + 1]
    return mixed(out)


@dataclass
class Words:
    """Words of some texts: hashes, first and last byte in ``data`` (end exclusive), and at which word each text begins."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


class WordHasher:
    """A-Z is lower-cased; ``between`` holds the bytes that stand between words."""

    def __init__(self, between: frozenset[int] = WHITE_SPACE):
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
        self.values[0x41:0x5B] = self.values[0x61:0x7B]
        self.between = np.zeros(256, bool)
        self.between[sorted(between)] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, HASHED_BYTES)
            for name, base in (("power", _P), ("inverse", pow(_P, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def words(self, data: np.ndarray, bounds: np.ndarray) -> Words:
        """Words of texts that stand one after the other in ``data``; no word goes on from one to the next."""
        if not len(data):
            none = np.zeros(0, np.int64)
            return Words(data, np.zeros(0, np.uint64), none, none, np.zeros(len(bounds), np.int64))
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=sums[1:])
        # breaks[i]: no word goes on from byte i - 1 to byte i
        solid = ~self.between[data]
        breaks = np.ones(len(data) + 1, bool)
        breaks[1:-1] = ~(solid[1:] & solid[:-1])
        breaks[bounds] = True
        starts = np.flatnonzero(solid & breaks[:-1])
        ends = np.flatnonzero(solid & breaks[1:]) + 1
        return Words(data, mixed((sums[ends] - sums[starts]) * self.inverse[starts]), starts, ends, np.searchsorted(starts, bounds))

    def column(self, column: pa.Array):
        """Words of a string column, in parts of about HASHED_BYTES: (number of the first text, Words).  A null has none."""
        texts = (column.fill_null("") if column.null_count else column).cast(pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + HASHED_BYTES, "right")) - 1)
            yield first, self.words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last
