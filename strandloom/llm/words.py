"""Word arithmetic on the bytes of many texts at once.

A word is a run of bytes other than space and tab to carriage return, which is what
``bytes.split()`` takes.  Hashes here only propose candidates: equal words always
have equal hashes, and what they propose is compared by stronger means.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.llm.resident import release, resident

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 5


def _powers(n: int) -> list[np.ndarray]:
    """At least n powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        own = np.full(1 << max(n - 1, 1).bit_length(), base, np.uint64)
        own[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(own))
    return out


def _tables(n: int) -> list[np.ndarray]:
    own = resident("powers", 0, lambda: _powers(n))
    if len(own[0]) < n:
        release("powers")
        own = resident("powers", 0, lambda: _powers(n))
    return own


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Texts laid end to end: for every word its start, end, text number and hash."""

    def __init__(self, texts: list[bytes | None], space: np.ndarray = _SPACE) -> None:
        self.data = b"\n".join(t or b"" for t in texts)
        raw = np.frombuffer(self.data, np.uint8)
        gap = space[raw]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1, append=1))
        self.start, self.end = edge[::2], edge[1::2]
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        self.text = np.searchsorted(begins, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, begins)  # each text's first word
        self.count = np.diff(self.first, append=len(self.start))
        power, inverse = _tables(len(raw) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw + np.uint64(1)) * power[: len(raw)], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])

    def runs(self, size: int, seed: int = 1) -> np.ndarray:
        """A hash of the ``size`` words from each word on (nothing for the last ones)."""
        n = max(0, len(self.hash) - size + 1)
        out = np.zeros(n, np.uint64)
        rng = np.random.default_rng(seed)
        with np.errstate(over="ignore"):
            for j in range(size):
                out += self.hash[j : j + n] * np.uint64(int(rng.integers(1, 1 << 63)) * 2 + 1)
        return mix(out)

    def whole(self, size: int) -> np.ndarray:
        """Whether the ``size`` words from each word on lie in one text."""
        n = max(0, len(self.text) - size + 1)
        return self.text[:n] == self.text[size - 1 : size - 1 + n]


def sliding(values: np.ndarray, size: int, least: bool) -> np.ndarray:
    """The least (or greatest) of each ``size`` consecutive values, by doubling."""
    pick, now, span = np.minimum if least else np.maximum, values, 1
    while 2 * span <= size:
        now, span = pick(now[: len(now) - span], now[span:]), 2 * span
    rest = size - span
    return pick(now[: len(now) - rest], now[rest:]) if rest else now


def word_array(text: Column) -> Column:
    """The words of a text that isn't null, as a column expression."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
