"""Vectorised byte kernels: word bounds and 64-bit word hashes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _byte_values(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def __reduce__(self):
        return Powers, (self.base,)  # the arrays are made anew where they are needed

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.up, self.down = powers(self.base, self.n), powers(self.inverse, self.n)
        return self.up, self.down


_bytes, _words = Powers(_BASE), Powers(_WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of the input reach all bits of the output."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_table(kind: str) -> np.ndarray:
    """Which byte values belong to words. ``space``: all but 0x20 and 0x09-0x0D. ``alnum``: 0-9, A-Z, a-z and all above 0x7F."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
            table[lo : hi + 1] = True
    return table


class Words:
    """Words of a slice of texts: byte bounds, owning text and hash, in text order."""

    def __init__(self, texts: pa.Array, kind: str = "space", lower: bool = True):
        n = len(texts)
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.n, self.bounds = n, bounds - bounds[0]
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
        self.raw = raw
        inside = word_table(kind)[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        starts_at, filled = self.bounds[:-1], self.bounds[1:] > self.bounds[:-1]
        first[starts_at[filled]] = inside[starts_at[filled]]
        ends_at = self.bounds[1:][filled] - 1
        last[ends_at] = inside[ends_at]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.bounds, self.start, "right") - 1
        #: words of text d are first[d] up to first[d + 1]
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        up, down = _bytes.upto(len(raw) + 1)
        run = np.zeros(len(raw) + 1, U64)
        np.cumsum(_byte_values()[raw] * up[: len(raw)], out=run[1:])
        self.hash = mix((run[self.end] - run[self.start]) * down[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, a: int, b: int) -> bytes:
        """Words a up to b, joined by one blank."""
        return b" ".join(self.raw[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))

    def runs(self) -> np.ndarray:
        """Prefix sums for :meth:`window`."""
        up, _ = _words.upto(len(self.hash) + 1)
        out = np.zeros(len(self.hash) + 1, U64)
        np.cumsum(self.hash * up[: len(self.hash)], out=out[1:])
        return out

    @staticmethod
    def window(runs: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of ``length`` consecutive words from ``start``."""
        _, down = _words.upto(len(runs) + 1)
        return mix((runs[start + length] - runs[start]) * down[start])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(owning text, hash)`` of all runs of k words; a text of fewer words, but not none, is one shingle."""
        n, total = self.counts(), len(self.hash)
        runs = self.runs()
        at = np.arange(total)
        whole = at + k <= self.first[self.doc + 1] if total else np.zeros(0, bool)
        long_at = at[whole]
        short = np.flatnonzero((n > 0) & (n < k))
        owner = np.concatenate([self.doc[long_at], short])
        hashes = np.concatenate([self.window(runs, long_at, k), self.window(runs, self.first[short], n[short]) ^ U64(0x5851F42D4C957F2D)])
        return owner, hashes
