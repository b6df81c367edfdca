"""Spark's XXH64 of whole numbers and doubles, in NumPy."""

from __future__ import annotations

import numpy as np

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Spark's seed.
SEED = np.uint64(42)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhash64(x: np.ndarray, seed: np.ndarray | np.uint64 = SEED) -> np.ndarray:
    """Hashes of 64-bit numbers (a double by its bits, -0.0 as 0.0), as ``xxhash64(seed's columns, x)`` gives them."""
    x = (x + 0.0).view(np.uint64) if x.dtype.kind == "f" else x.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (seed + _P5 + np.uint64(8)) ^ (_turned(x * _P2, 31) * _P1)
        h = _turned(h, 27) * _P1 + _P4
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def mixed(x: np.ndarray, by: int) -> np.ndarray:
    """A number of 64 bits for each whole number; another function for each odd ``by``."""
    y = x.astype(np.int64).view(np.uint64) * np.uint64(by) + _P5
    y ^= y >> np.uint64(29)
    y *= _P3
    y ^= y >> np.uint64(32)
    return y
