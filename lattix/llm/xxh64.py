"""XXH64 of many byte ranges of one buffer at once."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
#: The primes of XXH64: fixed values.
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Ranges of one length are hashed together; longer ones, and those of which there are few, one by one.
LONGEST, FEWEST = 256, 16
#: Ranges that start within this many bytes are worked on at a time, which bounds memory.
SPAN = 1 << 21


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def _round(state, lane: np.ndarray) -> np.ndarray:
    return _turn(lane * P2 + state, 31) * P1


def _same_length(lanes: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the ranges of ``size`` bytes from ``at``; ``lanes[p]`` is the eight bytes from p on."""
    p = 0
    if size >= 32:
        start = [(seed + int(P1) + int(P2)) % 2**64, (seed + int(P2)) % 2**64, seed, (seed - int(P1)) % 2**64]
        state = [np.full(len(at), s, U64) for s in start]
        while size - p >= 32:
            state = [_round(s, lanes[at + (p + 8 * k)]) for k, s in enumerate(state)]
            p += 32
        h = _turn(state[0], 1) + _turn(state[1], 7) + _turn(state[2], 12) + _turn(state[3], 18)
        for s in state:
            h = (h ^ _round(U64(0), s)) * P1 + P4
        h += U64(size)
    else:
        h = np.full(len(at), (seed + int(P5) + size) % 2**64, U64)
    while size - p >= 8:
        h = _turn(h ^ _round(U64(0), lanes[at + p]), 27) * P1 + P4
        p += 8
    if size - p:
        tail = lanes[at + p]  # the buffer is padded, and only bytes of the range are used
        if size - p >= 4:
            h = _turn(h ^ ((tail & U64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            tail = tail >> U64(32)
            p += 4
        while p < size:
            h = _turn(h ^ ((tail & U64(0xFF)) * P5), 11) * P1
            tail = tail >> U64(8)
            p += 1
    h = (h ^ (h >> U64(33))) * P2
    h = (h ^ (h >> U64(29))) * P3
    return h ^ (h >> U64(32))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of ``data[start[k]:end[k]]`` for every k; ``start`` ascends."""
    out = np.empty(len(start), U64)
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(LONGEST + 16, np.uint8)])
    cuts = np.searchsorted(start, np.arange(0, int(start[-1]) + 1, SPAN)).tolist() + [len(start)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        low = int(start[a])
        held = min(int(start[b - 1]) - low + LONGEST + 8, len(padded) - 8 - low)
        lanes = np.ndarray((held,), "<u8", padded, low, (1,)).copy()
        at, size = start[a:b] - low, end[a:b] - start[a:b]
        order = np.argsort(np.minimum(size, LONGEST + 1).astype(np.uint16), kind="stable")
        at, size = at[order], size[order]
        edges = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]
        hashes = np.empty(b - a, U64)
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            n = int(size[s])
            if n > LONGEST or e - s < FEWEST:
                hashes[s:e] = [xxhash.xxh64_intdigest(padded[p : p + n], seed) for p in (at[s:e] + low).tolist()]
            else:
                hashes[s:e] = _same_length(lanes, at[s:e], n, seed)
        out[a + order] = hashes
    return out
