"""Members that meet in a group, counted pair by pair: ``(o, p)`` to rows of a matrix.

Pairs are many times as many as members, so they are made and exchanged as packed bytes (some four for a pair) and
each range of rows is sorted and counted in the one task that it goes to.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are held before they are dealt out.
CHUNK = 1 << 20
#: Rows of a range at most.
RANGE_ROWS = 1 << 14


def _thin(x: np.ndarray) -> tuple[int, int, bytes]:
    """Whole numbers as what they have over their least, in planes of bytes without those that are 0 throughout."""
    low = int(x.min())
    y = (x - low).astype("<u8")
    width = max(1, -(-int(y.max()).bit_length() // 8))
    return low, width, y.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _wide(low: int, width: int, planes: bytes) -> np.ndarray:
    x = np.frombuffer(planes, np.uint8).reshape(width, -1)
    y = np.zeros((x.shape[1], 8), np.uint8)
    y[:, :width] = x.T
    return y.view("<i8")[:, 0] + low


def _paired(o: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs both ways of the different members of whole groups, in the order of (o, p); about ``CHUNK`` at a time."""
    new = np.append(True, (o[1:] != o[:-1]) | (p[1:] != p[:-1]))
    o, p = o[new], p[new]
    start = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
    size = np.diff(np.append(start, len(o)))
    first, each = np.repeat(start, size), np.repeat(size, size)
    end, lo = np.cumsum(each), 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(end, end[lo] - each[lo] + CHUNK, "right")))
        n = each[lo:hi]
        before = np.cumsum(n) - n
        i, j = np.repeat(p[lo:hi], n), p[np.arange(n.sum()) + np.repeat(first[lo:hi] - before, n)]
        yield i[i != j], j[i != j]
        lo = hi


def _dealt(per: int, ranges: int):
    """Packed pairs by range of rows, of members sorted by group."""

    def pack(held: list) -> Iterator[pa.RecordBatch]:
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(i)
        i, j = i[order], j[order]
        t = np.clip(i // per, 0, ranges - 1)
        cuts = np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t)).tolist()
        for s, e in zip(cuts, cuts[1:]):
            least, steps = int(i[s]), np.diff(i[s:e], prepend=i[s])
            row = [int(t[s]), least, *_thin(steps), *_thin(j[s:e])]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], _NAMES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = p = np.zeros(0, np.int64)
        held, size = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                o, p = (np.concatenate([x, b.column(k).to_numpy()]) for k, x in enumerate((o, p)))
                end = int(np.searchsorted(o, o[-1])) if len(o) else 0  # the last group may go on
            else:
                end = len(o)
            if end:
                for pair in _paired(o[:end], p[:end]):
                    held.append(pair)
                    size += len(pair[0])
                    if size >= CHUNK:
                        yield from pack(held)
                        held, size = [], 0
                o, p = o[end:], p[end:]
        if size:
            yield from pack(held)

    return deal


_NAMES = ["t", "i0", "s0", "sw", "steps", "j0", "jw", "cols"]


def meetings(pairs: DataFrame, n: int, blocks: bool, laplacian: bool) -> DataFrame:
    """In how many groups o the members p of ``pairs`` (o, p) meet, both ways.

    ``laplacian``: minus that off the diagonal, and on it the row's sum + 1 for every row below n. ``blocks``: whole rows as
    :func:`lattix.solvers.backend.packed_rows` gives them, else entries ``(i, j, v)``. Rows ascend with the tasks' numbers.
    """
    from lattix.solvers.backend import packed_block

    spark = pairs.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per = -(-max(n, 1) // max(tasks, -(-n // RANGE_ROWS)))
    ranges = -(-max(n, 1) // per)
    members = pairs.select(F.col("o").cast("long").alias("o"), F.col("p").cast("long").alias("p")).where("o is not null and p is not null")
    kinds = ("int", "long", "long", "int", "binary", "long", "int", "binary")
    dealt = members.repartition(tasks, "o").sortWithinPartitions("o", "p").mapInArrow(_dealt(per, ranges), ", ".join(f"{c} {k}" for c, k in zip(_NAMES, kinds, strict=True)))
    marks = spark.range(ranges).select(F.col("id").cast("int").alias("t"), *[F.lit(None).cast(k).alias(c) for c, k in zip(_NAMES[1:], kinds[1:], strict=True)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, got = None, []
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                t = row["t"]
                if row["i0"] is not None:
                    got.append((np.cumsum(_wide(row["s0"], row["sw"], row["steps"])) + row["i0"], _wide(row["j0"], row["jw"], row["cols"])))
        if t is None:
            return
        lo, hi = t * per, min(n, (t + 1) * per)
        if laplacian and hi > lo:
            got.append((np.arange(lo, hi), np.arange(lo, hi)))
        if not got:
            return
        i, j = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        least, low = int(i.min()), int(j.min())
        span = int(j.max()) - low + 1
        if (int(i.max()) - least + 1) * span < 1 << 62:
            key = (i - least) * span + (j - low)
            del i, j
            key.sort()
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(at, len(key))).astype(float)
            key = key[at]
            i, j = key // span + least, key % span + low
            del key
        else:
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            at = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            times = np.diff(np.append(at, len(i))).astype(float)
            i, j = i[at], j[at]
        first = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])), len(i))
        if laplacian:
            own = i == j
            sums = np.repeat(np.add.reduceat(np.where(own, 0.0, times), first[:-1]), np.diff(first))
            times = np.where(own, sums + 1.0, -times)
        s = 0
        while s < len(first) - 1:
            e = max(s + 1, int(np.searchsorted(first, first[s] + (1 << 18), "right")) - 1)
            part = slice(first[s], first[e])
            yield packed_block([i[part], j[part], times[part]], n) if blocks else pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (i, j, times)], ["i", "j", "v"])
            s = e

    schema = "rows binary, counts binary, cols binary, vals binary" if blocks else "i long, j long, v double"
    return dealt.union(marks).repartitionById(ranges, F.col("t")).mapInArrow(count, schema)


#: What stands for a null value among the bits of doubles, and for a null index.
_NULL = np.int64(0x7FF8DEADDEADDEAD)
_NOWHERE = -(1 << 63)


def differing(a: DataFrame, b: DataFrame, n: int, lo: int = 0, hi: int | None = None) -> DataFrame:
    """``(n)``: for each range of rows from lo to hi 1 if the entries ``(i, j, v)`` of both, or their bits, differ, else 0."""
    spark = a.sparkSession
    ranges = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per = max(1, -(-((n if hi is None else hi) - lo) // ranges))
    kinds = [("t", "int"), ("side", "int"), *[(f"{c}{k}", t) for c in "ijv" for k, t in (("0", "long"), ("w", "int"), ("", "binary"))]]
    schema = ", ".join(f"{c} {t}" for c, t in kinds)

    def deal(side: int):
        def pack(held: list) -> Iterator[pa.RecordBatch]:
            i, j, v = (np.concatenate(x) for x in zip(*held, strict=True))
            t = np.clip(i // per - lo // per, 0, ranges - 1)
            order = np.lexsort((i, t))
            i, j, v, t = i[order], j[order], v[order], t[order]
            cuts = np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t)).tolist()
            for s, e in zip(cuts, cuts[1:]):
                row = [int(t[s]), side, *_thin(i[s:e]), *_thin(j[s:e]), *_thin(v[s:e])]
                yield pa.RecordBatch.from_arrays([pa.array([x], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for x, (_, k) in zip(row, kinds, strict=True)], [c for c, _ in kinds])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                i, j, v = (batch.column(k) for k in range(3))
                bits = v.to_numpy(zero_copy_only=False).astype(float).view(np.int64)
                if v.null_count:
                    bits = np.where(v.is_null().to_numpy(zero_copy_only=False), _NULL, bits)
                held.append([i.to_numpy(), j.to_numpy(), bits])
                size += batch.num_rows
                if size >= CHUNK:
                    yield from pack(held)
                    held, size = [], 0
            if size:
                yield from pack(held)

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = ([], [])
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                got[row["side"]].append([_wide(row[f"{c}0"], row[f"{c}w"], row[c]) for c in "ijv"])
        if not got[0] and not got[1]:
            return
        same = bool(got[0]) == bool(got[1])
        if same:
            one, two = ([np.concatenate(x) for x in zip(*side, strict=True)] for side in got)
            same = len(one[0]) == len(two[0])
            if same:
                p, q = np.lexsort(one[::-1]), np.lexsort(two[::-1])
                same = all((x[p] == y[q]).all() for x, y in zip(one, two, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([0 if same else 1], pa.int64())], ["n"])

    sides = [d.select(F.coalesce("i", F.lit(_NOWHERE)).alias("i"), F.coalesce("j", F.lit(_NOWHERE)).alias("j"), "v").mapInArrow(deal(k), schema) for k, d in enumerate((a, b))]
    return sides[0].union(sides[1]).repartitionById(ranges, F.col("t")).mapInArrow(compare, "n long")
