"""Where products run: on the driver, in distributed blocks with the vector broadcast, or as DataFrames.

The choice is by measured size. Up to ``LOCAL_NNZ`` entries the matrix fits the driver. Up to
``BLOCK_ROWS`` rows a vector is small enough to send to all tasks while the matrix stays
distributed. Beyond that vectors are tables and every product is a join.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.plans.storage import materialize
from lattix.schema import DimensionMismatch, SparseMatrix
from lattix.solvers.options import Execution

LOCAL_NNZ, BLOCK_ROWS = 4_000_000, 8_000_000


def choose(a: SparseMatrix, nnz: int) -> Execution:
    return Execution.LOCAL if nnz <= LOCAL_NNZ else Execution.BLOCKS if max(a.nrows, a.ncols) <= BLOCK_ROWS else Execution.DATAFRAME


class LocalMatrix:
    """Canonical entries on the driver, sorted by row then column."""

    def __init__(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, nrows: int, ncols: int):
        order = np.lexsort((j, i))
        i, j, v = i[order], j[order], v[order]
        first = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])) if len(i) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        self.i, self.j = i[at], j[at]
        self.v = np.add.reduceat(v, at) if len(at) else v
        self.nrows, self.ncols = nrows, ncols
        self.ptr = np.searchsorted(self.i, np.arange(nrows + 1))

    @classmethod
    def collect(cls, a: SparseMatrix, limit: int = LOCAL_NNZ) -> LocalMatrix:
        """Bring a matrix of at most ``limit`` stored entries to the driver."""
        got = a.df.select("i", "j", "v").limit(limit + 1).toArrow()
        if got.num_rows > limit:
            raise DimensionMismatch(f"more than {limit} entries don't go to the driver; use a distributed backend")
        i, j, v = (got.column(c).to_numpy() for c in ("i", "j", "v"))
        return cls(i.astype(np.int64), j.astype(np.int64), v.astype(np.float64), a.nrows, a.ncols)

    def to_df(self, spark: SparkSession) -> SparseMatrix:
        return SparseMatrix(spark.createDataFrame(pa.table({"i": self.i, "j": self.j, "v": self.v})), self.nrows, self.ncols)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.i, self.v * x[self.j], self.nrows)

    def transposed(self) -> LocalMatrix:
        return LocalMatrix(self.j, self.i, self.v, self.ncols, self.nrows)

    def diagonal(self) -> np.ndarray:
        own = self.i == self.j
        return np.bincount(self.i[own], self.v[own], self.nrows)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.ptr[i], self.ptr[i + 1])
        return self.j[s], self.v[s]

    def dense(self, rows: np.ndarray | None = None) -> np.ndarray:
        """The dense matrix, or that of a region in ascending order."""
        if rows is None:
            out = np.zeros((self.nrows, self.ncols))
            out[self.i, self.j] = self.v
            return out
        local = np.full(self.ncols, -1)
        local[rows] = np.arange(len(rows))
        out = np.zeros((len(rows), len(rows)))
        for k, r in enumerate(rows):
            cols, vals = self.row(int(r))
            at = local[cols]
            out[k, at[at >= 0]] = vals[at >= 0]
        return out

    def neighbours(self) -> list[np.ndarray]:
        """Sorted neighbours of each node in A ∪ Aᵀ, without itself."""
        i, j = np.concatenate([self.i, self.j]), np.concatenate([self.j, self.i])
        keep = i != j
        key = np.unique(i[keep] * self.ncols + j[keep])
        i, j = key // self.ncols, key % self.ncols
        ptr = np.searchsorted(i, np.arange(self.nrows + 1))
        return [j[ptr[k] : ptr[k + 1]] for k in range(self.nrows)]


#: Entries of a packed block, unless one row has more.
BLOCK_ENTRIES = 1 << 18


def packed_block(parts: list[np.ndarray], ncols: int) -> pa.RecordBatch:
    """One block of entries ``i, j[, v]`` of whole rows in the order of (i, j), duplicates added up."""
    i, j, *v = parts
    new = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
    at = np.flatnonzero(new)
    i, j = i[at], j[at]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    if ncols < 1 << 31 and (j.max() >= 1 << 31 or j.min() < -1 << 31):
        raise DimensionMismatch(f"a column lies far outside of {ncols}")
    out = [i[first], np.diff(np.append(first, len(i))).astype(np.int32), j.astype(np.int32 if ncols < 1 << 31 else np.int64)]
    if v:
        out.append(v[0] if len(at) == len(new) else np.add.reduceat(v[0], at))
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in out], _BLOCK[: len(out)])


def packed_rows(entries: DataFrame, n: int, ncols: int, values: bool = True, tasks: int | None = None) -> DataFrame:
    """Blocks ``(rows, counts, cols[, vals])`` of whole rows, as bytes, of entries ``(i, j[, v])`` with i below n and j below ncols.

    A block has about ``BLOCK_ENTRIES`` entries, in the order of (i, j), duplicates added up. Each task has a range of rows and
    ranges ascend with the tasks' numbers. A worker holds one block and one row at a time, whatever the matrix' size.
    """
    spark = entries.sparkSession
    tasks = tasks or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = ["i", "j", "v"] if values else ["i", "j"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))])
            size += b.num_rows
            if size >= BLOCK_ENTRIES:
                parts = [np.concatenate(p) for p in zip(*held, strict=True)]
                end = int(np.searchsorted(parts[0], parts[0][-1]))  # the last row may go on
                if end:
                    yield packed_block([p[:end] for p in parts], ncols)
                held, size = [[p[end:] for p in parts]], len(parts[0]) - end
        if size:
            yield packed_block([np.concatenate(p) for p in zip(*held, strict=True)], ncols)

    target = F.least(F.floor(F.col("i") * tasks / max(n, 1)), F.lit(tasks - 1)).cast("int")
    dealt = entries.select(*names).repartitionById(tasks, target).sortWithinPartitions("i", "j")
    return dealt.mapInArrow(pack, ", ".join(f"{c} binary" for c in _BLOCK[: len(names) + 1]))


_BLOCK = ["rows", "counts", "cols", "vals"]


def unpacked_rows(row, ncols: int) -> list[np.ndarray]:
    """Row numbers, their counts, columns and, if there are any, values of a block.

    A block with ``copies`` c stands for the Kronecker product of its entries with the identity of c rows.
    """
    c = row["copies"] if "copies" in row else 1
    kinds = (np.int64, np.int32, np.int32 if ncols // c < 1 << 31 else np.int64, np.float64)
    parts = [np.frombuffer(row[name], kind) for name, kind in zip(_BLOCK, kinds, strict=True) if name in row]
    return parts if c == 1 else with_copies(parts, c, ncols)


def with_copies(parts: list[np.ndarray], c: int, ncols: int) -> list[np.ndarray]:
    """The block that stands for c copies of another, of ``ncols`` columns."""
    rows, counts, cols, *vals = parts
    each, start = np.repeat(counts, c), np.repeat(np.cumsum(counts) - counts, c)
    at, kind = spans(start, each), np.int32 if ncols < 1 << 31 else np.int64
    cols = cols[at].astype(kind) * kind(c) + np.repeat(np.tile(np.arange(c, dtype=kind), len(rows)), each)
    return [copied(rows, c), each, cols, *[v[at] for v in vals]]


def copied(rows: np.ndarray, c: int) -> np.ndarray:
    """The c rows that stand for each row of a block with copies."""
    return (rows[:, None] * c + np.arange(c)).ravel()


def spans(start: np.ndarray, each: np.ndarray) -> np.ndarray:
    """All places of spans of ``each`` places from ``start`` on, one span after the other."""
    end = np.cumsum(each)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - each), each)


def kron_identity(a: SparseMatrix, c: int) -> SparseMatrix:
    """The Kronecker product of A with the identity of c rows: A's packed blocks, which stand for c copies; none is written."""
    blocks = packed_rows(a.df, a.nrows, a.ncols) if a.blocks is None else a.blocks
    out = blocks.withColumn("copies", F.col("copies") * c if "copies" in blocks.columns else F.lit(c))
    if hasattr(blocks, "_stored_at"):
        out._stored_at = blocks._stored_at
    return SparseMatrix(entries_of(out, a.ncols * c), a.nrows * c, a.ncols * c, out)


def entries_of(blocks: DataFrame, ncols: int) -> DataFrame:
    """Entries ``(i, j, v)`` of packed blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, counts, cols, vals = unpacked_rows(batch.slice(k, 1).to_pylist()[0], ncols)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, counts)), pa.array(cols.astype(np.int64)), pa.array(vals)], ["i", "j", "v"])

    return blocks.mapInArrow(read, "i long, j long, v double")


class DiskRows:
    """Rows of a matrix, or sorted neighbours of n nodes, in a file in the driver's temporary folder.

    The entries arrive range by range; only a pointer and a count for each row stay in memory. ``near[k]`` are the columns of a row.
    """

    def __init__(self, entries: DataFrame, n: int, values: bool = False):
        self.nrows = self.ncols = n
        kinds = [np.int32 if n < 1 << 31 else np.int64, np.float64][: 1 + values]
        files = [tempfile.TemporaryFile() for _ in kinds]
        self.degree = np.zeros(n, np.int64)
        for row in packed_rows(entries, n, n, values).toLocalIterator():
            rows, counts, *rest = unpacked_rows(row, n)
            self.degree[rows] = counts
            for f, x in zip(files, rest, strict=True):
                f.write(x.tobytes())
        self.ptr = np.append(0, np.cumsum(self.degree))
        for f in files:
            f.flush()
        held = [np.asarray(np.memmap(f, kind, "r")) if self.ptr[-1] else np.zeros(0, kind) for f, kind in zip(files, kinds, strict=True)]
        self.cols, self.vals = held[0], held[1] if values else None

    def __len__(self) -> int:
        return self.nrows

    def __getitem__(self, k: int) -> np.ndarray:
        if not 0 <= k < self.nrows:
            raise IndexError(k)
        return self.cols[self.ptr[k] : self.ptr[k + 1]]

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Columns of several rows, one row after the other."""
        return self.cols[spans(self.ptr[rows], self.degree[rows])]

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray | None]:
        s = slice(self.ptr[k], self.ptr[k + 1])
        return self.cols[s], None if self.vals is None else self.vals[s]

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Entries ``(i, j, v)`` of whole rows, about a million at a time."""
        lo = 0
        while lo < self.nrows:
            hi = max(lo + 1, int(np.searchsorted(self.ptr, self.ptr[lo] + (1 << 20), "right")) - 1)
            s = slice(self.ptr[lo], self.ptr[hi])
            yield np.repeat(np.arange(lo, hi), self.degree[lo:hi]), self.cols[s], None if self.vals is None else self.vals[s]
            lo = hi

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(self.nrows)
        for i, j, v in self.chunks():
            if len(i):
                out[i[0] : i[-1] + 1] = np.bincount(i - i[0], v * x[j])
        return out

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """The dense matrix of a region in ascending order."""
        out = np.zeros((len(rows), len(rows)))
        for k, r in enumerate(rows):
            cols, vals = self.row(int(r))
            at = np.minimum(np.searchsorted(rows, cols), len(rows) - 1)
            inside = rows[at] == cols
            out[k, at[inside]] = vals[inside]
        return out


def _multiply(sent, ncols: int):
    """Rows and products of packed blocks with the vector that was sent; a run of rows is told by its ends."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, parts = sent.value, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                c = row.pop("copies", 1)
                if c not in parts:  # each copy has its own part of x
                    parts[c] = [np.ascontiguousarray(full[at::c]) for at in range(c)]
                rows, counts, cols, vals = unpacked_rows(row, ncols // c)
                start = np.cumsum(counts) - counts
                y = np.stack([np.add.reduceat(vals * part[cols], start) for part in parts[c]], 1)
                rows = copied(rows, c)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (run_of(rows), y)], ["rows", "y"])

    return multiply


def run_of(rows: np.ndarray) -> np.ndarray:
    """Ascending rows, by their ends and -1 if they follow each other without a gap."""
    return np.array([rows[0], rows[-1], -1]) if rows[-1] - rows[0] == len(rows) - 1 else rows


def rows_of(told) -> slice | np.ndarray:
    rows = np.frombuffer(told, np.int64)
    return slice(rows[0], rows[1] + 1) if rows[-1] == -1 else rows


def product_table(a: SparseMatrix, x: np.ndarray) -> DataFrame:
    """``(i, v)`` of A x for rows of packed blocks, made where they are each time it is read."""
    sent = a.spark.sparkContext.broadcast(np.asarray(x, np.float64))
    multiply = _multiply(sent, a.ncols)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in multiply(batches):
            rows, y = (batch.column(k)[0].as_buffer() for k in range(2))
            rows = rows_of(rows)
            i = np.arange(rows.start, rows.stop) if isinstance(rows, slice) else rows
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.frombuffer(y, np.float64))], ["i", "v"])

    return a.blocks.mapInArrow(table, "i long, v double")


class BlockedMatrix:
    """Row ranges packed into Arrow rows of bounded size; a product broadcasts x and brings back y."""

    def __init__(self, a: SparseMatrix, tasks: int | None = None):
        """``tasks`` ranges of rows, else as many as the session's shuffles have."""
        self.nrows, self.ncols, self.spark = a.nrows, a.ncols, a.spark
        packed = a.blocks if tasks is None and a.blocks is not None else packed_rows(a.df, a.nrows, a.ncols, tasks=tasks)
        self.packed = packed if hasattr(packed, "_stored_at") else materialize(packed, "blocks")

    def __call__(self, x: np.ndarray) -> np.ndarray:
        sent = self.spark.sparkContext.broadcast(np.asarray(x, np.float64))
        out = np.zeros(self.nrows)
        got = self.packed.mapInArrow(_multiply(sent, self.ncols), "rows binary, y binary").toArrow()
        for rows, y in zip(got.column("rows"), got.column("y"), strict=True):
            out[rows_of(rows.as_buffer())] += np.frombuffer(y.as_buffer(), np.float64)
        del got
        pa.default_memory_pool().release_unused()
        sent.destroy()
        return out

    def diagonal(self) -> np.ndarray:
        ncols = self.ncols

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    rows, counts, cols, vals = unpacked_rows(batch.slice(k, 1).to_pylist()[0], ncols)
                    i = np.repeat(rows, counts)
                    yield pa.RecordBatch.from_arrays([pa.array(i[i == cols]), pa.array(vals[i == cols])], ["i", "v"])

        return to_array(self.packed.mapInArrow(own, "i long, v double"), self.nrows)


def stored_entries(a: SparseMatrix) -> int:
    """How many entries a matrix stores; blocks tell by their size."""
    if a.blocks is None:
        return a.df.count()
    size = F.octet_length("vals").cast("long") * (F.col("copies") if "copies" in a.blocks.columns else 1)
    return a.blocks.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] // 8


def product_of(a: SparseMatrix) -> LocalMatrix | BlockedMatrix:
    """The product with arrays: on the driver if the stored entries allow it, else in blocks."""
    few = (a.df.limit(LOCAL_NNZ + 1).count() if a.blocks is None else stored_entries(a)) <= LOCAL_NNZ
    return LocalMatrix.collect(a) if few else BlockedMatrix(a)


def to_array(x: DataFrame, n: int) -> np.ndarray:
    """A vector table of a known, bounded size as an array; absent indices are 0."""
    got = x.groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(n)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    del got
    pa.default_memory_pool().release_unused()
    return out


def to_vector(spark: SparkSession, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"i": np.arange(len(x), dtype=np.int64), "v": np.asarray(x, np.float64)}))
