"""Matrix and vector algebra as joins and sums.

Nothing here is forced to broadcast: Catalyst broadcasts a side whose measured size is below the
session's threshold and joins by exchange beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.schema import DimensionMismatch, SparseMatrix, full_vector


def products(a: SparseMatrix, x: DataFrame) -> DataFrame:
    """``(i, v)`` of A x for rows with entries."""
    return a.df.join(x.select(F.col("i").alias("j"), F.col("v").alias("xv")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("xv")).alias("v"))


def spmv(a: SparseMatrix, x: DataFrame) -> DataFrame:
    """y = A x, one row for each row of A; duplicates of a position add up."""
    return full_vector(products(a, x), a.nrows)


def spmv_transposed(a: SparseMatrix, x: DataFrame) -> DataFrame:
    return spmv(transpose(a), x)


def spmv_partitioned(a: SparseMatrix, x: DataFrame, tasks: int) -> DataFrame:
    """SpMV with rows dealt to ``tasks`` ranges, so each row is summed where it lies."""
    return spmv(SparseMatrix(a.df.repartitionByRange(tasks, "i"), a.nrows, a.ncols), x)


def spmv_by_owner(a: SparseMatrix, owners: DataFrame, x: DataFrame) -> DataFrame:
    """SpMV with rows placed by their owner; any assignment of ``(i, owner)`` gives the serial result."""
    placed = a.df.join(owners, "i").repartition("owner").select("i", "j", "v")
    return spmv(SparseMatrix(placed, a.nrows, a.ncols), x)


def spgemm(a: SparseMatrix, b: SparseMatrix) -> SparseMatrix:
    """A B by joining on the shared index."""
    if a.ncols != b.nrows:
        raise DimensionMismatch(f"{a.nrows} x {a.ncols} times {b.nrows} x {b.ncols}")
    right = b.df.select(F.col("i").alias("k"), F.col("j").alias("bj"), F.col("v").alias("bv"))
    out = a.df.select("i", F.col("j").alias("k"), "v").join(right, "k").groupBy("i", "bj").agg(F.sum(F.col("v") * F.col("bv")).alias("v"))
    return SparseMatrix(out.select("i", F.col("bj").alias("j"), "v"), a.nrows, b.ncols)


def transpose(a: SparseMatrix) -> SparseMatrix:
    return SparseMatrix(a.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a.ncols, a.nrows)


def permute(a: SparseMatrix, order: DataFrame) -> SparseMatrix:
    """P A Pᵀ by ``order`` of (old, new)."""
    rows = order.select(F.col("old").alias("i"), F.col("new").alias("ni"))
    cols = order.select(F.col("old").alias("j"), F.col("new").alias("nj"))
    return SparseMatrix(a.df.join(rows, "i").join(cols, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v"), a.nrows, a.ncols)


def permute_vector(x: DataFrame, order: DataFrame) -> DataFrame:
    return x.join(order.select(F.col("old").alias("i"), "new"), "i").select(F.col("new").alias("i"), "v")


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row ``dot``; indices that one side lacks count as 0."""
    return x.join(y.select("i", F.col("v").alias("w")), "i").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("dot"))


def norms(x: DataFrame) -> DataFrame:
    """One row of ``l1``, ``l2`` and ``linf``."""
    return x.agg(F.coalesce(F.sum(F.abs("v")), F.lit(0.0)).alias("l1"), F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("l2"), F.coalesce(F.max(F.abs("v")), F.lit(0.0)).alias("linf"))


def axpy(alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """alpha x + y over the indices of either."""
    return x.select("i", (F.lit(alpha) * F.col("v")).alias("v")).unionByName(y.select("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))


def residual(a: SparseMatrix, x: DataFrame, b: DataFrame) -> DataFrame:
    """b - A x."""
    return full_vector(axpy(-1.0, products(a, x), b), a.nrows)


def relative_residual(a: SparseMatrix, x: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``relative_residual``: ‖b - A x‖ / ‖b‖, the plain norm if b is zero."""
    both = residual(a, x, b).select(F.col("v").alias("r"), F.lit(0.0).alias("b")).union(b.select(F.lit(0.0).alias("r"), F.col("v").alias("b")))
    sums = both.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("r"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("b"))
    return sums.select(F.when(F.col("b") > 0, F.col("r") / F.col("b")).otherwise(F.col("r")).alias("relative_residual"))


def galerkin(a: SparseMatrix, transfer: SparseMatrix) -> SparseMatrix:
    """Pᵀ A P by two joins on the transfer and one sum."""
    left = transfer.df.select("i", F.col("j").alias("ci"), F.col("v").alias("pi"))
    right = transfer.df.select(F.col("i").alias("j"), F.col("j").alias("cj"), F.col("v").alias("pj"))
    out = a.df.join(left, "i").join(right, "j").groupBy("ci", "cj").agg(F.sum(F.col("pi") * F.col("v") * F.col("pj")).alias("v"))
    return SparseMatrix(out.select(F.col("ci").alias("i"), F.col("cj").alias("j"), "v"), transfer.ncols, transfer.ncols)


def galerkin_piecewise(a: SparseMatrix, aggregate: DataFrame, count: int) -> SparseMatrix:
    """Zᵀ A Z for piecewise constants: ``aggregate`` is (i, c)."""
    rows, cols = aggregate.select("i", F.col("c").alias("ci")), aggregate.select(F.col("i").alias("j"), F.col("c").alias("cj"))
    out = a.df.join(rows, "i").join(cols, "j").groupBy("ci", "cj").agg(F.sum("v").alias("v"))
    return SparseMatrix(out.select(F.col("ci").alias("i"), F.col("cj").alias("j"), "v"), count, count)


def restrict(transfer: SparseMatrix, r: DataFrame) -> DataFrame:
    return spmv(transpose(transfer), r)


def prolong(transfer: SparseMatrix, coarse: DataFrame) -> DataFrame:
    return spmv(transfer, coarse)


def schur_blocks(a: SparseMatrix, interface: DataFrame) -> DataFrame:
    """Entries with their block ``II``, ``IG``, ``GI`` or ``GG``; ``interface`` is a mask."""
    rows = interface.select("i", F.lit("G").alias("gi")).distinct()
    cols = interface.select(F.col("i").alias("j"), F.lit("G").alias("gj")).distinct()
    marked = a.df.join(rows, "i", "left").join(cols, "j", "left")
    return marked.select("i", "j", "v", F.concat(F.coalesce("gi", F.lit("I")), F.coalesce("gj", F.lit("I"))).alias("block"))
