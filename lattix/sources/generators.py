"""Test and benchmark matrices by rule."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattix.operators.topology import undirected
from lattix.schema import InvalidArgument, SparseMatrix


def chain(spark: SparkSession, n: int, diagonal: float = 2.0, off: float = -1.0) -> SparseMatrix:
    """Tridiagonal matrix."""
    near = F.filter(F.array(F.col("id") - 1, F.col("id"), F.col("id") + 1), lambda j: (j >= 0) & (j < n))
    rows = spark.range(n).select(F.col("id").alias("i"), F.explode(near).alias("j"))
    return SparseMatrix(rows.withColumn("v", F.when(F.col("i") == F.col("j"), diagonal).otherwise(off)), n, n)


def poisson_1d(spark: SparkSession, n: int) -> SparseMatrix:
    return chain(spark, n)


def block_diagonal(spark: SparkSession, easy: int, hard: list[int], gap: int = 0) -> SparseMatrix:
    """Unit rows, with tridiagonal hard blocks after ``easy`` of them and ``gap`` unit rows between blocks."""
    edges, at = [], easy
    for size in hard:
        edges += [(k, k + 1) for k in range(at, at + size - 1)]
        at += size + gap
    n = max(at - (gap if hard else 0), easy)
    inside = {k for e in edges for k in e}
    rows = [(k, k, 2.0 if k in inside else 1.0) for k in range(n)] + [(a, b, -1.0) for a, b in edges] + [(b, a, -1.0) for a, b in edges]
    return SparseMatrix(spark.createDataFrame(rows, "i bigint, j bigint, v double"), n, n)


def grid7(spark: SparkSession, nx: int, ny: int, nz: int) -> SparseMatrix:
    """3-D seven-point grid with diagonal degree + 1, made without any exchange."""
    if min(nx, ny, nz) < 1:
        raise InvalidArgument("a grid needs at least one node each way")
    n = nx * ny * nz
    x, y, z = F.col("id") % nx, F.floor(F.col("id") / nx) % ny, F.floor(F.col("id") / (nx * ny))
    steps = [(x > 0, -1), (x < nx - 1, 1), (y > 0, -nx), (y < ny - 1, nx), (z > 0, -nx * ny), (z < nz - 1, nx * ny)]
    near = F.filter(F.array(*[F.when(ok, F.col("id") + d) for ok, d in steps]), lambda j: j.isNotNull())
    rows = spark.range(n).select(F.col("id").alias("i"), near.alias("near"))
    diagonal = F.struct(F.col("i").alias("j"), (F.size("near") + 1).cast("double").alias("v"))
    entries = F.concat(F.array(diagonal), F.transform("near", lambda j: F.struct(j.alias("j"), F.lit(-1.0).alias("v"))))
    return SparseMatrix(rows.select("i", F.explode(entries).alias("e")).select("i", "e.j", "e.v"), n, n)


def spd_surrogate(a: SparseMatrix, shift: float = 1.0) -> SparseMatrix:
    """SPD matrix on the symmetrised pattern: -1/√((deg_i + 1)(deg_j + 1)) off the diagonal, Σ|off| + ``shift`` on it."""
    if shift <= 0:
        raise InvalidArgument("the shift must be positive")
    pairs = undirected(a.need_square().df)
    degree = pairs.groupBy("i").agg(F.count("*").alias("d"))
    off = pairs.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("e")), "j").select("i", "j", (-1 / F.sqrt((F.col("d") + 1) * (F.col("e") + 1))).alias("v"))
    sums = off.groupBy("i").agg((-F.sum("v")).alias("s"))
    diag = a.rows().join(sums, "i", "left").select("i", F.col("i").alias("j"), (F.coalesce("s", F.lit(0.0)) + shift).alias("v"))
    return SparseMatrix(off.union(diag), a.nrows, a.ncols)
