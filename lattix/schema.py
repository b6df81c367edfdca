"""Table schemas, errors and the sparse matrix handle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATRIX = "i bigint, j bigint, v double"
VECTOR = "i bigint, v double"
MASK = "i bigint"
TOPOLOGY = "i bigint, w bigint, mask bigint"
COORDS = "node bigint, x double, y double, z double"
LAYOUT = "block_index int, entity_kind int, entity_id bigint, field_id int, components int"


class LattixError(ValueError):
    """Base of all errors that callers may handle."""


class DimensionMismatch(LattixError):
    """Two tables describe spaces of different size."""


class InvalidMatrix(LattixError):
    """Entries out of range or not finite."""


class InvalidArgument(LattixError):
    """An option or argument out of its domain."""


class MissingDiagonal(LattixError):
    """A row has no (or a zero) diagonal entry where one is needed."""


class NumericalBreakdown(LattixError):
    """A pivot or inner product lost its sign or vanished."""


class UnsupportedProblem(LattixError):
    """The declared problem class rules the operation out."""


class FormatError(LattixError):
    """An input file breaks its format."""


@dataclass(frozen=True)
class SparseMatrix:
    """Coordinates ``(i, j, v)`` and dimensions; rows without entries exist only by ``nrows``.

    ``blocks`` may hold the same entries as whole rows, packed and canonical (:func:`lattix.solvers.backend.packed_rows`).
    """

    df: DataFrame
    nrows: int
    ncols: int
    blocks: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def square(self) -> bool:
        return self.nrows == self.ncols

    def rows(self) -> DataFrame:
        """Every row index, ``(i)``."""
        return self.spark.range(self.nrows).select(F.col("id").alias("i"))

    def pattern(self) -> DataFrame:
        """Distinct stored positions; explicit zeros are structure."""
        return self.df.select("i", "j").distinct()

    def canonical(self, drop_zeros: bool = True) -> SparseMatrix:
        """One entry for each position: duplicates summed, exact zeros then dropped unless they are wanted as structure."""
        out = self.df.groupBy("i", "j").agg(F.sum("v").alias("v"))
        return SparseMatrix(out.where("v <> 0") if drop_zeros else out, self.nrows, self.ncols)

    def validate(self) -> SparseMatrix:
        """Raise :class:`InvalidMatrix` if an entry is out of range, null or not finite."""
        bad = self.df.where(
            F.col("i").isNull() | F.col("j").isNull() | F.col("v").isNull() | (F.col("i") < 0) | (F.col("i") >= self.nrows) | (F.col("j") < 0) | (F.col("j") >= self.ncols) | F.isnan("v") | (F.abs("v") == float("inf"))
        ).take(1)
        if bad:
            raise InvalidMatrix(f"entry {tuple(bad[0])} is not a finite entry of a {self.nrows} x {self.ncols} matrix")
        return self

    def need_square(self) -> SparseMatrix:
        if not self.square:
            raise DimensionMismatch(f"a square matrix is needed, not {self.nrows} x {self.ncols}")
        return self


def full_vector(df: DataFrame, n: int) -> DataFrame:
    """``(i, v)`` with a row for each of n indices, 0 where ``df`` has none."""
    every = df.sparkSession.range(n).select(F.col("id").alias("i"))
    return every.join(df.groupBy("i").agg(F.sum("v").alias("v")), "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))
