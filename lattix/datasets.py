"""Matrices and vectors derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.operators.meetings import meetings
from lattix.schema import SparseMatrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _size(spark: SparkSession, sf_dir: str, name: str, key: str) -> int:
    """One more than the largest key: a read of one column's footer statistics."""
    return (table(spark, sf_dir, name).agg(F.max(key).alias("m")).first().m or -1) + 1


def laplacian(pairs: DataFrame, n: int) -> SparseMatrix:
    """Σ + I on the diagonal and -count off it, of ``pairs`` (o, p): members p that meet in a group o.

    Groups are small (lines of an order), so pairing a group with itself stays linear in its rows.
    """
    return SparseMatrix(meetings(pairs, n, False, True), n, n, meetings(pairs, n, True, True))


def part_graph(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Parts that meet in an order; symmetric, strictly dominant, hence SPD."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    return laplacian(lines, _size(spark, sf_dir, "part", "p_partkey"))


def supp_graph(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Suppliers that meet in an order; small and nearly dense."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("p"))
    return laplacian(lines, _size(spark, sf_dir, "supplier", "s_suppkey"))


def order_part(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Quantities by order and part, duplicates not yet summed."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return SparseMatrix(lines, _size(spark, sf_dir, "orders", "o_orderkey"), _size(spark, sf_dir, "part", "p_partkey"))


def part_supp(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Number of lines by part and supplier."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.count("*").cast("double").alias("v"))
    return SparseMatrix(lines, _size(spark, sf_dir, "part", "p_partkey"), _size(spark, sf_dir, "supplier", "s_suppkey"))


def convection(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """A nonsymmetric matrix: the part graph with entries above the diagonal halved."""
    a = part_graph(spark, sf_dir)
    return SparseMatrix(a.df.withColumn("v", F.when(F.col("j") > F.col("i"), F.col("v") / 2).otherwise(F.col("v"))), a.nrows, a.ncols)


def probe(spark: SparkSession, n: int) -> DataFrame:
    """The vector 1 + ((17 i + 11) mod 101)."""
    return spark.range(n).select(F.col("id").alias("i"), (1 + (F.col("id") * 17 + 11) % 101).cast("double").alias("v"))


def ones(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))


def order_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout whose blocks are orders and whose components are their lines; the field is the order key mod 3."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("block_index")).agg(F.count("*").alias("components"))
    return lines.select("block_index", "components", (F.col("block_index") % 3).cast("int").alias("field_id"))


def supplier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(region, i)``: the parts that each supplier delivers."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("region"), F.col("l_partkey").alias("i")).distinct()


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node, x, y, z)`` of parts, whole numbers."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"), (F.col("p_partkey") % 53).cast("double").alias("z"))
