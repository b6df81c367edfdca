"""Vectors, coordinates, owner labels, row-owned tables and compressed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattix.schema import DimensionMismatch, FormatError, InvalidMatrix, SparseMatrix


#: What tells a split of the input, in the order of the lines.
_SPLIT = ["part", "file", "block"]


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``(part, file, block, at, value)`` that sort as they stand: part files by number, then by name, the split's place in its file, the line in it.

    Which splits share a task, and in what order, is up to Spark (the longest first), so numbers of tasks give no order.
    """
    part = F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) AS bigint)"), F.lit(-1))
    place = [part.alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "﻿", "").alias("value"))


def _values(lines: DataFrame) -> DataFrame:
    """Whitespace-separated fields ``(part, file, block, at, k, field)`` without comments that begin with # or %."""
    kept = lines.where(~F.ltrim("value").rlike("^[#%]") & (F.trim("value") != ""))
    return kept.select(*_SPLIT, "at", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("k", "field"))


def _ranked(fields: DataFrame) -> DataFrame:
    """``(i, field)`` with gapless numbers: counts of splits are summed first, so no task orders the whole file."""
    base = fields.groupBy(*_SPLIT).count().select(*_SPLIT, F.coalesce(F.sum("count").over(Window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy(*_SPLIT).orderBy("at", "k")) - 1
    return fields.withColumn("rank", rank).join(base, _SPLIT).select((F.col("base") + F.col("rank")).alias("i"), "field")


def read_vector(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``(i, v)`` of exactly n finite numbers."""
    out = _ranked(_values(_numbered(spark, path))).select("i", F.expr("try_cast(field AS double)").alias("v"))
    seen = out.agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))).alias("bad")).first()
    if seen.bad:
        raise FormatError(f"{seen.bad} fields are no finite numbers")
    if seen.n != n:
        raise DimensionMismatch(f"{n} numbers are expected, {seen.n} are there")
    return out


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """``(node, x, y, z)`` after a line that counts the nodes."""
    fields = _ranked(_values(_numbered(spark, path))).select("i", F.expr("try_cast(field AS double)").alias("v"))
    head = fields.where("i = 0").first()
    if head is None or head.v is None:
        raise FormatError("a coordinate file begins with the number of nodes")
    seen = fields.agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("bad")).first()
    if seen.bad or seen.n != 3 * int(head.v) + 1:
        raise FormatError(f"{int(head.v)} nodes need {3 * int(head.v)} numbers, {seen.n - 1} are there")
    flat = fields.where("i > 0").select(F.expr("(i - 1) div 3").alias("node"), F.expr("(i - 1) % 3").alias("k"), "v")
    return flat.groupBy("node").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(c) for k, c in enumerate("xyz")])


def read_labels(spark: SparkSession, path: str, ranks: int, n: int | None = None) -> DataFrame:
    """``(i, owner)`` from one label for each row, in order."""
    out = _ranked(_values(_numbered(spark, path))).select("i", F.expr("try_cast(field AS int)").alias("owner"))
    bad = out.where(f"owner is null or owner < 0 or owner >= {ranks}").take(1)
    if bad:
        raise FormatError(f"label {bad[0].owner} of row {bad[0].i} is no rank below {ranks}")
    if n is not None and out.count() != n:
        raise DimensionMismatch(f"{n} labels are expected")
    return out


def write_labels(owners: DataFrame, path: str) -> None:
    """One label a line, in row order."""
    owners.repartitionByRange("i").sortWithinPartitions("i").select(F.col("owner").cast("string").alias("value")).write.text(path)


def map_to_labels(pairs: DataFrame, base: int = 0) -> DataFrame:
    """Owner labels from an external partitioner's map ``(vertex, part)`` with a base of 0 or 1."""
    return pairs.select((F.col("vertex") - base).alias("i"), F.col("part").cast("int").alias("owner"))


def write_graph(pairs: DataFrame, n: int, path: str) -> None:
    """Adjacency lines (1-based) after a line of node and edge counts, the common input of graph partitioners."""
    spark = pairs.sparkSession
    lists = pairs.groupBy("i").agg(F.array_sort(F.collect_list((F.col("j") + 1))).alias("near"))
    rows = spark.range(n).select(F.col("id").alias("i")).join(lists, "i", "left").select("i", F.coalesce(F.array_join(F.transform("near", lambda x: x.cast("string")), " "), F.lit("")).alias("value"))
    head = spark.createDataFrame([(-1, f"{n} {pairs.count() // 2}")], "i long, value string")
    head.union(rows).repartitionByRange("i").sortWithinPartitions("i").select("value").write.text(path)


def write_owned_rows(a: SparseMatrix, owners: DataFrame, path: str) -> None:
    """Parquet by owner, so that a rank's rows are read without the rest."""
    a.df.join(owners, "i").repartition("owner").write.partitionBy("owner").parquet(path)


def read_owned_rows(spark: SparkSession, path: str, owner: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if owner is None else rows.where(F.col("owner") == owner)


def csr_to_matrix(spark: SparkSession, nrows: int, ncols: int, row_ptr: list[int], col_idx: list[int], values: list[float], base: int = 0) -> SparseMatrix:
    """A matrix from compressed rows, fully checked; index base 0 or 1. Rows may be unsorted and repeat columns."""
    if base not in (0, 1):
        raise InvalidMatrix("the index base is 0 or 1")
    ptr = [p - base for p in row_ptr]
    if len(ptr) != nrows + 1 or ptr[0] != 0 or ptr[-1] != len(col_idx) or len(col_idx) != len(values) or any(b < a for a, b in zip(ptr[:-1], ptr[1:], strict=True)):
        raise InvalidMatrix("row pointers must begin with 0, never fall, and end with the number of entries")
    rows = [(i, col_idx[k] - base, float(values[k])) for i in range(nrows) for k in range(ptr[i], ptr[i + 1])]
    return SparseMatrix(spark.createDataFrame(rows, "i bigint, j bigint, v double"), nrows, ncols).validate()
