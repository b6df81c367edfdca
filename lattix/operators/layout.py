"""Mixed-field layouts: blocks of components that belong to mesh entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def offsets(blocks: DataFrame, group: int = 4096) -> DataFrame:
    """Adds ``start`` and ``end`` of each block: a prefix sum of components in block order.

    Sums of groups of ``group`` blocks are summed up first, so no task orders more than one
    group or the list of groups.
    """
    own = blocks.withColumn("g", F.floor(F.col("block_index") / group))
    sums = own.groupBy("g").agg(F.sum("components").alias("n"))
    base = sums.select("g", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    end = F.col("base") + F.sum("components").over(Window.partitionBy("g").orderBy("block_index"))
    return own.join(base, "g").withColumn("end", end).withColumn("start", F.col("end") - F.col("components")).drop("g", "base")


def dofs(layout: DataFrame) -> DataFrame:
    """``(i, block_index, component, field_id)`` of every index."""
    return layout.where("components > 0").select("block_index", "field_id", F.posexplode(F.expr("sequence(start, end - 1)")).alias("component", "i")).select("i", "block_index", "component", "field_id")


def field_mask(layout: DataFrame, field_id: int) -> DataFrame:
    """All indices of one field."""
    return dofs(layout.where(F.col("field_id") == field_id)).select("i")


def locate(layout: DataFrame, indices: DataFrame, step: int = 64) -> DataFrame:
    """``(i, block_index, component)`` by a range lookup, made an equi-join on step-wide buckets."""
    spread = layout.where("components > 0").select("block_index", "start", "end", F.explode(F.expr(f"sequence(start div {step}, (end - 1) div {step})")).alias("bucket"))
    asked = indices.select("i").withColumn("bucket", F.expr(f"i div {step}"))
    return asked.join(spread, "bucket").where((F.col("start") <= F.col("i")) & (F.col("i") < F.col("end"))).select("i", "block_index", (F.col("i") - F.col("start")).alias("component"))


def close_to_blocks(layout: DataFrame, selected: DataFrame) -> DataFrame:
    """The selection grown to whole blocks."""
    touched = locate(layout, selected).select("block_index").distinct()
    return dofs(layout.join(touched, "block_index", "left_semi")).select("i")


def split_blocks(layout: DataFrame, owners: DataFrame) -> DataFrame:
    """Blocks whose indices have more than one owner: ``(block_index, owners)``; none in a valid assignment."""
    return dofs(layout).join(owners, "i").groupBy("block_index").agg(F.countDistinct("owner").alias("owners")).where("owners > 1")


def block_owners(layout: DataFrame, owners: DataFrame) -> DataFrame:
    return dofs(layout).join(owners, "i").groupBy("block_index").agg(F.min("owner").alias("owner"))
