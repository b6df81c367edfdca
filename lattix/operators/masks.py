"""Index sets and the restriction of matrices and vectors to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattix.schema import InvalidArgument, SparseMatrix


def mask_of(spark: SparkSession, n: int, indices: list[int]) -> DataFrame:
    """A mask of n positions from explicit indices."""
    if any(not 0 <= k < n for k in indices):
        raise InvalidArgument(f"a mask of {n} positions has no index {next(k for k in indices if not 0 <= k < n)}")
    return spark.createDataFrame([(k,) for k in sorted(set(indices))], "i bigint")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i").union(b.select("i")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i").join(b.select("i").distinct(), "i", "left_semi").distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i").join(b.select("i").distinct(), "i", "left_anti").distinct()


def intersects(a: DataFrame, b: DataFrame) -> bool:
    return bool(intersection(a, b).take(1))


def contains(mask: DataFrame, i: int) -> bool:
    return bool(mask.where(F.col("i") == i).take(1))


def restrict_columns(a: SparseMatrix, active: DataFrame) -> SparseMatrix:
    """A M: entries whose column is active, by a semi-join that reads no values of the mask."""
    keep = active.select(F.col("i").alias("j")).distinct()
    return SparseMatrix(a.df.join(keep, "j", "left_semi").select("i", "j", "v"), a.nrows, a.ncols)


def restrict_words(a: SparseMatrix, active: DataFrame) -> SparseMatrix:
    """A M through 64-wide words: positions are tested as bits before a value is kept."""
    from lattix.functions.words import single_bit, word_of

    words = active.select("i").distinct().groupBy(word_of(F.col("i")).alias("w")).agg(F.bit_or(single_bit(F.col("i"))).alias("m"))
    hit = a.canonical().df.withColumn("w", word_of(F.col("j"))).join(words, "w").where(F.col("m").bitwiseAND(single_bit(F.col("j"))) != 0)
    return SparseMatrix(hit.select("i", "j", "v"), a.nrows, a.ncols)


def renumber(region: DataFrame) -> DataFrame:
    """``(i, local)``: ascending local numbers.

    Ranks come from counts of 4096-wide blocks of indices, so no task sorts more than a block.
    """
    block = F.shiftright("i", 12)
    own = region.select("i").distinct().withColumn("block", block)
    sizes = own.groupBy("block").count()
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    offsets = sizes.select("block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("i")) - 1
    return own.withColumn("rank", rank).join(offsets, "block").select("i", (F.col("offset") + F.col("rank")).alias("local"))


def restrict_local(a: SparseMatrix, region: DataFrame) -> tuple[SparseMatrix, DataFrame]:
    """R A R with ascending local numbers, and the map ``(i, local)``."""
    order = renumber(region)
    rows, cols = order.select("i", F.col("local").alias("li")), order.select(F.col("i").alias("j"), F.col("local").alias("lj"))
    out = a.df.join(rows, "i").join(cols, "j").groupBy("li", "lj").agg(F.sum("v").alias("v"))
    size = order.count()
    return SparseMatrix(out.select(F.col("li").alias("i"), F.col("lj").alias("j"), "v"), size, size), order


def gather(x: DataFrame, order: DataFrame) -> DataFrame:
    """Global vector to local numbers."""
    return x.join(order, "i").select(F.col("local").alias("i"), "v")


def scatter(local: DataFrame, order: DataFrame) -> DataFrame:
    """Local vector back to global numbers."""
    return local.select(F.col("i").alias("local"), "v").join(order, "local").select("i", "v")


def local_plan(a: SparseMatrix, region: DataFrame) -> DataFrame:
    """``(i, j, li, lj)``: where each entry of R A R comes from. Values can then be refreshed by one join."""
    order = renumber(region)
    rows, cols = order.select("i", F.col("local").alias("li")), order.select(F.col("i").alias("j"), F.col("local").alias("lj"))
    return a.pattern().join(rows, "i").join(cols, "j").select("i", "j", "li", "lj")


def refresh(plan: DataFrame, values: SparseMatrix) -> DataFrame:
    """Local entries ``(i, j, v)`` of a plan with the values of a matrix of the same structure."""
    return plan.join(values.df, ["i", "j"]).groupBy("li", "lj").agg(F.sum("v").alias("v")).select(F.col("li").alias("i"), F.col("lj").alias("j"), "v")


def risk_mask(a: SparseMatrix, coupling: float = 0.90, jump: float = 100.0) -> DataFrame:
    """Rows with Σ|off-diagonal| / |diagonal| of at least ``coupling`` or a diagonal scale jump to a neighbour of at least ``jump``.

    Rows with a zero diagonal are skipped.
    """
    from lattix.operators.profile import diagonal

    d = diagonal(a).select("i", F.abs("v").alias("d")).where("d > 0")
    near = d.select(F.col("i").alias("j"), F.col("d").alias("dj"))
    off = a.df.where("i <> j").join(near, "j", "left").join(d, "i")
    per = off.groupBy("i").agg((F.sum(F.abs("v")) / F.first("d")).alias("c"), F.max(F.greatest(F.col("d") / F.col("dj"), F.col("dj") / F.col("d"))).alias("s"))
    return per.where((F.col("c") >= coupling) | (F.coalesce("s", F.lit(1.0)) >= jump)).select("i")


def residual_seeds(r: DataFrame, fraction: float = 0.25) -> DataFrame:
    """Indices with |r| of at least ``fraction`` of the largest; none if all are zero. The largest is one broadcast row."""
    peak = r.agg(F.max(F.abs("v")).alias("peak"))
    return r.crossJoin(F.broadcast(peak)).where((F.col("peak") > 0) & (F.abs("v") >= fraction * F.col("peak"))).select("i")


def pruned_dot(a: SparseMatrix, active: DataFrame, x: DataFrame) -> DataFrame:
    """Row sums over active columns with product counts: ``(i, v, candidates, executed, skipped)``."""
    seen = a.df.join(active.select(F.col("i").alias("j"), F.lit(1).alias("on")).distinct(), "j", "left").join(x.select(F.col("i").alias("j"), F.col("v").alias("xv")), "j", "left")
    on = F.col("on").isNotNull()
    return seen.groupBy("i").agg(
        F.coalesce(F.sum(F.when(on, F.col("v") * F.coalesce("xv", F.lit(0.0)))), F.lit(0.0)).alias("v"), F.count("*").alias("candidates"), F.count_if(on).alias("executed"), F.count_if(~on).alias("skipped")
    )


def pruning_stats(pruned: DataFrame) -> DataFrame:
    """Totals of :func:`pruned_dot` and the share skipped."""
    return pruned.agg(F.sum("candidates").alias("candidates"), F.sum("executed").alias("executed"), F.sum("skipped").alias("skipped"), (F.sum("skipped") / F.sum("candidates")).alias("pruning_ratio"))
