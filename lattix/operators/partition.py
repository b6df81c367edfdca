"""Row partitions, halos and their telemetry."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattix.schema import InvalidArgument, SparseMatrix

#: Blocks that a budget is dealt out over, 24 bytes each on the driver.
MOST_BLOCKS = 4_000_000


def balanced(n: int, ranks: int) -> list[tuple[int, int, int]]:
    """``(rank, lo, hi)``: contiguous ranges, the first ``n mod ranks`` one row larger."""
    if ranks < 1:
        raise InvalidArgument("a partition needs at least one rank")
    size, extra = divmod(n, ranks)
    return [(r, r * size + min(r, extra), (r + 1) * size + min(r + 1, extra)) for r in range(ranks)]


def from_offsets(offsets: list[int]) -> list[tuple[int, int, int]]:
    """Ranges from ascending offsets that begin with 0; empty ranks are rejected."""
    if len(offsets) < 2 or offsets[0] != 0 or any(b <= a for a, b in zip(offsets[:-1], offsets[1:], strict=True)):
        raise InvalidArgument("offsets must begin with 0 and grow strictly")
    return [(r, a, b) for r, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))]


def ranges(spark: SparkSession, parts: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame(parts, "rank int, lo bigint, hi bigint")


def owners_of(spark: SparkSession, parts: list[tuple[int, int, int]]) -> DataFrame:
    """``(i, owner)`` of every index."""
    return ranges(spark, parts).where("hi > lo").select(F.explode(F.expr("sequence(lo, hi - 1)")).alias("i"), F.col("rank").alias("owner"))


def owner_balanced(i, n: int, ranks: int):
    """The owner of an index under :func:`balanced`, by arithmetic alone."""
    size, extra = divmod(n, ranks)
    cut = extra * (size + 1)
    return F.when(i < cut, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - cut) / max(size, 1))).cast("int")


def counts(owners: DataFrame) -> DataFrame:
    return owners.groupBy("owner").agg(F.count("*").alias("rows"))


def as_ranges(owners: DataFrame) -> DataFrame:
    """Contiguous ranges ``(owner, lo, hi)`` of an assignment, and whether each owner's rows are gapless."""
    return owners.groupBy("owner").agg(F.min("i").alias("lo"), (F.max("i") + 1).alias("hi"), F.count("*").alias("n")).select("owner", "lo", "hi", (F.col("hi") - F.col("lo") == F.col("n")).alias("contiguous"))


def with_owner(t: DataFrame, owners: DataFrame) -> DataFrame:
    """``t`` with the ``owner`` of its column i, rows without one left out: by comparisons if the owners have few gapless ranges, else by a join."""
    spans = as_ranges(owners).orderBy("lo").limit(65).collect()
    if len(spans) > 64 or not all(s.contiguous for s in spans):
        return t.join(owners.select("i", "owner"), "i")
    owner = F.lit(None).cast(owners.schema["owner"].dataType)
    for s in reversed(spans):
        owner = F.when((F.col("i") >= s.lo) & (F.col("i") < s.hi), F.lit(s.owner).cast(owners.schema["owner"].dataType)).otherwise(owner)
    return t.withColumn("owner", owner).where("owner is not null")


def _owned(a: SparseMatrix, owners: DataFrame) -> DataFrame:
    rows, cols = owners.select("i", F.col("owner").alias("oi")), owners.select(F.col("i").alias("j"), F.col("owner").alias("oj"))
    return a.df.join(rows, "i").join(cols, "j")


def halo(a: SparseMatrix, owners: DataFrame) -> DataFrame:
    """``(rank, peer, dof)``: entries of the vector that a rank reads and a peer owns. The send list is the same table by peer."""
    return _owned(a, owners).where("oi <> oj").select(F.col("oi").alias("rank"), F.col("oj").alias("peer"), F.col("j").alias("dof")).distinct()


def halo_from_words(topology: DataFrame, owners: DataFrame) -> DataFrame:
    """The same plan from bitmap rows: words are merged by owning rank before any bit is read."""
    from lattix.functions.words import bits_of

    merged = topology.join(owners.select("i", F.col("owner").alias("rank")), "i").groupBy("rank", "w").agg(F.bit_or("mask").alias("mask"))
    read = merged.select("rank", F.explode(bits_of(F.col("w"), F.col("mask"))).alias("dof"))
    return read.join(owners.select(F.col("i").alias("dof"), F.col("owner").alias("peer")), "dof").where("rank <> peer").select("rank", "peer", "dof")


def halo_violations(plan: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows of a plan that name a peer which doesn't own the index, or the rank itself."""
    return plan.join(owners.select(F.col("i").alias("dof"), "owner"), "dof", "left").where("owner is null or owner <> peer or rank = peer").select("rank", "peer", "dof")


def exchange(x: DataFrame, plan: DataFrame) -> DataFrame:
    """``(rank, dof, v)``: the ghost values that each rank receives."""
    return plan.join(x.select(F.col("i").alias("dof"), "v"), "dof").select("rank", "dof", "v")


def local_numbers(owners: DataFrame, plan: DataFrame) -> DataFrame:
    """``(rank, dof, local, ghost)``: a rank's own indices first, then its ghosts by (peer, index)."""
    own = owners.select(F.col("owner").alias("rank"), F.lit(0).alias("ghost"), F.lit(-1).alias("peer"), F.col("i").alias("dof"))
    ghosts = plan.select("rank", F.lit(1).alias("ghost"), "peer", "dof")
    local = F.row_number().over(Window.partitionBy("rank").orderBy("ghost", "peer", "dof")) - 1
    return own.unionByName(ghosts).select("rank", "dof", local.cast("long").alias("local"), (F.col("ghost") == 1).alias("ghost"))


def local_matrices(a: SparseMatrix, owners: DataFrame, plan: DataFrame) -> DataFrame:
    """``(rank, i, j, v)`` in each rank's numbers."""
    number = local_numbers(owners, plan)
    placed = a.df.join(owners.select("i", F.col("owner").alias("rank")), "i")
    rows = number.where("not ghost").select("rank", F.col("dof").alias("i"), F.col("local").alias("li"))
    cols = number.select("rank", F.col("dof").alias("j"), F.col("local").alias("lj"))
    return placed.join(rows, ["rank", "i"]).join(cols, ["rank", "j"]).select("rank", F.col("li").alias("i"), F.col("lj").alias("j"), "v")


def distributed_spmv(a: SparseMatrix, owners: DataFrame, x: DataFrame) -> DataFrame:
    """Partition, halo, local products: the same result as the serial product, rows without entries 0."""
    plan = halo(a, owners)
    number = local_numbers(owners, plan)
    extended = number.join(x.select(F.col("i").alias("dof"), F.col("v").alias("xv")), "dof").select("rank", F.col("local").alias("j"), "xv")
    sums = local_matrices(a, owners, plan).join(extended, ["rank", "j"]).groupBy("rank", "i").agg(F.sum(F.col("v") * F.col("xv")).alias("v"))
    own = number.where("not ghost").select("rank", F.col("local").alias("i"), "dof")
    return own.join(sums, ["rank", "i"], "left").select(F.col("dof").alias("i"), F.coalesce("v", F.lit(0.0)).alias("v"))


def telemetry(a: SparseMatrix, owners: DataFrame) -> DataFrame:
    """One row: cut entries (stored references), unique ghosts, peers, and least, most and imbalance of rows and entries."""
    placed = _owned(a, owners)
    per = placed.groupBy("oi").agg(F.count("*").alias("nnz"), F.count_if(F.col("oi") != F.col("oj")).alias("cut"))
    ghosts = halo(a, owners).groupBy("rank").agg(F.count("*").alias("ghosts"), F.countDistinct("peer").alias("peers"))
    ranks = counts(owners).join(per.withColumnRenamed("oi", "owner"), "owner", "left").join(ghosts.withColumnRenamed("rank", "owner"), "owner", "left").na.fill(0)
    return ranks.agg(
        F.sum("cut").alias("cut_nnz"), F.sum("ghosts").alias("ghosts"), F.max("ghosts").alias("max_ghosts"), F.max("peers").alias("max_peers"), F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"),
        F.min("nnz").alias("min_nnz"), F.max("nnz").alias("max_nnz"), (F.max("rows") / F.avg("rows")).alias("row_imbalance"), (F.max("nnz") / F.avg("nnz")).alias("nnz_imbalance"),
    )


def interface(a: SparseMatrix, owners: DataFrame) -> DataFrame:
    """``(i)``: rows with an entry that another rank owns, in A or Aᵀ."""
    cut = _owned(a, owners).where("oi <> oj")
    return cut.select("i").union(cut.select(F.col("j").alias("i"))).distinct()


def interface_blocks(a: SparseMatrix, owners: DataFrame) -> DataFrame:
    """Entries of each rank by block: ``(owner, ii, ig, gi, gg)``."""
    from lattix.operators.algebra import schur_blocks

    marked = schur_blocks(a, interface(a, owners)).join(owners, "i")
    return marked.groupBy("owner").agg(*[F.count_if(F.col("block") == b).alias(b.lower()) for b in ("II", "IG", "GI", "GG")])


def rank_coarse(a: SparseMatrix, owners: DataFrame) -> DataFrame:
    """``(i, j, v)``: Σ a_ij / √(n_r n_s) for each pair of ranks."""
    n = counts(owners)
    placed = _owned(a, owners).groupBy("oi", "oj").agg(F.sum("v").alias("s"))
    return placed.join(n.select(F.col("owner").alias("oi"), F.col("rows").alias("ni")), "oi").join(n.select(F.col("owner").alias("oj"), F.col("rows").alias("nj")), "oj").select(F.col("oi").alias("i"), F.col("oj").alias("j"), (F.col("s") / F.sqrt(F.col("ni") * F.col("nj"))).alias("v"))


def boundary_pressure(a: SparseMatrix, group: int = 4096) -> DataFrame:
    """``(pos, pressure)``: undirected edges that cross the cut before each position where the number changes.

    Each edge (a < b) adds one from a + 1 and takes it away at b + 1; a two-level prefix sum adds up.
    """
    pairs = a.pattern().where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    events = pairs.select((F.col("a") + 1).alias("pos"), F.lit(1).alias("d")).union(pairs.select((F.col("b") + 1).alias("pos"), F.lit(-1).alias("d")))
    steps = events.groupBy("pos").agg(F.sum("d").alias("d")).withColumn("g", F.floor(F.col("pos") / group))
    base = steps.groupBy("g").agg(F.sum("d").alias("n")).select("g", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    run = F.sum("d").over(Window.partitionBy("g").orderBy("pos"))
    return steps.withColumn("run", run).join(base, "g").select("pos", (F.col("base") + F.col("run")).alias("pressure"))


def block_coupling(a: SparseMatrix, r: DataFrame, width: int) -> DataFrame:
    """``(block, internal, boundary, energy)``: L1 of entries inside and across contiguous blocks, and residual energy."""
    block = F.floor(F.col("i") / width)
    inner = block == F.floor(F.col("j") / width)
    own = a.df.groupBy(block.alias("block")).agg(F.sum(F.when(inner, F.abs("v")).otherwise(0.0)).alias("internal"), F.sum(F.when(~inner, F.abs("v")).otherwise(0.0)).alias("boundary"))
    energy = r.groupBy(block.alias("block")).agg(F.sum(F.col("v") * F.col("v")).alias("energy"))
    return own.join(energy, "block", "full").na.fill(0.0)


def budget_blocks(scores: DataFrame, budget: int) -> DataFrame:
    """``(block, size, score, taken)``: greedy by score, then index; a block that doesn't fit is skipped.

    Blocks are far fewer than rows: their scores alone, at most :data:`MOST_BLOCKS`, visit the driver.
    """
    got = scores.select("block", "size", "score").limit(MOST_BLOCKS + 1).toArrow()
    if got.num_rows > MOST_BLOCKS:
        raise InvalidArgument(f"a budget is dealt out over at most {MOST_BLOCKS} blocks")
    block, size, score = (got.column(c).to_numpy() for c in ("block", "size", "score"))
    order = np.lexsort((block, -score))
    taken, left = [], budget
    while len(order):  # all that fit in a row are taken at once, then all that never will fit go
        upto = int(np.searchsorted(np.cumsum(size[order]), left, "right"))
        taken.append(block[order[:upto]])
        left -= int(size[order[:upto]].sum())
        order = order[upto:]
        order = order[size[order] <= left]
    chosen = np.concatenate(taken) if taken else np.zeros(0, np.int64)
    table = scores.sparkSession.createDataFrame(pa.table({"block": chosen.astype(np.int64), "taken": np.ones(len(chosen), bool)}))
    return scores.join(table, "block", "left").select("block", "size", "score", F.coalesce("taken", F.lit(False)).alias("taken"))


def field_aligned(layout: DataFrame, n: int, ranks: int) -> DataFrame:
    """``(rank, target, cut)``: for each even target the nearest block boundary (as-of both ways), ties to the lower."""
    spark = layout.sparkSession
    targets = spark.createDataFrame([(r, round(n * r / ranks)) for r in range(1, ranks)], "rank int, target bigint")
    bounds = layout.select(F.col("start").alias("cut")).union(layout.select(F.col("end").alias("cut"))).distinct()
    # each target's neighbours: the last boundary up to it and the first beyond it, one aggregate over boundaries for all targets
    near = bounds.crossJoin(F.broadcast(targets)).groupBy("rank", "target").agg(F.max(F.when(F.col("cut") <= F.col("target"), F.col("cut"))).alias("lo"), F.min(F.when(F.col("cut") > F.col("target"), F.col("cut"))).alias("hi"))
    pick = F.when(F.col("hi").isNull() | (F.col("target") - F.col("lo") <= F.col("hi") - F.col("target")), F.col("lo")).otherwise(F.col("hi"))
    return near.select("rank", "target", pick.alias("cut"))


def preflight(a: SparseMatrix, owners: DataFrame) -> DataFrame:
    """``(owner, rows, nnz)`` that a scatter would send."""
    per = a.df.join(owners, "i").groupBy("owner").agg(F.count("*").alias("nnz"))
    return counts(owners).join(per, "owner", "left").na.fill(0)


def owned_rows(a: SparseMatrix, owners: DataFrame) -> DataFrame:
    """``(owner, i, j, v)`` dealt out by owner."""
    return with_owner(a.df, owners).select("owner", "i", "j", "v").repartition("owner")


def owner_directory(a: SparseMatrix, owners: DataFrame) -> DataFrame:
    """``(rank, j, owner)``: the owners of just those columns that a rank reads and doesn't own."""
    return halo(a, owners).select("rank", F.col("dof").alias("j"), F.col("peer").alias("owner"))


def score_blocks(a: SparseMatrix, r: DataFrame, width: int, rule: str, budget_bytes: int) -> DataFrame:
    """``(block, size, score, taken)`` of contiguous blocks by residual energy per byte of a dense factor.

    ``boundary_coupling`` divides that by one plus the share of the block's L1 that crosses its boundary.
    """
    if rule not in ("residual_energy", "boundary_coupling"):
        raise InvalidArgument(f"no such rule: {rule}")
    rows = a.rows().groupBy(F.floor(F.col("i") / width).alias("block")).agg(F.count("*").alias("n"))
    told = block_coupling(a, r, width).join(rows, "block").withColumn("size", F.col("n") * F.col("n") * 8)
    score = F.col("energy") / F.col("size")
    if rule == "boundary_coupling":
        score = score / (1 + F.col("boundary") / F.greatest(F.col("internal") + F.col("boundary"), F.lit(2.2250738585072014e-308)))
    return budget_blocks(told.select("block", "size", score.alias("score")), budget_bytes)
