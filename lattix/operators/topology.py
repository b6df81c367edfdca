"""Sparsity patterns as 64-bit words ``(i, w, mask)``, their set algebra, and matrices in tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.functions.words import andnot, bit_positions, bits_of, single_bit, trailing_zeros, word_of
from lattix.schema import SparseMatrix

#: Tile kinds by entries: at most this many are sparse, at least that many are dense, else a bitmap.
SPARSE_MOST, DENSE_LEAST = 8, 40


def words(pattern: DataFrame) -> DataFrame:
    """Words of a pattern ``(i, j)``; explicit zeros are structure and duplicates collapse."""
    return pattern.groupBy("i", word_of(F.col("j")).alias("w")).agg(F.bit_or(single_bit(F.col("j"))).alias("mask"))


def words_of_blocks(blocks: DataFrame, ncols: int, lo: int, hi: int) -> DataFrame:
    """:func:`words` of the rows from lo to hi of packed blocks; these hold whole rows, so nothing is exchanged."""
    import numpy as np
    import pyarrow as pa

    from lattix.solvers.backend import unpacked_rows

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, counts, cols = unpacked_rows(batch.slice(k, 1).to_pylist()[0], ncols)[:3]
                i = np.repeat(rows, counts)
                keep = (i >= lo) & (i < hi)
                i, j = i[keep], cols[keep].astype(np.int64)
                if len(i):
                    first = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] >> 6 != j[:-1] >> 6)))
                    mask = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (j & 63).astype(np.uint64)), first).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(i[first]), pa.array(j[first] >> 6), pa.array(mask)], ["i", "w", "mask"])

    return blocks.mapInArrow(read, "i long, w long, mask long")


def entries(topology: DataFrame) -> DataFrame:
    """Positions ``(i, j)`` of a topology."""
    return topology.select("i", F.explode(bits_of(F.col("w"), F.col("mask"))).alias("j"))


def stats(topology: DataFrame) -> DataFrame:
    """One row: nnz, words, fill ratio of words and bytes an entry (12 for a word: number and mask)."""
    n = F.sum(F.bit_count("mask"))
    return topology.agg(F.coalesce(n, F.lit(0)).alias("nnz"), F.count("*").alias("words"), (n / (F.count("*") * 64)).alias("fill_ratio"), (F.count("*") * 12 / n).alias("bytes_per_nnz"))


def _both(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    left, right = a.select("i", "w", F.col("mask").alias("ma")), b.select("i", "w", F.col("mask").alias("mb"))
    return left.join(right, ["i", "w"], how)


def combine(a: DataFrame, b: DataFrame, rule) -> DataFrame:
    """Words of ``rule(mask of a, mask of b)``, empty words dropped; the rule must give 0 for two zeros."""
    zero = F.lit(0).cast("long")
    out = _both(a, b, "full").select("i", "w", rule(F.coalesce("ma", zero), F.coalesce("mb", zero)).alias("mask"))
    return out.where("mask <> 0")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, "inner").select("i", "w", F.col("ma").bitwiseAND(F.col("mb")).alias("mask")).where("mask <> 0")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i", "w", "mask").union(b.select("i", "w", "mask")).groupBy("i", "w").agg(F.bit_or("mask").alias("mask"))


def and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, "left").select("i", "w", andnot(F.col("ma"), F.coalesce("mb", F.lit(0).cast("long"))).alias("mask")).where("mask <> 0")


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i", "w", "mask").union(b.select("i", "w", "mask")).groupBy("i", "w").agg(F.bit_xor("mask").alias("mask")).where("mask <> 0")


def transpose(topology: DataFrame) -> DataFrame:
    """Column words of the same pattern."""
    return words(entries(topology).select(F.col("j").alias("i"), F.col("i").alias("j")))


def undirected(pattern: DataFrame) -> DataFrame:
    """The pattern together with its mirror, without loops."""
    return pattern.where("i <> j").select("i", "j").union(pattern.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def row(topology: DataFrame, i: int) -> DataFrame:
    return topology.where(F.col("i") == i)


def contains(topology: DataFrame, i: int, j: int) -> bool:
    return bool(row(topology, i).where((F.col("w") == j // 64) & (F.call_function("bit_get", "mask", F.lit(j % 64)) == 1)).take(1))


def rank_select(topology: DataFrame) -> DataFrame:
    """``(i, j, rank)``: the position of each entry in its row. Select is the same table read by rank."""
    before = Window.partitionBy("i").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    sized = topology.withColumn("before", F.coalesce(F.sum(F.bit_count("mask")).over(before), F.lit(0)))
    return sized.select("i", "before", F.posexplode(bits_of(F.col("w"), F.col("mask"))).alias("at", "j")).select("i", "j", (F.col("before") + F.col("at")).alias("rank"))


def first_of_row(topology: DataFrame) -> DataFrame:
    """``(i, j)``: the smallest column of each row."""
    return topology.groupBy("i").agg(F.min(F.col("w") * 64 + trailing_zeros(F.col("mask"))).alias("j"))


def expand_mask(topology: DataFrame, mask: DataFrame) -> DataFrame:
    """The mask with all columns of its rows: one hop along the rows of A only."""
    return mask.select("i").union(entries(topology.join(mask.select("i").distinct(), "i", "left_semi")).select(F.col("j").alias("i"))).distinct()


def row_intersections(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(ia, ib, common)``: shared indices of rows of a with rows of b, for pairs that share any, through shared words."""
    left, right = a.select(F.col("i").alias("ia"), "w", F.col("mask").alias("ma")), b.select(F.col("i").alias("ib"), "w", F.col("mask").alias("mb"))
    both = left.join(right, "w").withColumn("n", F.bit_count(F.col("ma").bitwiseAND(F.col("mb")))).where("n > 0")
    return both.groupBy("ia", "ib").agg(F.sum("n").alias("common"))


def tiles(a: SparseMatrix, drop_zeros: bool = True) -> DataFrame:
    """``(i, w, mask, vals)``: packed values in bit order. Zeros are dropped before and after summing, or kept as structure."""
    source = a.df.where("v <> 0") if drop_zeros else a.df
    one = SparseMatrix(source, a.nrows, a.ncols).canonical(drop_zeros).df
    packed = F.array_sort(F.collect_list(F.struct("j", "v")))
    return one.groupBy("i", word_of(F.col("j")).alias("w")).agg(F.bit_or(single_bit(F.col("j"))).alias("mask"), packed.alias("p")).select("i", "w", "mask", F.transform("p", lambda x: x["v"]).alias("vals"))


def tile_kind(mask: Column) -> Column:
    n = F.bit_count(mask)
    return F.when(n <= SPARSE_MOST, "sparse").when(n >= DENSE_LEAST, "dense").otherwise("bitmap")


def tile_stats(tiled: DataFrame) -> DataFrame:
    return tiled.groupBy(tile_kind(F.col("mask")).alias("kind")).agg(F.count("*").alias("tiles"), F.sum(F.bit_count("mask")).alias("nnz"))


def untile(tiled: DataFrame) -> DataFrame:
    """Entries ``(i, j, v)`` of tiles: the k-th value belongs to the k-th set bit."""
    return tiled.select("i", "w", F.explode(F.arrays_zip(bit_positions(F.col("mask")).alias("k"), F.col("vals").alias("v"))).alias("x")).select("i", (F.col("w") * 64 + F.col("x.k")).alias("j"), F.col("x.v").alias("v"))


def tiled_spmv(tiled: DataFrame, x: DataFrame) -> DataFrame:
    """Row sums of tiles times a vector, by words: 64 values of x meet a tile at once."""
    wide = x.groupBy(word_of(F.col("i")).alias("w")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("i").bitwiseAND(F.lit(63)).cast("int").alias("k"), "v"))).alias("xs"))
    products = F.zip_with(bit_positions(F.col("mask")), F.col("vals"), lambda k, v: F.coalesce(F.element_at(F.col("xs"), k), F.lit(0.0)) * v)
    part = tiled.join(wide, "w").select("i", F.aggregate(products, F.lit(0.0), lambda s, p: s + p).alias("v"))
    return part.groupBy("i").agg(F.sum("v").alias("v"))


def dense_blocks(a: SparseMatrix, width: int) -> DataFrame:
    """``(bi, bj, vals)``: full width x width blocks in row order, absent entries 0; the last ones may stand out of the matrix."""
    one = a.canonical(drop_zeros=False).df.withColumns({"bi": F.floor(F.col("i") / width), "bj": F.floor(F.col("j") / width), "k": (F.col("i") % width) * width + F.col("j") % width})
    packed = one.groupBy("bi", "bj").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("int"), "v"))).alias("m"))
    return packed.select("bi", "bj", F.transform(F.sequence(F.lit(0), F.lit(width * width - 1)), lambda k: F.coalesce(F.element_at(F.col("m"), k), F.lit(0.0))).alias("vals"))


def block_spmv(blocks: DataFrame, x: DataFrame, width: int, nrows: int) -> DataFrame:
    """Row sums of dense blocks times a vector; rows beyond ``nrows`` are the tail's padding."""
    packed = x.groupBy(F.floor(F.col("i") / width).alias("bj")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") % width).cast("int").alias("k"), "v"))).alias("m"))
    dense = packed.select("bj", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.element_at(F.col("m"), k), F.lit(0.0))).alias("xs"))
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda r: F.struct((F.col("bi") * width + r).alias("i"), F.aggregate(F.zip_with(F.slice("vals", r * width + 1, width), F.col("xs"), lambda v, y: v * y), F.lit(0.0), lambda s, p: s + p).alias("v")),
    )
    return blocks.join(dense, "bj").select(F.explode(rows).alias("y")).select("y.i", "y.v").groupBy("i").agg(F.sum("v").alias("v")).where(F.col("i") < nrows)


def block_stats(a: SparseMatrix, width: int) -> DataFrame:
    """One row: blocks, fill, padding ratio and share of full blocks."""
    per = a.pattern().groupBy(F.floor(F.col("i") / width).alias("bi"), F.floor(F.col("j") / width).alias("bj")).agg(F.count("*").alias("n"))
    cells = width * width
    return per.agg(F.count("*").alias("blocks"), (F.sum("n") / (F.count("*") * cells)).alias("fill"), (F.count("*") * cells / F.sum("n")).alias("padding_ratio"), F.avg((F.col("n") == cells).cast("double")).alias("full_share"))


def violations(topology: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Rows that break a topology: out of range, empty words, repeated words, bits beyond the last column."""
    bad = (F.col("i") < 0) | (F.col("i") >= nrows) | (F.col("w") < 0) | (F.col("mask") == 0) | (F.array_max(bits_of(F.col("w"), F.col("mask"))) >= ncols)
    repeated = topology.groupBy("i", "w").agg(F.count("*").alias("n"), F.bit_or("mask").alias("mask")).where("n > 1").select("i", "w", F.lit("repeated word").alias("why"))
    return topology.where(bad).select("i", "w", F.lit("out of range or empty").alias("why")).union(repeated)
