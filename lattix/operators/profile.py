"""Diagnostics of a matrix: profile, diagonal, symmetry, dominance, signals and signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.schema import MissingDiagonal, SparseMatrix


def diagonal(a: SparseMatrix) -> DataFrame:
    """``(i, v)`` of stored diagonal entries, duplicates summed."""
    return a.df.where("i = j").groupBy("i").agg(F.sum("v").alias("v"))


def missing_diagonal(a: SparseMatrix) -> DataFrame:
    """Rows without a stored diagonal entry."""
    return a.rows().join(diagonal(a), "i", "left_anti")


def need_diagonal(a: SparseMatrix, positive: bool = False) -> DataFrame:
    """The diagonal, or an error if a row has none, a zero, or (if asked) a negative one."""
    lost = missing_diagonal(a).take(1)
    if lost:
        raise MissingDiagonal(f"row {lost[0].i} has no diagonal entry")
    bad = diagonal(a).where("v <= 0" if positive else "v = 0").take(1)
    if bad:
        raise MissingDiagonal(f"row {bad[0].i} has diagonal {bad[0].v}")
    return diagonal(a)


def profile(a: SparseMatrix) -> DataFrame:
    """One row: dims, nnz, squareness, full and positive diagonal, mean and largest row."""
    per = a.rows().join(a.df.groupBy("i").agg(F.count("*").alias("n"), F.count_if(F.col("i") == F.col("j")).alias("d"), F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))), F.lit(0.0)).alias("dv")), "i", "left")
    n, d, dv = (F.coalesce(c, F.lit(0)) for c in ("n", "d", "dv"))
    return per.agg(
        F.lit(a.nrows).cast("long").alias("nrows"), F.lit(a.ncols).cast("long").alias("ncols"), F.coalesce(F.sum(n), F.lit(0)).alias("nnz"), F.lit(a.square).alias("square"),
        F.bool_and(d > 0).alias("full_diagonal"), F.bool_and((d > 0) & (dv > 0)).alias("positive_diagonal"), F.avg(n).alias("avg_row_nnz"), F.max(n).alias("max_row_nnz"),
    )


def bandwidth(a: SparseMatrix) -> DataFrame:
    return a.df.agg(F.coalesce(F.max(F.abs(F.col("i") - F.col("j"))), F.lit(0)).alias("bandwidth"))


def symmetry(a: SparseMatrix, tolerance: float = 1e-12) -> DataFrame:
    """One row: off-diagonal entries, entries whose mirror is missing, pairs beyond the mixed tolerance, largest difference."""
    one = a.canonical(drop_zeros=False).df
    mirror = one.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("t"))
    off = one.where("i <> j").join(mirror, ["i", "j"], "left")
    diff = F.abs(F.col("v") - F.col("t"))
    return off.agg(
        F.count("*").alias("off_diagonal"), F.count_if(F.col("t").isNull()).alias("missing_transpose"),
        F.count_if(diff > tolerance * F.greatest(F.lit(1.0), F.abs("v"), F.abs("t"))).alias("asymmetric"), F.coalesce(F.max(diff), F.lit(0.0)).alias("max_difference"),
    )


def dominance(a: SparseMatrix) -> DataFrame:
    """``(i, diag, off, class)`` of each row: ``strict`` if |diag| > Σ|off|, ``weak`` if equal, else ``none``."""
    one = a.canonical(drop_zeros=False).df
    per = one.groupBy("i").agg(F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))), F.lit(0.0)).alias("diag"), F.coalesce(F.sum(F.when(F.col("i") != F.col("j"), F.abs("v"))), F.lit(0.0)).alias("off"))
    every = a.rows().join(per, "i", "left").select("i", F.coalesce("diag", F.lit(0.0)).alias("diag"), F.coalesce("off", F.lit(0.0)).alias("off"))
    kind = F.when(F.abs("diag") > F.col("off"), "strict").when(F.abs("diag") == F.col("off"), "weak").otherwise("none")
    return every.withColumn("class", kind)


def spd_certificate(a: SparseMatrix, margin: float = 0.0) -> DataFrame:
    """One row ``certified``: exactly symmetric and every row's positive diagonal exceeds Σ|off| by more than ``margin`` of it."""
    rows = dominance(a).agg(F.count_if(~(F.col("diag") > F.col("off") + margin * F.col("diag"))).alias("bad"))
    sym = symmetry(a, 0.0)
    return rows.crossJoin(F.broadcast(sym)).select(F.col("bad").alias("rows_not_dominant"), "missing_transpose", "asymmetric", ((F.col("bad") == 0) & (F.col("missing_transpose") == 0) & (F.col("asymmetric") == 0)).alias("certified"))


def audit(a: SparseMatrix) -> DataFrame:
    """One row: dominance counts, asymmetry, components, bandwidth, and a class label."""
    from lattix.operators.components import connected_components

    rows = dominance(a).agg(F.count_if(F.col("class") == "strict").alias("strict_rows"), F.count_if(F.col("class") == "weak").alias("weak_rows"), F.count_if(F.col("class") == "none").alias("other_rows"), F.count_if(F.col("diag") > 0).alias("positive_rows"))
    parts = connected_components(a.df.select(F.col("i").alias("src"), F.col("j").alias("dst")))
    comps = parts.agg(F.countDistinct("component").alias("c"), F.count("*").alias("n")).select((F.col("c") + a.nrows - F.col("n")).alias("components"))
    out = rows.crossJoin(F.broadcast(symmetry(a))).crossJoin(F.broadcast(comps)).crossJoin(F.broadcast(bandwidth(a)))
    even = (F.col("missing_transpose") == 0) & (F.col("asymmetric") == 0)
    label = F.when(~even, "general").when((F.col("other_rows") + F.col("weak_rows") == 0) & (F.col("positive_rows") == a.nrows), "strictly dominant SPD").when((F.col("other_rows") == 0) & (F.col("positive_rows") == a.nrows), "weakly dominant symmetric").otherwise("symmetric")
    return out.withColumn("class", label)


def signals(a: SparseMatrix) -> DataFrame:
    """One row of solver-selection signals: row-size percentiles, ILU work proxy, dominance, signs and cancellation."""
    per = a.df.groupBy("i").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("i") == F.col("j"), F.abs("v")).otherwise(0.0)).alias("d"), F.sum(F.when(F.col("i") != F.col("j"), F.abs("v")).otherwise(0.0)).alias("off"), F.sum("v").alias("s"), F.sum(F.abs("v")).alias("l1"),
        F.count_if((F.col("i") != F.col("j")) & (F.col("v") < 0)).alias("neg"), F.count_if((F.col("i") != F.col("j")) & (F.col("v") > 0)).alias("pos"),
    )
    every = a.rows().join(per, "i", "left").na.fill(0)
    return every.agg(
        F.percentile("n", 0.5).alias("row_nnz_p50"), F.percentile("n", 0.95).alias("row_nnz_p95"), F.sum(F.col("n") * F.col("n")).alias("ilu_work"), F.avg((F.col("d") > F.col("off")).cast("double")).alias("dominant_share"),
        (F.sum("neg") / F.greatest(F.sum(F.col("neg") + F.col("pos")), F.lit(1))).alias("negative_share"), F.avg(F.when(F.col("l1") > 0, 1 - F.abs("s") / F.col("l1")).otherwise(0.0)).alias("cancellation"),
    )


def block_strength(a: SparseMatrix, width: int) -> DataFrame:
    """``(bi, bj, norm, strength)``: Frobenius norms of node blocks, off-diagonal ones over the root of their diagonals' product."""
    blocks = a.df.groupBy(F.floor(F.col("i") / width).alias("bi"), F.floor(F.col("j") / width).alias("bj")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    own = blocks.where("bi = bj").select(F.col("bi").alias("b"), F.col("norm").alias("d"))
    both = blocks.join(own.select(F.col("b").alias("bi"), F.col("d").alias("di")), "bi").join(own.select(F.col("b").alias("bj"), F.col("d").alias("dj")), "bj")
    return both.select("bi", "bj", "norm", (F.col("norm") / F.sqrt(F.col("di") * F.col("dj"))).alias("strength"))


def strong_adjacency(a: SparseMatrix, width: int, threshold: float) -> DataFrame:
    """Node pairs ``(bi, bj)`` whose strength reaches ``threshold``, each both ways."""
    strong = block_strength(a, width).where((F.col("bi") != F.col("bj")) & (F.col("strength") >= threshold)).select("bi", "bj")
    return strong.union(strong.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"))).distinct()


def signature(a: SparseMatrix) -> DataFrame:
    """One row ``(structure, values)`` of order-free 64-bit signatures. -0.0 and 0.0 count as equal (see :func:`bit_exact`)."""
    h, hv = F.xxhash64("i", "j"), F.xxhash64("i", "j", "v")
    return a.df.agg(F.coalesce(F.bit_xor(h), F.lit(0)).alias("structure"), F.coalesce(F.bit_xor(hv), F.lit(0)).alias("values"), F.count("*").alias("nnz"))


def told_by_blocks(a: SparseMatrix) -> dict:
    """What :func:`profile` and :func:`signature` tell of a square matrix that has packed blocks, in one pass over them.

    ``nnz``; ``positive``, the rows with a positive diagonal; ``bad``, an entry that is out of range or not finite, or None; ``structure``
    and ``values``; ``mirrored``, whether the pattern is symmetric, by uPw = wPu for two vectors of 64-bit numbers.
    """
    import numpy as np
    import pyarrow as pa

    from lattix.functions.hashes import mixed, xxhash64
    from lattix.solvers.backend import unpacked_rows

    nrows, ncols = a.nrows, a.ncols
    names = ["nnz", "positive", "structure", "values", "skew", "bi", "bj", "bv"]

    def tell(batches):
        nnz, positive, structure, values, skew, bad = 0, 0, np.uint64(0), np.uint64(0), np.uint64(0), (None, None, None)
        for batch in batches:
            for k in range(batch.num_rows):
                rows, counts, cols, vals = unpacked_rows(batch.slice(k, 1).to_pylist()[0], ncols)
                start = np.cumsum(counts) - counts
                i = np.repeat(rows, counts)
                wrong = np.flatnonzero((i < 0) | (i >= nrows) | (cols < 0) | (cols >= ncols) | ~np.isfinite(vals))
                if len(wrong):
                    bad = int(i[wrong[0]]), int(cols[wrong[0]]), float(vals[wrong[0]])
                nnz += len(vals)
                positive += int((vals[i == cols] > 0).sum())
                h = xxhash64(cols, np.repeat(xxhash64(rows), counts))
                structure ^= np.bitwise_xor.reduce(h)
                values ^= np.bitwise_xor.reduce(xxhash64(vals, h))
                u, w = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
                with np.errstate(over="ignore"):
                    skew += (mixed(rows, u) * np.add.reduceat(mixed(cols, w), start) - mixed(rows, w) * np.add.reduceat(mixed(cols, u), start)).sum(dtype=np.uint64)
        row = [nnz, positive, *[int(np.uint64(x).astype(np.int64)) for x in (structure, values, skew)], *bad]
        kinds = [pa.int64()] * 7 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names)

    told = a.blocks.mapInArrow(tell, ", ".join(f"{c} {'double' if c == 'bv' else 'long'}" for c in names)).collect()
    out = {"nnz": sum(t.nnz for t in told), "positive": sum(t.positive for t in told), "structure": 0, "values": 0}
    for t in told:
        out["structure"] ^= t.structure
        out["values"] ^= t["values"]
    out["mirrored"] = sum(t.skew for t in told) % (1 << 64) == 0
    out["bad"] = next(((t.bi, t.bj, t.bv) for t in told if t.bi is not None), None)
    return out


#: Entries of both matrices that :func:`bit_exact` exchanges at once.
SLICE_ENTRIES = 1 << 27


def bit_exact(a: SparseMatrix, b: SparseMatrix) -> bool:
    """Whether both hold the same entries bit for bit; the sign of a zero counts.

    Slices of rows are compared one after the other, as packed bytes, and a slice's exchange is deleted at its end.
    """
    from lattix.operators.meetings import differing
    from lattix.plans.storage import BATCH_BYTES, configured
    from lattix.solvers.backend import stored_entries

    slices = max(1, -(-(stored_entries(a) * 2) // SLICE_ENTRIES))
    cuts = [None, *[max(a.nrows, b.nrows) * k // slices for k in range(1, slices)], None]
    for lo, hi in zip(cuts, cuts[1:]):
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (F.col("i") >= lo)
        if hi is not None:
            inside = inside & ((F.col("i") < hi) | (F.col("i").isNull() & F.lit(lo is None)))
        with configured(a.spark, sweep="true", batch_bytes=BATCH_BYTES):
            if differing(a.df.where(inside), b.df.where(inside), max(a.nrows, b.nrows), lo or 0, hi).agg(F.sum("n")).first()[0]:
                return False
    return True


#: Rows up to which a dense factorisation may certify a matrix.
DENSE_MOST = 512


def classify_spd(a: SparseMatrix) -> str:
    """How the matrix is known to be SPD, or :class:`UnsupportedProblem`.

    Strict dominance; else weak dominance of an M-matrix each of whose components has a strictly
    dominant row; else a dense factorisation of at most :data:`DENSE_MOST` rows.
    """
    import numpy as np

    from lattix.operators.components import connected_components
    from lattix.schema import NumericalBreakdown, UnsupportedProblem

    a.need_square().validate()
    even = symmetry(a, 0.0).first()
    if even.missing_transpose or even.asymmetric:
        raise UnsupportedProblem("the matrix is not exactly symmetric")
    rows = dominance(a)
    told = rows.agg(F.count_if(F.col("diag") <= 0).alias("bad"), F.count_if(F.col("class") != "strict").alias("weak"), F.count_if(F.col("class") == "none").alias("none")).first()
    if told.bad:
        raise UnsupportedProblem("an SPD matrix has a positive diagonal")
    if not told.weak:
        return "strict_diagonal_dominance"
    if not told.none and not a.canonical().df.where("i <> j and v > 0").take(1):
        anchor = F.col("diag") > F.col("off") + 1e-12 * F.greatest(F.col("diag") + F.col("off"), F.lit(1.0))
        parts = connected_components(a.df.select(F.col("i").alias("src"), F.col("j").alias("dst")))
        loose = parts.withColumnRenamed("node", "i").join(rows.select("i", anchor.alias("anchor")), "i").groupBy("component").agg(F.bool_or("anchor").alias("held")).where("not held")
        if not loose.take(1):
            return "anchored_weak_diagonal_dominance"
    if a.nrows > DENSE_MOST:
        raise UnsupportedProblem(f"no dominance, and more than {DENSE_MOST} rows for a dense proof")
    from lattix.solvers.backend import LocalMatrix
    from lattix.solvers.precond import cholesky

    dense = LocalMatrix.collect(a).dense()
    try:
        low = cholesky(dense)
    except NumericalBreakdown as e:
        raise UnsupportedProblem("the dense factorisation fails") from e
    if (np.diag(low) ** 2).min() <= 1e-12 * max(1.0, np.diag(dense).max()):
        raise UnsupportedProblem("a pivot of the dense factorisation is too small")
    return "bounded_cholesky"


def rayleigh_screen(a: SparseMatrix) -> DataFrame:
    """One row ``smallest``: the least of four Rayleigh quotients (ones, alternating, ramp, probe). A screen, not a proof."""
    i = F.col("i")
    probes = {"ones": lambda i: F.lit(1.0), "alternating": lambda i: F.when(i % 2 == 0, 1.0).otherwise(-1.0), "ramp": lambda i: (i + 1).cast("double") / a.nrows, "probe": lambda i: (1 + (i * 17 + 11) % 101).cast("double")}
    up = a.df.agg(*[F.sum(f(i) * F.col("v") * f(F.col("j"))).alias(k) for k, f in probes.items()])
    down = a.rows().agg(*[F.sum(f(i) * f(i)).alias(f"n_{k}") for k, f in probes.items()])
    return up.crossJoin(F.broadcast(down)).select(F.least(*[F.col(k) / F.col(f"n_{k}") for k in probes]).alias("smallest"))
