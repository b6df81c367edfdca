"""Preconditioners.

Those that are a fixed sparse matrix (Jacobi, block Jacobi, overlapping Schwarz) are kept as one, so
applying them is a product on any backend. A two-level preconditioner adds P A_c⁻¹ Pᵀ, whose
dense coarse matrix has a bounded dimension and lives on the driver. Incomplete factors are
sequential by rows: those of a whole matrix live on the driver, for matrices that fit there, those of
each owner's block are made and applied where the block is.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.operators import algebra
from lattix.operators.partition import as_ranges
from lattix.operators.profile import need_diagonal
from lattix.plans.storage import BATCH_BYTES, configured, materialize
from lattix.schema import InvalidArgument, MissingDiagonal, NumericalBreakdown, SparseMatrix
from lattix.solvers import coarse as C
from lattix.solvers.backend import BLOCK_ENTRIES, LOCAL_NNZ, LocalMatrix, packed_rows, product_of, rows_of, run_of, spans, to_array, to_vector, unpacked_rows, with_copies

#: Most rows of a coarse matrix on the driver (dense doubles: 128 MB).
COARSE_MOST = 4096
#: Rows from which a dense local block is inverted in a call of its own.
SHARED_ROWS = 256


def cholesky(block: np.ndarray) -> np.ndarray:
    """Lower factor; asymmetry above 1e-11 or pivots at or below 1e-14 of the scale (at least 1) are errors."""
    scale = max(1.0, float(np.abs(block).max(initial=0.0)))
    if np.abs(block - block.T).max(initial=0.0) > 1e-11 * scale:
        raise NumericalBreakdown("a local matrix is not symmetric")
    try:
        lower = np.linalg.cholesky((block + block.T) / 2)
    except np.linalg.LinAlgError as e:
        raise NumericalBreakdown("a local matrix is not positive definite") from e
    if (np.diag(lower) ** 2).min(initial=np.inf) <= 1e-14 * scale:
        raise NumericalBreakdown("a local pivot vanishes")
    return lower


def inverse(block: np.ndarray) -> np.ndarray:
    low = np.linalg.inv(cholesky(block))
    return low.T @ low


def inverses(blocks: np.ndarray) -> np.ndarray:
    """:func:`inverse` of many small blocks of one size at once."""
    scale = np.maximum(1.0, np.abs(blocks).max(axis=(1, 2)))
    turned = blocks.transpose(0, 2, 1)
    if (np.abs(blocks - turned).max(axis=(1, 2)) > 1e-11 * scale).any():
        raise NumericalBreakdown("a local matrix is not symmetric")
    try:
        lower = np.linalg.cholesky((blocks + turned) / 2)
    except np.linalg.LinAlgError as e:
        raise NumericalBreakdown("a local matrix is not positive definite") from e
    if ((np.diagonal(lower, axis1=1, axis2=2) ** 2).min(axis=1) <= 1e-14 * scale).any():
        raise NumericalBreakdown("a local pivot vanishes")
    low = np.linalg.inv(lower)
    return np.einsum("kji,kjl->kil", low, low)


class Identity:
    def apply(self, r: DataFrame) -> DataFrame:
        return r

    def solve(self, r: np.ndarray) -> np.ndarray:
        return r.copy()


class MatrixPreconditioner:
    """z = M⁻¹ r with an explicit sparse M⁻¹."""

    def __init__(self, minv: SparseMatrix, factor_bytes: int = 0):
        self.minv, self.factor_bytes, self._local = minv, factor_bytes, None

    def apply(self, r: DataFrame) -> DataFrame:
        return algebra.spmv(self.minv, r)

    def solve(self, r: np.ndarray) -> np.ndarray:
        if self._local is None:
            self._local = product_of(self.minv)
        return self._local(r)


class Jacobi(MatrixPreconditioner):
    """1 / diagonal: strictly positive for SPD problems, merely not zero in general."""

    @classmethod
    def from_matrix(cls, a: SparseMatrix, general: bool = False) -> Jacobi:
        d = need_diagonal(a.need_square(), positive=not general)
        out = cls(SparseMatrix(d.select("i", F.col("i").alias("j"), (1 / F.col("v")).alias("v")), a.nrows, a.ncols))
        out.diagonal_df = d
        return out

    def apply(self, r: DataFrame) -> DataFrame:
        return r.join(self.diagonal_df.select("i", F.col("v").alias("d")), "i").select("i", (F.col("v") / F.col("d")).alias("v"))


def block_inverses(a: SparseMatrix, region: DataFrame) -> DataFrame:
    """``(block, i, j, v)``: inverses of the symmetric blocks ``(block, i)``, one dense factor each."""
    same = a.df.join(region.select("block", "i"), "i").join(region.select("block", F.col("i").alias("j")), ["block", "j"]).select("block", "i", "j", "v")

    def invert(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame.block.to_numpy(), kind="stable")
        block, i, j, v = (frame[c].to_numpy()[order] for c in ("block", "i", "j", "v"))
        out = []
        for s, e in zip(*_runs(block), strict=True):
            rows, own = np.unique(np.concatenate([i[s:e], j[s:e]]), return_inverse=True)
            n = len(rows)
            dense = np.zeros((n, n))
            np.add.at(dense, (own[: e - s], own[e - s :]), v[s:e])
            out.append((np.full(n * n, block[s]), np.repeat(rows, n), np.tile(rows, n), inverse(dense).reshape(-1)))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("block", "i", "j", "v"), zip(*out, strict=True), strict=True)})

    # small blocks share a call, at most 128 of them; one of SHARED_ROWS rows or more has a call of its own, so a call's dense
    # blocks hold 64 MB or one block
    sizes = region.groupBy("block").agg(F.count("*").alias("rows")).where(F.col("rows") >= SHARED_ROWS).select("block", F.lit(True).alias("large"))
    batch = F.when(F.col("large"), F.struct(F.lit(1).alias("large"), F.col("block").alias("number"))).otherwise(F.struct(F.lit(0).alias("large"), F.shiftright("block", 7).alias("number")))
    return same.join(sizes, "block", "left").withColumn("batch", batch).select("batch", "block", "i", "j", "v").groupBy("batch").applyInPandas(invert, "block bigint, i bigint, j bigint, v double")


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values."""
    start = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    return start, np.append(start[1:], len(sorted_values))


def block_jacobi(a: SparseMatrix, width: int, owners: DataFrame | None = None) -> MatrixPreconditioner:
    """Dense Cholesky of contiguous blocks (the last may be short); with ``owners`` blocks don't cross owners."""
    if width < 1:
        raise InvalidArgument("blocks need at least one row")
    if owners is None:
        near = a.df.where(F.floor(F.col("i") / width) == F.floor(F.col("j") / width))
        region = a.rows().select(F.floor(F.col("i") / width).alias("block"), "i")
    else:
        from pyspark.sql import Window

        local = F.row_number().over(Window.partitionBy("owner").orderBy("i")) - 1
        wide = owners.withColumn("b", F.floor(local / width))
        region = wide.select((F.col("owner").cast("long") * F.lit(1 << 40) + F.col("b")).alias("block"), "i")
        near = a.df
    inv = materialize(block_inverses(SparseMatrix(near, a.nrows, a.ncols), region), "block-jacobi")
    return MatrixPreconditioner(SparseMatrix(inv.select("i", "j", "v"), a.nrows, a.ncols))


def schwarz(a: SparseMatrix, regions: DataFrame) -> MatrixPreconditioner:
    """Overlapping regions ``(region, i)`` weighted by 1/√multiplicity on both sides, Jacobi on rows in none."""
    own = regions.select(F.col("region").cast("long").alias("block"), "i").distinct()
    inv = materialize(block_inverses(a, own), "schwarz-inverses")
    m = own.groupBy("i").agg((1 / F.sqrt(F.count("*"))).alias("w"))
    local = inv.join(m, "i").join(m.select(F.col("i").alias("j"), F.col("w").alias("u")), "j").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("v") * F.col("u")).alias("v"))
    rest = need_diagonal(a, positive=True).join(m, "i", "left_anti").select("i", F.col("i").alias("j"), (1 / F.col("v")).alias("v"))
    return MatrixPreconditioner(SparseMatrix(materialize(local.select("i", "j", "v").union(rest), "schwarz"), a.nrows, a.ncols))


class TwoLevel:
    """B⁻¹ + P A_c⁻¹ Pᵀ (additive), or the balanced form (I - C A) B⁻¹ (I - A C) + C with C = P A_c⁻¹ Pᵀ."""

    def __init__(self, a: SparseMatrix, base, transfer: SparseMatrix, balanced: bool = False, single: bool = False):
        if transfer.ncols > COARSE_MOST:
            raise InvalidArgument(f"a coarse space of {transfer.ncols} exceeds {COARSE_MOST}")
        self.a, self.base, self.balanced = a, base, balanced
        if single:  # weights kept in single precision
            transfer = SparseMatrix(transfer.df.withColumn("v", F.col("v").cast("float").cast("double")), transfer.nrows, transfer.ncols)
        self.transfer = SparseMatrix(materialize(transfer.df, "transfer"), transfer.nrows, transfer.ncols)
        self.coarse = LocalMatrix.collect(algebra.galerkin(a, self.transfer)).dense()
        self.coarse = (self.coarse + self.coarse.T) / 2
        if not np.isfinite(self.coarse).all() or not np.abs(self.coarse).max(initial=0.0):
            raise NumericalBreakdown("the coarse matrix is zero or not finite")
        self.inverse = inverse(self.coarse)
        self.dimension, self._local = transfer.ncols, None

    def correct(self, r: DataFrame) -> DataFrame:
        """P A_c⁻¹ Pᵀ r: only vectors of the coarse dimension visit the driver."""
        down = to_array(algebra.products(algebra.transpose(self.transfer), r), self.dimension)
        return algebra.spmv(self.transfer, to_vector(self.a.spark, self.inverse @ down))

    def apply(self, r: DataFrame) -> DataFrame:
        c = self.correct(r)
        if not self.balanced:
            return algebra.axpy(1.0, self.base.apply(r), c)
        z = self.base.apply(algebra.axpy(-1.0, algebra.spmv(self.a, c), r))
        return algebra.axpy(1.0, c, algebra.axpy(-1.0, self.correct(algebra.spmv(self.a, z)), z))

    def solve(self, r: np.ndarray) -> np.ndarray:
        if self._local is None:
            self._local = (product_of(self.transfer), product_of(algebra.transpose(self.transfer)), product_of(self.a) if self.balanced else None)
        p, pt, a = self._local
        c = p(self.inverse @ pt(r))
        if not self.balanced:
            return self.base.solve(r) + c
        z = self.base.solve(r - a(c))
        return z - p(self.inverse @ pt(a(z))) + c


def two_level(a: SparseMatrix, dofs: int = 3, target_dimension: int = 1536, aggregation: str = "contiguous", basis: str = "piecewise_constant", nodes: int | None = None, single: bool = False) -> TwoLevel:
    """Block Jacobi of node blocks and an algebraic coarse space."""
    nodes = nodes or C.recommended_nodes(a.nrows, dofs, target_dimension)
    if aggregation == "contiguous":
        aggregates, count = C.contiguous_aggregates(a, dofs, nodes)
    else:
        aggregates, count = C.graph_aggregates(a, dofs, nodes, 0.08 if aggregation == "strong_graph" else 0.0)
    transfer = C.piecewise_transfer(a, dofs, aggregates, count)
    if basis == "jacobi_smoothed":
        transfer = C.smoothed_transfer(a, transfer)
    return TwoLevel(a, Jacobi.from_matrix(a) if dofs == 1 else block_jacobi(a, dofs), transfer, single=single)


class NodeJacobi:
    """Inverses of the dense blocks of ``width`` rows on the diagonal, on the driver: their lower triangles, place by place, without those that are 0 throughout."""

    def __init__(self, a: SparseMatrix, width: int):
        ncols, n = a.ncols, a.nrows

        def near(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    c = row.pop("copies", 1)
                    rows, counts, cols, vals = unpacked_rows(row, ncols // c)
                    if c > 1 and width % c == 0:  # only entries of a block itself need copies
                        inside = np.repeat(rows // (width // c), counts) == cols // (width // c)
                        counts = np.add.reduceat(inside, np.cumsum(counts) - counts, dtype=np.int32)
                        cols, vals = cols[inside], vals[inside]
                        rows, counts = rows[counts > 0], counts[counts > 0]
                        if not len(rows):
                            continue
                    if c > 1:
                        rows, counts, cols, vals = with_copies([rows, counts, cols, vals], c, ncols)
                    at = np.repeat(np.arange(len(rows)), counts)
                    own = np.flatnonzero((rows // width)[at] == cols // width)
                    band = np.zeros((len(rows), width))
                    band[at[own], cols[own] % width] = vals[own]
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (run_of(rows), band)], ["rows", "band"])

        blocks = -(-n // width)
        dense = np.zeros((blocks * width, width))
        dense[np.arange(n, blocks * width), np.arange(n, blocks * width) % width] = 1.0
        got = a.blocks.mapInArrow(near, "rows binary, band binary").toArrow()
        for rows, band in zip(got.column("rows"), got.column("band"), strict=True):
            dense[rows_of(rows.as_buffer())] = np.frombuffer(band.as_buffer(), np.float64).reshape(-1, width)
        del got, rows, band
        pa.default_memory_pool().release_unused()
        self.n, self.width, dense = n, width, dense.reshape(-1, width, width)
        for s in range(0, blocks, BLOCK_ENTRIES // (width * width)):
            part = dense[s : s + BLOCK_ENTRIES // (width * width)]
            part[:] = inverses(part)
        self.places = {(i, j): dense[:, i, j].copy() for i in range(width) for j in range(i + 1) if dense[:, i, j].any()}

    def solve(self, r: np.ndarray) -> np.ndarray:
        full = np.append(r, np.zeros(-len(r) % self.width)).reshape(-1, self.width) if len(r) % self.width else r.reshape(-1, self.width)
        out = np.zeros(full.shape)
        for (i, j), v in self.places.items():
            out[:, i] += v * full[:, j]
            if i != j:
                out[:, j] += v * full[:, i]
        return out.ravel()[: self.n]


class RigidBody:
    """:class:`TwoLevel` of rigid-body modes for vectors that fit the driver; the matrix stays in its blocks.

    A row has three entries of the transfer: one for its own direction and two rotations, which follow from its node's offset. So it
    is kept as an aggregate and an offset for each node, and the coarse matrix is summed up where the entries are.
    """

    #: The two rotations that move a node's first, second and third direction.
    TURNS = np.array([[4, 5], [3, 5], [3, 4]])
    #: By which of the offset's coordinates, and with which sign.
    ARMS = (((2, 1.0), (1, -1.0)), ((2, -1.0), (0, 1.0)), ((1, 1.0), (0, -1.0)))

    def __init__(self, a: SparseMatrix, offsets: np.ndarray, own: np.ndarray, count: int, balanced: bool = False):
        self.a, self.balanced, self.own, self.count, self.dimension, self._product = a, balanced, own.astype(np.int32), count, 6 * count, None
        self.offsets = np.ascontiguousarray(offsets.T)
        self.base = NodeJacobi(a, 3)
        self.coarse = self._galerkin()
        self.coarse = (self.coarse + self.coarse.T) / 2
        if not np.isfinite(self.coarse).all() or not np.abs(self.coarse).max(initial=0.0):
            raise NumericalBreakdown("the coarse matrix is zero or not finite")
        self.inverse = inverse(self.coarse)

    def _galerkin(self) -> np.ndarray:
        spark, ncols, count, modes, arms = self.a.spark, self.a.ncols, self.count, self.TURNS, self.ARMS
        sent = spark.sparkContext.broadcast((self.own, self.offsets))

        def sums(batches):
            own, offsets = sent.value
            first, second = (np.stack([sign * offsets[axis] for axis, sign in turn], 1).ravel() for turn in zip(*arms, strict=True))
            place, pairs, total = np.full(count * count, -1), np.zeros(0, np.int64), np.zeros((9, 0))
            for batch in batches:
                for k in range(batch.num_rows):
                    rows, counts, cols, vals = unpacked_rows(batch.slice(k, 1).to_pylist()[0], ncols)
                    pair = np.repeat(own[rows // 3].astype(np.int64) * count, counts) + own[cols // 3]
                    seen = np.zeros(count * count, bool)
                    seen[pair] = True
                    new = np.flatnonzero(seen & (place < 0))
                    place[new] = np.arange(len(pairs), len(pairs) + len(new))
                    pairs, total = np.append(pairs, new), np.concatenate([total, np.zeros((9, 9 * len(new)))], 1)
                    key = place[pair] * 9 + np.repeat(rows % 3 * 3, counts) + cols % 3
                    right = (vals, vals * first[cols], vals * second[cols])
                    for at, left in enumerate((None, first, second)):
                        scale = None if left is None else np.repeat(left[rows], counts)
                        for to, x in enumerate(right):
                            total[3 * at + to] += np.bincount(key, x if scale is None else scale * x, total.shape[1])
            at, key = np.divmod(np.arange(total.size), max(total.shape[1], 1))
            (gi, gj), (c, d), (s, t) = np.divmod(pairs[key // 9], count), np.divmod(key % 9, 3), np.divmod(at, 3)
            mi, mj = (np.where(turn == 0, c0, modes[c0, np.maximum(turn - 1, 0)]) for turn, c0 in ((s, c), (t, d)))
            v = total.ravel()
            keep = v != 0  # not a number counts too
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (gi * 6 + mi, gj * 6 + mj, v)], ["i", "j", "v"])

        got = self.a.blocks.mapInArrow(sums, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
        sent.destroy()
        out = np.zeros((self.dimension, self.dimension))
        out[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("v").to_numpy()
        return out

    def restrict(self, r: np.ndarray) -> np.ndarray:
        down = np.zeros((self.count, 6))
        for c in range(3):
            down[:, c] += np.bincount(self.own, r[c::3], self.count)
            for (axis, sign), mode in zip(self.ARMS[c], self.TURNS[c], strict=True):
                down[:, mode] += sign * np.bincount(self.own, self.offsets[axis] * r[c::3], self.count)
        return down.ravel()

    def prolong(self, coarse: np.ndarray) -> np.ndarray:
        up, out = coarse.reshape(-1, 6), np.empty(3 * len(self.own))
        for c in range(3):
            out[c::3] = up[self.own, c]
            for (axis, sign), mode in zip(self.ARMS[c], self.TURNS[c], strict=True):
                out[c::3] += self.offsets[axis] * (sign * up[:, mode])[self.own]
        return out

    def solve(self, r: np.ndarray) -> np.ndarray:
        c = self.prolong(self.inverse @ self.restrict(r))
        if not self.balanced:
            c += self.base.solve(r)
            return c
        if self._product is None:
            self._product = product_of(self.a)
        z = self.base.solve(r - self._product(c))
        return z - self.prolong(self.inverse @ self.restrict(self._product(z))) + c


def rigid_body(a: SparseMatrix, coords: DataFrame, target_dimension: int = 1536, aggregation: str = "graph", balanced: bool = False, arrays: bool = False, mirrored: bool = False) -> TwoLevel | RigidBody:
    """3 x 3 block Jacobi and six rigid-body modes of each aggregate of at least three nodes.

    With ``arrays`` it is made from a matrix' blocks and applied to arrays only; ``mirrored`` tells that their pattern is symmetric.
    """
    n = a.nrows // 3
    nodes = C.recommended_rigid_nodes(n, target_dimension)
    placed = C.node_coordinates(coords, n) if arrays and a.blocks is not None else None
    if placed is None:
        aggregates, count = C.graph_aggregates(a, 3, nodes, least=3) if aggregation == "graph" else C.contiguous_aggregates(a, 3, nodes)
        return TwoLevel(a, block_jacobi(a, 3), C.rigid_transfer(a, coords, aggregates, count), balanced)
    if aggregation == "graph":
        near = C.NodeRows(a, 3) if mirrored else C.adjacency(C.node_graph(a, 3), n)
        own, count = C.grow_aggregates(near, nodes, 3)
    else:
        own, count = np.arange(n) // nodes, -(-n // nodes)
    if 6 * count > COARSE_MOST:
        raise InvalidArgument(f"a coarse space of {6 * count} exceeds {COARSE_MOST}")
    return RigidBody(a, C.rigid_offsets(placed, own, count), own, count, balanced)


def rank_constant(a: SparseMatrix, owners: DataFrame) -> TwoLevel:
    """Jacobi and one coarse vector for each rank, scaled to length one."""
    from lattix.operators.partition import counts

    ranks = owners.join(counts(owners), "owner").select("i", F.col("owner").cast("long").alias("j"), (1 / F.sqrt("rows")).alias("v"))
    return TwoLevel(a, Jacobi.from_matrix(a), SparseMatrix(ranks, a.nrows, owners.agg(F.max("owner")).first()[0] + 1))


def selected_blocks(a: SparseMatrix, scores: DataFrame, width: int) -> MatrixPreconditioner:
    """Dense factors on the blocks that :func:`lattix.operators.partition.score_blocks` took, Jacobi elsewhere."""
    taken = scores.where("taken").select("block")
    region = a.rows().withColumn("block", F.floor(F.col("i") / width)).join(taken, "block", "left_semi").select("block", "i")
    inv = materialize(block_inverses(a, region), "selected").select("i", "j", "v")
    rest = need_diagonal(a, positive=True).join(region, "i", "left_anti").select("i", F.col("i").alias("j"), (1 / F.col("v")).alias("v"))
    return MatrixPreconditioner(SparseMatrix(inv.union(rest), a.nrows, a.ncols))


def make(kind: str, a: SparseMatrix, owners: DataFrame | None = None, width: int = 32, general: bool = False):
    """A preconditioner by name."""
    made = {
        "identity": Identity,
        "jacobi": lambda: Jacobi.from_matrix(a, general),
        "block_jacobi": lambda: block_jacobi(a, width),
        "local_block_cholesky": lambda: block_jacobi(a, width, owners),
        "local_ic0": lambda: ic0_blocks(a, owners),
        "local_ilu0": lambda: ilu0_blocks(a, owners),
        "rank_constant": lambda: rank_constant(a, owners),
        "ilu0": lambda: Ilu0(a),
        "ilu0_identity_fallback": lambda: Ilu0(a, True),
    }
    if kind not in made:
        raise InvalidArgument(f"no preconditioner {kind}")
    return made[kind]()


class Ilu0:
    """Incomplete LU without fill, by rows on the driver.

    A pivot below 1e-12 of its row's largest entry is an error; with ``identity_fallback`` a missing
    diagonal turns its row into the identity instead.
    """

    FLOOR = 1e-12

    def __init__(self, a: SparseMatrix | LocalMatrix, identity_fallback: bool = False):
        a = a if isinstance(a, LocalMatrix) else LocalMatrix.collect(a.need_square())
        self.n, rows = a.nrows, []
        for i in range(a.nrows):
            cols, vals = a.row(i)
            if i not in cols:
                if not identity_fallback:
                    raise MissingDiagonal(f"row {i} has no diagonal entry")
                cols, vals = np.array([i]), np.array([1.0])
            rows.append((cols, vals.copy()))
        where = [{int(c): k for k, c in enumerate(cols)} for cols, _ in rows]
        for i, (cols, vals) in enumerate(rows):
            scale, at = np.abs(vals).max(), where[i]
            for k, c in enumerate(cols):
                if c >= i:
                    break
                upper_cols, upper = rows[c]
                own = where[c][int(c)]
                vals[k] /= upper[own]
                for m in range(own + 1, len(upper_cols)):
                    hit = at.get(int(upper_cols[m]))
                    if hit is not None:
                        vals[hit] -= vals[k] * upper[m]
            if abs(vals[at[i]]) <= self.FLOOR * max(scale, np.finfo(float).tiny) or not np.isfinite(vals).all():
                raise NumericalBreakdown(f"pivot of row {i} vanishes")
        self.rows, self.pivot = rows, [where[i][i] for i in range(a.nrows)]

    def solve(self, r: np.ndarray) -> np.ndarray:
        y = r.astype(float).copy()
        for i, (cols, vals) in enumerate(self.rows):
            k = self.pivot[i]
            y[i] -= vals[:k] @ y[cols[:k]]
        for i in range(self.n - 1, -1, -1):
            cols, vals = self.rows[i]
            k = self.pivot[i]
            y[i] = (y[i] - vals[k + 1 :] @ y[cols[k + 1 :]]) / vals[k]
        return y

    def levels(self) -> tuple[np.ndarray, np.ndarray]:
        """Depth of each row in the forward and the backward solve."""
        low, up = np.zeros(self.n, int), np.zeros(self.n, int)
        for i, (cols, _) in enumerate(self.rows):
            before = cols[: self.pivot[i]]
            low[i] = low[before].max() + 1 if len(before) else 0
        for i in range(self.n - 1, -1, -1):
            after = self.rows[i][0][self.pivot[i] + 1 :]
            up[i] = up[after].max() + 1 if len(after) else 0
        return low, up


class OwnerFactors:
    """Incomplete factors without fill of each owner's own block, kept sparse where the owner's rows are.

    A row of ``packed`` holds whole rows of one owner's factor as bytes: global rows, entries of each, local columns and values, and
    each row's level. An owner's block arrives in such pieces and is factored in a file in its task's temporary folder, so that a worker
    holds a few numbers for each row. Rows of a level don't need each other and are solved for together. Factors of at most ``LOCAL_NNZ`` entries in all are applied on the driver; larger ones where they are
    stored, with the vector broadcast (:meth:`solve`) or as a table (:meth:`apply`).
    """

    def __init__(self, a: SparseMatrix, owners: DataFrame, symmetric: bool):
        ranks = min((owners.agg(F.max("owner")).first()[0] or 0) + 1, MOST_TASKS)
        near = _own_blocks(a, owners, symmetric).repartitionById(ranks, "owner").sortWithinPartitions("owner", "at")

        n = a.ncols

        def factor(batches):
            for owner, held in _held(batches, n):
                rows, ptr, col, val = held.arrays(local=True)
                (_incomplete_cholesky if symmetric else _incomplete_lu)(ptr, col, val)
                level = _levels(ptr, col)
                s = 0
                while s < len(rows):
                    e = max(s + 1, int(np.searchsorted(ptr, ptr[s] + BLOCK_ENTRIES, "right")) - 1)
                    part = slice(ptr[s], ptr[e])
                    piece = _piece(owner, int(rows[s]), rows[s:e], np.diff(ptr[s : e + 1]), col[part], val[part])
                    yield piece.append_column("levels", pa.array([level[s:e].tobytes()], pa.binary()))
                    s = e

        self.packed = materialize(near.mapInArrow(factor, f"{_PIECE}, levels binary"), "owner-factors")
        self.owners, self.nrows, self.symmetric = owners, a.nrows, symmetric
        self.local = self.packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= LOCAL_NNZ
        self._factors = None

    def apply(self, r: DataFrame) -> DataFrame:
        symmetric = self.symmetric

        def solve(factor: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            rows, *parts = _joined(factor.sort_values("at").to_dict("records"))
            x = np.zeros(len(rows))
            at = np.searchsorted(rows, own.i.to_numpy())
            x[at] = own.v.to_numpy()
            return pd.DataFrame({"i": rows, "v": _triangular(*parts, x, symmetric)})

        dealt = r.join(self.owners, "i").select("owner", "i", "v")
        return self.packed.groupBy("owner").cogroup(dealt.groupBy("owner")).applyInPandas(solve, "i bigint, v double")

    def solve(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.nrows)
        if self.local:
            if self._factors is None:
                owned = {}
                for f in self.packed.orderBy("owner", "at").toLocalIterator():
                    owned.setdefault(f.owner, []).append(f.asDict())
                self._factors = [_joined(f) for f in owned.values()]
            for rows, *parts in self._factors:
                out[rows] = _triangular(*parts, r[rows], self.symmetric)
            return out
        spark, symmetric, n = self.packed.sparkSession, self.symmetric, self.nrows
        sent = spark.sparkContext.broadcast(np.asarray(r, np.float64))

        def run(batches):
            for _, held in _held(batches, n):
                rows, *parts = held.arrays()
                x = _triangular(*parts, sent.value[rows], symmetric)
                yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["rows", "x"])

        # a file holds all pieces of its owners, in order; a task reads one whole file
        with configured(spark, split_bytes=str(1 << 40), batch_bytes=BATCH_BYTES):
            for f in self.packed.mapInArrow(run, "rows binary, x binary").toLocalIterator():
                out[np.frombuffer(f.rows, np.int64)] = np.frombuffer(f.x, np.float64)
        sent.unpersist()
        return out


_PIECE = "owner int, at long, n long, rows binary, counts binary, cols binary, vals binary"
#: Tasks that owners are dealt to at most.
MOST_TASKS = 10_000


def _piece(owner: int, at: int, rows: np.ndarray, counts: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> pa.RecordBatch:
    packed = (np.asarray(x, k).tobytes() for x, k in ((rows, np.int64), (counts, np.int32), (cols, np.int32 if not len(cols) or cols.max() < 1 << 31 else np.int64), (vals, np.float64)))
    return pa.RecordBatch.from_arrays([pa.array([owner], pa.int32()), pa.array([at], pa.int64()), pa.array([len(vals)], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]], ["owner", "at", "n", "rows", "counts", "cols", "vals"])


def _arrays(piece: dict) -> list[np.ndarray]:
    cols = np.int32 if 2 * len(piece["cols"]) == len(piece["vals"]) else np.int64
    kinds = {"rows": np.int64, "counts": np.int32, "cols": cols, "vals": np.float64, "levels": np.int32}
    return [np.frombuffer(piece[c], kind) for c, kind in kinds.items() if c in piece]


def _own_blocks(a: SparseMatrix, owners: DataFrame, lower: bool) -> DataFrame:
    """Pieces of each owner's own block with global columns, whole rows in order by ``at``; with ``lower`` up to the diagonal."""
    spans = sorted(as_ranges(owners).collect(), key=lambda s: s.lo)
    if all(s.contiguous for s in spans):
        lo, hi, owner = (np.array([s[c] for s in spans], np.int64) for c in ("lo", "hi", "owner"))
        ncols = a.ncols

        def cut(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    rows, counts, j, v = unpacked_rows(batch.slice(k, 1).to_pylist()[0], ncols)
                    i, j = np.repeat(rows, counts), j.astype(np.int64)
                    at, other = np.searchsorted(lo, i, "right") - 1, np.searchsorted(lo, j, "right") - 1
                    keep = (at == other) & (at >= 0) & (i < hi[at]) & (j < hi[at])
                    if lower:
                        keep &= j <= i
                    at, i, j, v = at[keep], i[keep], j[keep], v[keep]
                    for s, e in zip(*_runs(at), strict=True) if len(at) else ():
                        first, _ = _runs(i[s:e])
                        yield _piece(int(owner[at[s]]), int(i[s]), i[s:e][first], np.diff(np.append(first, e - s)), j[s:e], v[s:e])

        blocks = packed_rows(a.df, a.nrows, a.ncols) if a.blocks is None else a.blocks
        return blocks.mapInArrow(cut, _PIECE)
    cols = owners.select(F.col("i").alias("j"), F.col("owner").alias("o"))
    near = a.df.join(owners, "i").join(cols, "j").where("owner = o and j <= i" if lower else "owner = o").groupBy("owner", "i", "j").agg(F.sum("v").alias("v"))

    def row(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("j")
        i = frame.i.to_numpy()[:1]
        return _piece(int(frame.owner.iloc[0]), int(i[0]), i, np.array([len(frame)]), frame.j.to_numpy(), frame.v.to_numpy()).to_pandas()

    return near.groupBy("owner", "i").applyInPandas(row, _PIECE)


class _Held:
    """The pieces of one owner's block: rows, their entries' number and levels in memory, columns and values in files."""

    def __init__(self, n: int):
        self.kinds = (np.int32 if n < 1 << 31 else np.int64, np.float64)
        self.rows, self.counts, self.levels, self.files = [], [], [], [tempfile.TemporaryFile(), tempfile.TemporaryFile()]

    def add(self, rows: np.ndarray, counts: np.ndarray, col: np.ndarray, val: np.ndarray, *levels: np.ndarray) -> None:
        self.rows.append(rows)
        self.counts.append(counts)
        self.levels += levels
        for f, x, kind in zip(self.files, (col, val), self.kinds, strict=True):
            f.write(x.astype(kind).tobytes())

    def arrays(self, local: bool = False) -> list[np.ndarray]:
        """Rows, row pointers, columns, values and, of factors, levels; with ``local`` columns become places among the rows."""
        rows, ptr = np.concatenate(self.rows), np.append(0, np.cumsum(np.concatenate(self.counts), dtype=np.int64))
        for f in self.files:
            f.flush()
        col, val = (np.asarray(np.memmap(f, kind, "r+")) for f, kind in zip(self.files, self.kinds, strict=True))
        for s in range(0, len(col) if local else 0, BLOCK_ENTRIES):
            old = col[s : s + BLOCK_ENTRIES].copy()
            new = np.minimum(np.searchsorted(rows, old), len(rows) - 1)
            if (rows[new] != old).any():
                raise MissingDiagonal("a row of an owner's block has no diagonal entry")
            col[s : s + BLOCK_ENTRIES] = new
        return [rows, ptr, col, val, *([np.concatenate(self.levels)] if self.levels else [])]


def _held(batches, n: int):
    """``(owner, pieces)`` one owner after the other, of pieces sorted by owner, of a matrix of n columns."""
    owner, held = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            piece = batch.slice(k, 1).to_pylist()[0]
            if piece["owner"] != owner:
                if held:
                    yield owner, held
                owner, held = piece["owner"], _Held(n)
            held.add(*_arrays(piece))
    if held:
        yield owner, held


def _joined(pieces: list[dict]) -> tuple[np.ndarray, ...]:
    rows, counts, col, val, level = (np.concatenate(x) for x in zip(*map(_arrays, pieces), strict=True))
    return rows, np.append(0, np.cumsum(counts, dtype=np.int64)), col, val, level


#: Entries of other rows that a row is reduced by in one step, and steps in which that settles, else it goes entry by entry.
STEP_ENTRIES, STEPS = 1 << 18, 24


def _incomplete_cholesky(ptr: np.ndarray, col: np.ndarray, val: np.ndarray) -> None:
    """L in place of the lower triangle, row by row.

    The entries x of a row solve a small triangular system, made of those entries of the rows in its columns that lie in its columns
    too. It has few of them in a sparse matrix, so substitution of all entries at once settles in as many steps as they have levels.
    """
    work, place = np.zeros(len(ptr) - 1), np.full(len(ptr) - 1, -1)
    end = _diagonals(ptr, col)
    length, pivots = end - ptr[:-1], np.zeros(len(ptr) - 1)
    for r in range(len(ptr) - 1):
        a, d = ptr[r], end[r]
        cols = col[a:d]
        each = length[cols]
        x = None
        if each.sum() <= STEP_ENTRIES:
            place[cols] = np.arange(d - a)
            flat = spans(ptr[cols], each)
            at = place[col[flat]]
            hit = np.flatnonzero(at >= 0)
            x = _substituted(val[a:d], pivots[cols], np.repeat(np.arange(d - a), each)[hit], at[hit], val[flat[hit]])
            place[cols] = -1
        if x is None:
            for k in range(a, d):
                c = col[k]
                y = val[k] = (val[k] - val[ptr[c] : end[c]] @ work[col[ptr[c] : end[c]]]) / pivots[c]
                work[c] = y
            work[cols] = 0.0
        else:
            val[a:d] = x
        pivot = val[d] - val[a:d] @ val[a:d]
        if not pivot > 0:
            raise NumericalBreakdown("an incomplete pivot is not positive")
        val[d] = pivots[r] = np.sqrt(pivot)


def _substituted(b: np.ndarray, diagonal: np.ndarray, row: np.ndarray, other: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    """x of ``diagonal * x + L x = b`` with L strictly lower of entries (row, other, v); None if it doesn't settle in ``STEPS``."""
    x = b / diagonal
    for _ in range(STEPS if len(row) else 0):
        before, x = x, (b - np.bincount(row, v * x[other], len(b))) / diagonal
        if (x == before).all():
            return x
    return None if len(row) else x


def _incomplete_lu(ptr: np.ndarray, col: np.ndarray, val: np.ndarray) -> None:
    """In place: the strict lower places hold L (unit diagonal), the others U."""
    work, mark = np.zeros(len(ptr) - 1), np.full(len(ptr) - 1, -1)
    end = _diagonals(ptr, col)
    for r in range(len(ptr) - 1):
        own = slice(ptr[r], ptr[r + 1])
        cols = col[own]
        scale = np.abs(val[own]).max()
        work[cols], mark[cols] = val[own], r
        for c in cols[: end[r] - ptr[r]]:
            work[c] /= val[end[c]]
            upper = slice(end[c] + 1, ptr[c + 1])
            hit = mark[col[upper]] == r
            work[col[upper][hit]] -= work[c] * val[upper][hit]
        val[own] = work[cols]
        if not abs(val[end[r]]) > Ilu0.FLOOR * max(scale, np.finfo(float).tiny):
            raise NumericalBreakdown(f"pivot of local row {r} vanishes")


def _diagonals(ptr: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Where each row's diagonal stands."""
    out, s = [], 0
    while s < len(ptr) - 1:
        e = max(s + 1, int(np.searchsorted(ptr, ptr[s] + BLOCK_ENTRIES, "right")) - 1)
        row = np.repeat(np.arange(s, e), np.diff(ptr[s : e + 1]))
        out.append(np.flatnonzero(col[ptr[s] : ptr[e]] == row) + ptr[s])
        s = e
    at = np.concatenate(out) if out else np.zeros(0, np.int64)
    if len(at) != len(ptr) - 1:
        raise MissingDiagonal("a row of an owner's block has no diagonal entry")
    return at


def _levels(ptr: np.ndarray, col: np.ndarray) -> np.ndarray:
    """A level for each row, above those of all rows before it that it shares an entry with, in either triangle."""
    level = np.zeros(len(ptr) - 1, np.int32)
    end = _diagonals(ptr, col)
    for r in range(len(level)):
        low, up = col[ptr[r] : end[r]], col[end[r] + 1 : ptr[r + 1]]
        if len(low):
            level[r] = max(level[r], level[low].max() + 1)
        if len(up):
            level[up] = np.maximum(level[up], level[r] + 1)
    return level


def _triangular(ptr: np.ndarray, col: np.ndarray, val: np.ndarray, level: np.ndarray, r: np.ndarray, symmetric: bool) -> np.ndarray:
    """The forward and the backward solve with factors as above, the rows of a level together, about ``BLOCK_ENTRIES`` entries at a time."""
    end, x = _diagonals(ptr, col), r.astype(float).copy()
    order = np.argsort(level, kind="stable")
    entries = np.append(0, np.cumsum(np.diff(ptr)[order]))
    groups = []
    for s, e in zip(*_runs(level[order]), strict=True) if len(order) else ():
        while s < e:
            stop = min(e, max(s + 1, int(np.searchsorted(entries, entries[s] + BLOCK_ENTRIES, "right")) - 1))
            groups.append(order[s:stop])
            s = stop
    for rows in groups:
        each = end[rows] - ptr[rows]
        at = spans(ptr[rows], each)
        if len(at):
            x[rows] -= np.bincount(np.repeat(np.arange(len(rows)), each), val[at] * x[col[at]], len(rows))
        if symmetric:
            x[rows] /= val[end[rows]]
    for rows in reversed(groups):
        if symmetric:
            x[rows] /= val[end[rows]]
            each = end[rows] - ptr[rows]
            at = spans(ptr[rows], each)
            np.subtract.at(x, col[at], val[at] * np.repeat(x[rows], each))
        else:
            each = ptr[rows + 1] - end[rows] - 1
            at = spans(end[rows] + 1, each)
            if len(at):
                x[rows] -= np.bincount(np.repeat(np.arange(len(rows)), each), val[at] * x[col[at]], len(rows))
            x[rows] /= val[end[rows]]
    return x


def ic0_blocks(a: SparseMatrix, owners: DataFrame) -> OwnerFactors:
    """Incomplete Cholesky without fill inside each owner's rows."""
    return OwnerFactors(a, owners, True)


def ilu0_blocks(a: SparseMatrix, owners: DataFrame) -> OwnerFactors:
    """Incomplete LU without fill inside each owner's rows, for general matrices; a vanishing pivot is an error."""
    return OwnerFactors(a.need_square(), owners, False)


class Sum:
    """Several preconditioners added up."""

    def __init__(self, *parts):
        self.parts = parts

    def apply(self, r: DataFrame) -> DataFrame:
        out = self.parts[0].apply(r)
        for p in self.parts[1:]:
            out = algebra.axpy(1.0, p.apply(r), out)
        return out

    def solve(self, r: np.ndarray) -> np.ndarray:
        return sum(p.solve(r) for p in self.parts)


def factor_bytes(rows: int, sizes: list[int]) -> int:
    """Bytes that local factors keep: two for each row, and for a region of n: packed factor, indices, weights and two work vectors."""
    return 2 * rows + sum(8 * n + 8 * (n * (n + 1) // 2) + 8 * n + 16 * n for n in sizes if n)


