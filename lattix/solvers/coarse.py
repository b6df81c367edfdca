"""Aggregates, transfers and coarse operators."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.operators import algebra
from lattix.operators.profile import need_diagonal
from lattix.schema import InvalidArgument, NumericalBreakdown, SparseMatrix
from lattix.solvers.backend import DiskRows, spans, unpacked_rows


def contiguous_aggregates(a: SparseMatrix, dofs: int, nodes: int) -> tuple[DataFrame, int]:
    """``(node, agg)`` of ``nodes`` consecutive nodes each, and how many."""
    count = -(-a.nrows // dofs)
    return a.spark.range(count).select(F.col("id").alias("node"), F.floor(F.col("id") / nodes).alias("agg")), -(-count // nodes)


def node_graph(a: SparseMatrix, dofs: int) -> DataFrame:
    """Undirected node pairs ``(i, j)`` of a matrix with ``dofs`` rows for each node."""
    from lattix.operators.topology import undirected

    return undirected(a.df.select(F.floor(F.col("i") / dofs).alias("i"), F.floor(F.col("j") / dofs).alias("j")))


def adjacency(pairs: DataFrame, n: int) -> DiskRows:
    """Sorted neighbours of n nodes on the driver: the edges in a file, a pointer for each node in memory."""
    return DiskRows(pairs, n)


class NodeRows:
    """Sorted neighbours of each node of a matrix with ``dofs`` rows for each, straight from packed blocks of a symmetric pattern.

    They lie in a file on the driver, blocks in any order; where a node's rows go on in another block, its neighbours are put together.
    """

    def __init__(self, a: SparseMatrix, dofs: int):
        n, ncols = -(-a.nrows // dofs), a.ncols

        def pattern(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    c = row.get("copies", 1)
                    width = dofs if dofs % c else dofs // c  # copies of a node's rows need not be made
                    rows, counts, cols = unpacked_rows(row if dofs % c else row | {"copies": 1}, ncols if dofs % c else ncols // c)[:3]
                    i, j = np.repeat(rows // width, counts), cols // width
                    keep = i != j
                    i, j = i[keep], j[keep]
                    if width > 1 and len(i):
                        low, span = int(j.min()), int(j.max()) - int(j.min()) + 1
                        key = np.unique((i - i[0]) * span + (j - low))
                        i, j = key // span + i[0], key % span + low
                    at = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
                    parts = i[at], np.diff(np.append(at, len(i))), j.astype(np.int32 if n < 1 << 31 else np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["nodes", "counts", "cols"])

        kind = np.int32 if n < 1 << 31 else np.int64
        file, size, ends = tempfile.TemporaryFile(), 0, {}
        self.start, self.degree = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for piece in a.blocks.mapInArrow(pattern, "nodes binary, counts binary, cols binary").toLocalIterator(prefetchPartitions=True):
            nodes, counts, cols = (np.frombuffer(x, t) for x, t in zip(piece, (np.int64, np.int64, kind), strict=True))
            if not len(nodes):
                continue
            start = np.cumsum(counts) - counts
            self.start[nodes], self.degree[nodes] = size + start, counts
            for k in {0, len(nodes) - 1}:
                ends.setdefault(int(nodes[k]), []).append(cols[start[k] : start[k] + counts[k]].copy())
            file.write(cols.tobytes())
            size += len(cols)
        for node, parts in ends.items():
            if len(parts) > 1:
                cols = np.unique(np.concatenate(parts))
                self.start[node], self.degree[node] = size, len(cols)
                file.write(cols.tobytes())
                size += len(cols)
        file.flush()
        self.cols = np.asarray(np.memmap(file, kind, "r")) if size else np.zeros(0, kind)

    def __len__(self) -> int:
        return len(self.degree)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.cols[self.start[k] : self.start[k] + self.degree[k]]

    def of(self, nodes: np.ndarray) -> np.ndarray:
        return self.cols[spans(self.start[nodes], self.degree[nodes])]


#: Neighbours that growth looks at in one step, unless one node has more.
STEP_EDGES = 1 << 20


def _grown(near: list[np.ndarray] | DiskRows | NodeRows, front: np.ndarray, own: np.ndarray, number: int, most: int) -> np.ndarray:
    """The first ``most`` free neighbours of a queue of nodes, in the order in which they would join it; they now belong to ``number``."""
    listed = isinstance(near, list)
    ends, got, lo = np.cumsum([len(near[k]) for k in front] if listed else near.degree[front]), [], 0
    while lo < len(front) and most:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + min(STEP_EDGES, 64 * most), "right")))
        fresh = np.concatenate([near[k] for k in front[lo:hi]]) if listed else near.of(front[lo:hi])
        fresh = fresh.astype(np.int64)
        fresh = fresh[own[fresh] < 0]
        if len(fresh):
            fresh = fresh[np.sort(np.unique(fresh, return_index=True)[1])][:most]
            own[fresh] = number
            got.append(fresh)
            most -= len(fresh)
        lo = hi
    return np.concatenate(got) if got else np.zeros(0, np.int64)


def grow_aggregates(near: list[np.ndarray] | DiskRows | NodeRows, target: int, least: int = 1) -> tuple[np.ndarray, int]:
    """Aggregate of each node by capped breadth-first growth from the lowest free node.

    Aggregates below max(target // 4, ``least``) members then merge into the neighbour with most
    edges to them (ties: fewer members, then lower number). With ``least`` of 3 a tail of one or
    two nodes joins the first neighbour's aggregate at once, and a component that small is an
    error. Numbers are by first member.
    """
    if target < 1 or not len(near):
        raise InvalidArgument("aggregation needs nodes and a positive size")
    own, members = np.full(len(near), -1), []
    for seed in range(len(near)):
        if own[seed] >= 0:
            continue
        number, front = len(members), np.array([seed])
        own[seed], group = number, [seed]
        while len(front) and len(group) < target:
            front = _grown(near, front, own, number, target - len(group))
            group += front.tolist()
        if len(group) >= least or least < 3:
            members.append(group)
            continue
        if not members:
            raise InvalidArgument("a component of the graph has fewer than three nodes")
        own[group] = -2
        for node in group:
            home = next((int(own[k]) for k in near[node] if 0 <= own[k] < number), number - 1)
            own[node] = home
            members[home].append(node)
    floor = max(target // 4, least)
    moved = True
    while moved:
        moved = False
        for number, group in enumerate(members):
            if not 0 < len(group) < floor:
                continue
            other = own[np.concatenate([near[node] for node in group])]
            edges = dict(zip(*(x.tolist() for x in np.unique(other[other != number], return_counts=True)), strict=True))
            if edges:
                home = min(edges, key=lambda c: (-edges[c], len(members[c]), c))
                own[group] = home
                members[home] += group
                members[number] = []
                moved = True
    _, first, dense = np.unique(own, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[dense], len(first)


def graph_aggregates(a: SparseMatrix, dofs: int, target: int, strength: float = 0.0, least: int = 1) -> tuple[DataFrame, int]:
    """Aggregates along the node graph, or along strong block couplings only if ``strength`` is positive."""
    from lattix.operators.profile import strong_adjacency

    nodes = -(-a.nrows // dofs)
    pairs = strong_adjacency(a, dofs, strength).select(F.col("bi").alias("i"), F.col("bj").alias("j")) if strength else node_graph(a, dofs)
    own, count = grow_aggregates(adjacency(pairs, nodes), target, least)
    return a.spark.createDataFrame(pa.table({"node": np.arange(nodes), "agg": own})), count


def recommended_nodes(n_rows: int, dofs: int, target_dimension: int) -> int:
    """Nodes of an aggregate so that the coarse dimension stays within the target."""
    if n_rows % dofs:
        raise InvalidArgument("rows must be a multiple of the degrees of freedom of a node")
    return max(1, -(-(n_rows // dofs) // max(1, target_dimension // dofs)))


def recommended_rigid_nodes(nodes: int, target_dimension: int) -> int:
    """Nodes of a rigid-body aggregate: a power of two, at least three, with no tail of one or two nodes."""
    if nodes < 3 or target_dimension < 6:
        raise InvalidArgument("rigid-body aggregates need three nodes and six coarse dimensions")
    wanted = min(max(1, target_dimension // 6), max(1, nodes // 3))
    size = max(3, min(1 << (-(-nodes // wanted) - 1).bit_length(), nodes))
    while size < nodes and nodes % size in (1, 2):
        size += 1
    return min(size, nodes)


def centroids(coords: DataFrame, aggregates: DataFrame) -> DataFrame:
    """``(agg, nodes, cx, cy, cz, radius)``: mean position and root mean square distance to it."""
    placed = coords.join(aggregates, "node")
    mean = placed.groupBy("agg").agg(F.count("*").alias("nodes"), *[F.avg(c).alias(f"c{c}") for c in "xyz"])
    square = sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0))
    spread = placed.join(mean, "agg").groupBy("agg").agg(F.sqrt(F.avg(square)).alias("radius"))
    return mean.join(spread, "agg")


def node_coordinates(coords: DataFrame, n: int) -> np.ndarray | None:
    """Coordinates of n nodes as an array, if each node has its place once."""
    told = coords.agg(F.count("*").alias("rows"), F.min("node").alias("least"), F.max("node").alias("most"), F.count_if(F.col("node").isNull() | F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).alias("lost")).first()
    if told.lost or (told.rows, told.least, told.most) != (n, 0, n - 1):
        return None
    got = coords.select(F.col("node").cast("long").alias("node"), *[F.col(c).cast("double").alias(c) for c in "xyz"]).toArrow()
    node = got.column("node").to_numpy()
    if np.bincount(node, minlength=n).max() > 1:
        return None
    out = np.empty((n, 3))
    for k, c in enumerate("xyz"):
        out[node, k] = got.column(c).to_numpy()
    return out


def rigid_offsets(placed: np.ndarray, own: np.ndarray, count: int) -> np.ndarray:
    """Offsets of nodes from their aggregate's centroid over its radius, as :func:`rigid_transfer` has them."""
    nodes = np.bincount(own, minlength=count)
    out = placed - np.stack([np.bincount(own, c, count) / nodes for c in placed.T], 1)[own]
    radius = np.sqrt(sum(np.bincount(own, c * c, count) for c in out.T) / nodes)
    flat = np.flatnonzero(~(radius > 2.220446049250313e-16))
    if len(flat):
        raise NumericalBreakdown(f"aggregate {flat[0]} has no extent")
    out /= radius[own][:, None]
    return out


def piecewise_transfer(a: SparseMatrix, dofs: int, aggregates: DataFrame, count: int) -> SparseMatrix:
    """One coarse column for each component of each aggregate."""
    rows = a.rows().withColumn("node", F.floor(F.col("i") / dofs)).join(aggregates, "node")
    return SparseMatrix(rows.select("i", (F.col("agg") * dofs + F.col("i") % dofs).alias("j"), F.lit(1.0).alias("v")), a.nrows, count * dofs)


def spectral_radius(a: SparseMatrix, steps: int = 10) -> float:
    """Estimate of the largest eigenvalue of D^-1/2 A D^-1/2 by power iteration from 1 + ((17 i + 11) mod 101)."""
    from lattix.datasets import probe
    from lattix.plans.storage import materialize

    root = need_diagonal(a, positive=True).select("i", (1 / F.sqrt("v")).alias("s"))
    scaled = a.df.join(root, "i").join(root.select(F.col("i").alias("j"), F.col("s").alias("t")), "j").select("i", "j", (F.col("v") * F.col("s") * F.col("t")).alias("v"))
    m = SparseMatrix(materialize(scaled, "scaled"), a.nrows, a.ncols)
    x, radius = probe(a.spark, a.nrows), 0.0
    norm = x.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0]
    for _ in range(steps):
        y = materialize(algebra.spmv(m, x.select("i", (F.col("v") / norm).alias("v"))), "power")
        norm = y.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0]
        if not norm or norm != norm:
            raise NumericalBreakdown("power iteration lost its vector")
        x, radius = y, norm
    return radius


def smoothed_transfer(a: SparseMatrix, transfer: SparseMatrix, radius: float | None = None) -> SparseMatrix:
    """(I - ω D⁻¹ A) P with ω = 4 / (3 ρ), zeros dropped."""
    omega = 4 / (3 * (radius or spectral_radius(a)))
    d = need_diagonal(a, positive=True).select("i", F.col("v").alias("d"))
    step = algebra.spgemm(a, transfer).df.join(d, "i").select("i", "j", (F.lit(-omega) * F.col("v") / F.col("d")).alias("v"))
    both = transfer.df.select("i", "j", "v").union(step).groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")
    return SparseMatrix(both, transfer.nrows, transfer.ncols)


def rigid_transfer(a: SparseMatrix, coords: DataFrame, aggregates: DataFrame, count: int) -> SparseMatrix:
    """Six rigid-body modes of each aggregate about its centroid, offsets over its radius: three entries for each row."""
    mean = centroids(coords, aggregates)
    flat = mean.where("radius is null or radius <= 2.220446049250313e-16 or isnan(radius)").take(1)
    if flat:
        raise NumericalBreakdown(f"aggregate {flat[0].agg} has no extent")
    offset = coords.join(aggregates, "node").join(mean, "agg").select("node", "agg", *[((F.col(c) - F.col(f"c{c}")) / F.col("radius")).alias(c) for c in "xyz"])

    def mode(component: int, number: int, value) -> Column:
        return F.struct((F.col("node") * 3 + component).alias("i"), (F.col("agg") * 6 + number).alias("j"), value.cast("double").alias("v"))

    one, x, y, z = F.lit(1.0), F.col("x"), F.col("y"), F.col("z")
    entries = F.array(mode(0, 0, one), mode(0, 4, z), mode(0, 5, -y), mode(1, 1, one), mode(1, 3, -z), mode(1, 5, x), mode(2, 2, one), mode(2, 3, y), mode(2, 4, -x))
    return SparseMatrix(offset.select(F.explode(entries).alias("e")).select("e.*"), a.nrows, count * 6)
