"""Choosing the regions that get a local direct factor."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.schema import InvalidArgument, SparseMatrix
from lattix.plans.storage import materialize, release
from lattix.solvers.backend import DiskRows, LocalMatrix
from lattix.solvers.options import HybridOptions, Selection
from lattix.solvers.precond import factor_bytes

Region = tuple[int, ...]


def _reach(a: LocalMatrix | DiskRows, start: int, allowed: np.ndarray, free: np.ndarray, most: int | None = None) -> list[int]:
    """Breadth-first order from ``start`` along rows of A within ``allowed`` and ``free``, which is used up."""
    out, queue, queued = [], deque([start]), {start}
    while queue and (most is None or len(out) < most):
        node = queue.popleft()
        if not free[node]:
            continue
        free[node] = False
        out.append(node)
        near = a.row(node)[0]
        for c in near[allowed[near] & free[near]].tolist():
            if c not in queued:
                queued.add(c)
                queue.append(c)
    return out


def discover(a: LocalMatrix | DiskRows, risk: np.ndarray, seeds: np.ndarray, r: np.ndarray, options: HybridOptions) -> list[Region]:
    """Connected chunks of risky rows around the strongest residuals, at most ``regions`` of ``region_size``.

    Components of the risk set without a seed are left alone. Without any candidate the seeds
    themselves are cut into chunks. Order: peak |r| descending, then first index.
    """
    strong = np.abs(r)
    by_strength = lambda nodes: sorted(nodes, key=lambda k: (-strong[k], k))
    found: list[Region] = []
    free, claim = np.ones(a.nrows, bool), np.ones(a.nrows, bool)
    for start in np.flatnonzero(risk):
        if not free[start]:
            continue
        part = _reach(a, int(start), risk, free)
        if seeds[part].any():
            for root in by_strength(part):
                if claim[root]:
                    found.append(tuple(sorted(_reach(a, root, risk, claim, options.region_size))))
    if not found:
        free = np.ones(a.nrows, bool)
        for start in np.flatnonzero(seeds):
            if free[start]:
                part = by_strength(_reach(a, int(start), seeds, free))
                found += [tuple(sorted(part[k : k + options.region_size])) for k in range(0, len(part), options.region_size)]
    found.sort(key=lambda g: (-strong[list(g)].max(), g[0]))
    return found[: options.regions]


def core_regions(a: SparseMatrix, risk: DataFrame, seeds: DataFrame, r: DataFrame, options: HybridOptions, limit: int | None = None) -> DataFrame:
    """``(region, i)`` of :func:`discover`; regions are numbered from 0 in its order.

    Only the rows and columns of the risk set and the seeds are brought to the driver, where a file holds them; vectors
    stay in memory. More than ``limit`` of their nodes or of their entries, if it is given, raise an error.
    """
    spark = a.spark
    marks = risk.select("i", F.lit(True).alias("risky"), F.lit(False).alias("seed")).unionByName(seeds.select("i", F.lit(False).alias("risky"), F.lit(True).alias("seed")))
    nodes = materialize(marks.groupBy("i").agg(F.max("risky").alias("risky"), F.max("seed").alias("seed")).join(r.select("i", F.col("v").alias("r")), "i", "left"), "cores")
    if limit is not None and nodes.count() > limit:
        raise InvalidArgument(f"more than {limit} nodes at risk don't go to the driver")
    held = nodes.select("i")
    inner = DiskRows(a.df.join(held, "i", "left_semi").join(held.withColumnRenamed("i", "j"), "j", "left_semi"), a.nrows)
    if limit is not None and inner.ptr[-1] > limit:
        raise InvalidArgument(f"more than {limit} entries at risk don't go to the driver")
    got = nodes.toArrow()
    release(nodes)
    at = got.column("i").to_numpy()
    strength, *flags = np.zeros(a.nrows), np.zeros(a.nrows, bool), np.zeros(a.nrows, bool)
    strength[at] = np.nan_to_num(got.column("r").to_numpy().astype(float))
    for flag, c in zip(flags, ("risky", "seed"), strict=True):
        flag[at] = got.column(c).to_numpy()
    found = discover(inner, *flags, strength, options)
    return spark.createDataFrame([(k, n) for k, g in enumerate(found) for n in g], "region bigint, i bigint")


def expand(a: LocalMatrix, cores: list[Region], r: np.ndarray, options: HybridOptions) -> list[Region]:
    """Cores with ``overlap`` hops along rows of A; the cap keeps the core, then the strongest |r|, ties by index."""
    out = []
    for core in cores:
        mask = set(core)
        for _ in range(options.overlap):
            mask |= {int(c) for k in mask for c in a.row(k)[0]}
        if len(mask) > options.region_size:
            halo = sorted(mask - set(core), key=lambda k: (-abs(r[k]), k))
            mask = set(sorted(core)[: options.region_size]) | set(halo[: max(0, options.region_size - len(core))])
        out.append(tuple(sorted(mask)))
    return out


def unique(existing: list[Region], more: list[Region]) -> list[Region]:
    out = list(existing)
    for g in more:
        g = tuple(sorted(set(g)))
        if g and g not in out:
            out.append(g)
    return out


def within_budget(n: int, existing: list[Region], candidates: list[Region], r: np.ndarray, inverse_diagonal: np.ndarray, selection: Selection, most: int) -> tuple[list[Region], int]:
    """``(regions, skipped)``: those already paid for, then by benefit per further byte, scored anew after each choice.

    The benefit is residual energy (times 1/diagonal for the Jacobi rule) not covered yet. Ties:
    more benefit, fewer bytes, then the lower set of indices.
    """
    accepted = unique([], existing)
    sizes = [len(g) for g in accepted]
    if factor_bytes(n, sizes) > most:
        raise InvalidArgument("existing local factors exceed the budget")
    pending, skipped = unique(accepted, candidates)[len(accepted) :], 0
    if selection is Selection.CANDIDATE_ORDER:
        for g in pending:
            if factor_bytes(n, [*sizes, len(g)]) <= most:
                accepted.append(g)
                sizes.append(len(g))
            else:
                skipped += 1
        return accepted, skipped
    weight = r * r * (inverse_diagonal if selection is Selection.JACOBI_ENERGY_PER_BYTE else 1.0)
    open_ = np.ones(n, bool)
    for g in accepted:
        open_[list(g)] = False
    while pending:
        used, best = factor_bytes(n, sizes), None
        for g in pending:
            cost = factor_bytes(n, [*sizes, len(g)]) - used
            if used + cost <= most:
                at = np.array(g)
                gain = float(weight[at][open_[at]].sum())
                key = (-gain / cost, -gain, cost, g)
                best = key if best is None or key < best else best
        if best is None:
            return accepted, skipped + len(pending)
        g = best[3]
        pending.remove(g)
        accepted.append(g)
        sizes.append(len(g))
        open_[list(g)] = False
    return accepted, skipped
