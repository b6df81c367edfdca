"""Krylov methods: resumable preconditioned CG, flexible GMRES with restart control, Lanczos.

The same code drives all array backends: ``a`` is any callable product and ``m`` anything with
``solve``. :func:`pcg_tables` runs CG over tables alone, for vectors that don't fit the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.operators import algebra
from lattix.plans.storage import materialize, release
from lattix.schema import DimensionMismatch, NumericalBreakdown, SparseMatrix, full_vector
from lattix.solvers.options import TINY, GeneralOptions, Outcome, Restart, RestartControl, SolverOptions, Status
from lattix.solvers.precond import Identity

Product = Callable[[np.ndarray], np.ndarray]


@dataclass
class PcgSession:
    """CG that can stop and go on without losing its directions. A new preconditioner needs a new session."""

    a: Product
    m: object
    x: np.ndarray
    r: np.ndarray
    p: np.ndarray
    rz: float
    target: float
    residual: float
    finished: Status | None = None
    trace: list[float] | None = None

    @classmethod
    def start(cls, a: Product, b: np.ndarray, x: np.ndarray | None = None, m=None, options: SolverOptions = SolverOptions(), trace: bool = False) -> PcgSession:
        """No iteration yet. A start within the target is converged; rᵀ M⁻¹ r at or below 0 is an error here."""
        m = m or Identity()
        known, x = x is not None, np.zeros_like(b, dtype=float) if x is None else x
        if len(x) != len(b):
            raise DimensionMismatch(f"x has {len(x)} entries, b has {len(b)}")
        r = b - a(x) if known else b.astype(float)
        norm = float(np.linalg.norm(r))
        target = options.target(float(np.linalg.norm(b)))
        if norm <= target:
            return cls(a, m, x, r, r, 0.0, target, norm, Status.CONVERGED, [norm] if trace else None)
        z = m.solve(r)
        rz = float(r @ z)
        if not math.isfinite(rz) or rz <= 0:
            raise NumericalBreakdown("the initial r·M⁻¹r is not positive")
        return cls(a, m, x, r, z.copy(), rz, target, norm, None, [norm] if trace else None)

    def advance(self, iterations: int) -> Outcome:
        """Up to ``iterations`` more. Lost positivity ends in a breakdown that keeps the solution so far."""
        first = self.residual
        if self.finished or not iterations:
            return Outcome(self.finished or Status.MAX_ITERATIONS, 0, first, self.residual)
        for done in range(1, iterations + 1):
            ap = self.a(self.p)
            curvature = float(self.p @ ap)
            if not math.isfinite(curvature) or curvature <= 0:
                self.finished = Status.BREAKDOWN
                return Outcome(self.finished, done - 1, first, self.residual)
            alpha = self.rz / curvature
            self.x += alpha * self.p
            self.r = self.r - alpha * ap
            del ap  # the next product has its own
            self.residual = float(np.linalg.norm(self.r))
            if self.trace is not None:
                self.trace.append(self.residual)
            if self.residual <= self.target:
                self.finished = Status.CONVERGED
                return Outcome(self.finished, done, first, self.residual)
            z = self.m.solve(self.r)
            rz = float(self.r @ z)
            if not math.isfinite(rz) or rz <= 0:
                self.finished = Status.BREAKDOWN
                return Outcome(self.finished, done, first, self.residual)
            self.p *= rz / self.rz
            self.p += z
            del z
            self.rz = rz
        return Outcome(Status.MAX_ITERATIONS, iterations, first, self.residual)


def pcg(a: Product, b: np.ndarray, m=None, x: np.ndarray | None = None, options: SolverOptions = SolverOptions()) -> tuple[np.ndarray, Outcome]:
    session = PcgSession.start(a, b, x, m, options)
    outcome = session.advance(options.max_iterations)
    return session.x, outcome


def verified(a: Product, b: np.ndarray, x: np.ndarray, outcome: Outcome, options: SolverOptions, slack: float = 10.0) -> Outcome:
    """Demote a claimed convergence that an independent product doesn't confirm."""
    true = float(np.linalg.norm(b - a(x)))
    if outcome.status is Status.CONVERGED and true > slack * options.target(float(np.linalg.norm(b))):
        return Outcome(Status.MAX_ITERATIONS, outcome.iterations, outcome.initial_residual, true)
    return Outcome(outcome.status, outcome.iterations, outcome.initial_residual, true)


def pcg_tables(a: SparseMatrix, b: DataFrame, m=None, options: SolverOptions = SolverOptions()) -> tuple[DataFrame, Outcome]:
    """CG with all vectors in one table ``(i, x, r, z, p)``, stored in the shared folder after each iteration.

    Each iteration is two jobs: one product that also sums pᵀAp, and one update that sums all
    scalars of the iteration at once. The driver holds scalars only.
    """
    m, n = m or Identity(), a.nrows
    rhs = full_vector(b, n)
    z = m.apply(rhs).select("i", F.col("v").alias("z"))
    state = materialize(rhs.join(z, "i").select("i", F.lit(0.0).alias("x"), F.col("v").alias("r"), "z", F.col("z").alias("p")), "pcg")
    first = state.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"), F.sum(F.col("r") * F.col("z")).alias("rz")).first()
    target, norm, rz = options.target(first.norm), first.norm, first.rz
    if norm <= target:
        return state.select("i", F.col("x").alias("v")), Outcome(Status.CONVERGED, 0, norm, norm)
    if not rz or rz <= 0:
        raise NumericalBreakdown("the initial r·M⁻¹r is not positive")
    for done in range(1, options.max_iterations + 1):
        ap = algebra.products(a, state.select("i", F.col("p").alias("v"))).select("i", F.col("v").alias("ap"))
        step = materialize(state.join(ap, "i", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))), "pcg-step")
        curvature = step.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        if not curvature or curvature <= 0:
            return state.select("i", F.col("x").alias("v")), Outcome(Status.BREAKDOWN, done - 1, first.norm, norm)
        alpha = rz / curvature
        moved = step.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        fresh = m.apply(moved.select("i", F.col("r").alias("v"))).select("i", F.col("v").alias("z"))
        moved = materialize(moved.join(fresh, "i"), "pcg")
        sums = moved.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"), F.sum(F.col("r") * F.col("z")).alias("rz")).first()
        release(step)
        release(state)
        norm = sums.norm
        state = moved
        if norm <= target:
            return state.select("i", F.col("x").alias("v")), Outcome(Status.CONVERGED, done, first.norm, norm)
        if not sums.rz or sums.rz <= 0:
            return state.select("i", F.col("x").alias("v")), Outcome(Status.BREAKDOWN, done, first.norm, norm)
        state = moved.select("i", "x", "r", "z", (F.col("z") + (sums.rz / rz) * F.col("p")).alias("p"))
        state._stored_at = moved._stored_at
        rz = sums.rz
    return state.select("i", F.col("x").alias("v")), Outcome(Status.MAX_ITERATIONS, options.max_iterations, first.norm, norm)


def pcg_promoting(
    a: Product, b: np.ndarray, base, stronger: Callable[[np.ndarray], object], window: int = 12, ratio: float = 0.5, options: SolverOptions = SolverOptions(1e-9, 1e-13, 2000)
) -> tuple[np.ndarray, Outcome, int | None, list[tuple[int, float]]]:
    """CG that changes its preconditioner once: ``(x, outcome, iteration of the change, residual trace)``.

    After each window the residual is compared with that at the window's start. If it fell by less
    than ``ratio`` asks, ``stronger(residual)`` is built and CG starts anew from where it is;
    otherwise the same session goes on. The outcome is checked against the true residual.
    """
    session, promoted, total = PcgSession.start(a, b, None, base, options, trace=True), None, None
    trace = [(0, session.residual)]
    while True:
        left = options.max_iterations - (total.iterations if total else 0)
        before = session.residual
        out = session.advance(min(left, window) if promoted is None else left)
        done = total.iterations if total else 0
        trace += [(done + k + 1, r) for k, r in enumerate(session.trace[-out.iterations :] if out.iterations else [])]
        total = total.then(out) if total else out
        if out.status is not Status.MAX_ITERATIONS or total.iterations >= options.max_iterations:
            return session.x, verified(a, b, session.x, total, options), promoted, trace
        if promoted is None and session.residual / before > ratio:
            promoted = total.iterations
            session = PcgSession.start(a, b, session.x, stronger(b - a(session.x)), options, trace=True)


def trace_table(spark, trace: list[tuple[int, float]], stride: int = 1) -> DataFrame:
    """``(iteration, residual)`` of each ``stride``-th iteration, the first and the last."""
    rows = [t for k, t in enumerate(trace) if k % stride == 0 or k == len(trace) - 1]
    return spark.createDataFrame(rows, "iteration int, residual double")


def fgmres(a: Product, b: np.ndarray, m=None, x: np.ndarray | None = None, options: SolverOptions = SolverOptions(), restart: int = 30, control: RestartControl | None = None) -> tuple[np.ndarray, Outcome, int]:
    """Restarted, right-preconditioned flexible GMRES: ``(x, outcome, last restart)``.

    Two passes of modified Gram-Schmidt, Givens rotations, and the true residual at each restart
    and before convergence is claimed. ``m.solve`` may change from call to call.
    """
    m, x = m or Identity(), np.zeros_like(b, dtype=float) if x is None else x.astype(float).copy()
    target = options.target(float(np.linalg.norm(b)))
    r = b - a(x)
    first = norm = float(np.linalg.norm(r))
    used = 0
    while norm > target and used < options.max_iterations:
        size = min(restart, options.max_iterations - used)
        v, z = [r / norm], []
        h, g = np.zeros((size + 1, size)), np.zeros(size + 1)
        cs, sn = np.zeros(size), np.zeros(size)
        g[0], k, happy = norm, 0, False
        for k in range(size):
            z.append(m.solve(v[k]))
            w = a(z[k])
            scale = float(np.linalg.norm(w))
            for _ in range(2):
                for q in range(k + 1):
                    c = float(v[q] @ w)
                    h[q, k] += c
                    w = w - c * v[q]
            h[k + 1, k] = float(np.linalg.norm(w))
            if not math.isfinite(h[k + 1, k]):
                return x, Outcome(Status.BREAKDOWN, used, first, norm), restart
            happy = h[k + 1, k] <= 1e-14 * max(scale, TINY)
            for q in range(k):
                h[q, k], h[q + 1, k] = cs[q] * h[q, k] + sn[q] * h[q + 1, k], -sn[q] * h[q, k] + cs[q] * h[q + 1, k]
            d = math.hypot(h[k, k], h[k + 1, k])
            if d == 0:
                break
            cs[k], sn[k] = h[k, k] / d, h[k + 1, k] / d
            h[k, k], h[k + 1, k] = d, 0.0
            g[k], g[k + 1] = cs[k] * g[k], -sn[k] * g[k]
            used += 1
            if abs(g[k + 1]) <= target or happy:
                break
            v.append(w / np.linalg.norm(w))
        count = k + 1 if h[k, k] != 0 else k
        if not count:
            return x, Outcome(Status.BREAKDOWN, used, first, norm), restart
        y = np.linalg.solve(np.triu(h[:count, :count]), g[:count])
        x = x + sum(c * q for c, q in zip(y, z, strict=False))
        before, r = norm, b - a(x)
        norm = float(np.linalg.norm(r))
        if happy and norm > target:
            return x, Outcome(Status.BREAKDOWN, used, first, norm), restart
        if control is not None and norm > target:
            restart = control(restart, count, before, norm, options.max_iterations - used)
    return x, Outcome(Status.CONVERGED if norm <= target else Status.MAX_ITERATIONS, used, first, norm), restart


def fgmres_tables(
    a: SparseMatrix, b: DataFrame, m=None, x: DataFrame | None = None, options: SolverOptions = SolverOptions(), restart: int = 30, control: RestartControl | None = None
) -> tuple[DataFrame, Outcome, int]:
    """:func:`fgmres` with the basis in one table ``(i, x, r, v0, v1, ..., z0, z1, ...)``, stored after each step.

    A step orthogonalises twice by classical Gram-Schmidt, which needs one pass over the table for all
    products with the basis at once; the driver holds the small Hessenberg matrix and scalars only.
    """
    m, n = m or Identity(), a.nrows

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0.0))

    rhs = full_vector(b, n)
    begun = rhs.select("i", F.lit(0.0).alias("x"), F.col("v").alias("r"), "v")
    if x is not None:
        ax = algebra.products(a, x).select("i", F.col("v").alias("ax"))
        begun = rhs.join(full_vector(x, n).select("i", F.col("v").alias("x")), "i").join(ax, "i", "left").na.fill(0.0, ["ax"]).select("i", "x", (F.col("v") - F.col("ax")).alias("r"), "v")
    state = materialize(begun, "fgmres")
    first, whole = (math.sqrt(c) for c in state.agg(total(F.col("r") * F.col("r")), total(F.col("v") * F.col("v"))).first())
    held, state = state, state.drop("v")
    norm, target, used, status = first, options.target(whole), 0, Status.MAX_ITERATIONS
    state._stored_at = held._stored_at
    while norm > target and used < options.max_iterations:
        size = min(restart, options.max_iterations - used)
        h, g, held = np.zeros((size + 1, size)), np.zeros(size + 1), state
        g[0], happy, count = norm, False, 0
        state = state.withColumn("v0", F.col("r") / norm)
        for k in range(size):
            z = m.apply(state.select("i", F.col(f"v{k}").alias("v"))).select("i", F.col("v").alias(f"z{k}"))
            both = materialize(state.join(z, "i", "left").na.fill(0.0, [f"z{k}"]), "fgmres")
            w = algebra.products(a, both.select("i", F.col(f"z{k}").alias("v"))).select("i", F.col("v").alias("w"))
            step = materialize(both.join(w, "i", "left").na.fill(0.0, ["w"]), "fgmres")
            release(both, held)
            scale = math.sqrt(step.agg(total(F.col("w") * F.col("w"))).first()[0])
            rest = F.col("w")
            for _ in range(2):
                c = step.agg(*[total(F.col(f"v{q}") * rest).alias(f"c{q}") for q in range(k + 1)]).first()
                h[: k + 1, k] += np.array(list(c))
                for q in range(k + 1):
                    rest = rest - float(c[q]) * F.col(f"v{q}")
            h[k + 1, k] = math.sqrt(step.agg(total(rest * rest)).first()[0])
            held, used, count = step, used + 1, k + 1
            if not math.isfinite(h[k + 1, k]):
                return step.select("i", F.col("x").alias("v")), Outcome(Status.BREAKDOWN, used, first, norm), restart
            happy = h[k + 1, k] <= 1e-14 * max(scale, TINY)
            state = step.drop("w") if happy else step.withColumn(f"v{k + 1}", rest / float(h[k + 1, k])).drop("w")
            y, left, *_ = np.linalg.lstsq(h[: k + 2, : k + 1], g[: k + 2], rcond=None)
            if happy or np.linalg.norm(g[: k + 2] - h[: k + 2, : k + 1] @ y) <= target:
                break
        moved = F.col("x")
        for q in range(count):
            moved = moved + float(y[q]) * F.col(f"z{q}")
        solved = materialize(held.select("i", moved.alias("x")), "fgmres")
        ax = algebra.products(a, solved.select("i", F.col("x").alias("v"))).select("i", F.col("v").alias("ax"))
        fresh = materialize(solved.join(rhs, "i").join(ax, "i", "left").na.fill(0.0, ["ax"]).select("i", "x", (F.col("v") - F.col("ax")).alias("r")), "fgmres")
        release(held, solved)
        state, before = fresh, norm
        norm = math.sqrt(state.agg(total(F.col("r") * F.col("r"))).first()[0])
        if norm > target and happy:
            status = Status.BREAKDOWN
            break
        if control is not None and norm > target:
            restart = control(restart, count, before, norm, options.max_iterations - used)
    return state.select("i", F.col("x").alias("v")), Outcome(Status.CONVERGED if norm <= target else status, used, first, norm), restart


class BudgetAware:
    """Doubles the restart when, twice running, the rate over four cycles won't reach the target in the iterations left.

    Pressure is iterations needed over iterations left. From 1.10 it counts if the rate isn't
    rising, from 1.40 in any case.
    """

    WINDOW, PRESSURE, EMERGENCY, HITS = 4, 1.10, 1.40, 2

    def __init__(self, target: float, most: int):
        self.target, self.most = target, most
        self.start: float | None = None
        self.iterations = self.cycles = self.hits = 0
        self.rate: float | None = None

    def __call__(self, restart: int, cycle: int, first: float, last: float, left: int) -> int:
        if restart >= self.most:
            return restart
        self.start = first if self.start is None else self.start
        self.iterations += cycle
        self.cycles += 1
        if self.cycles < self.WINDOW:
            return restart
        ratio = last / max(self.start, TINY)
        rate = -math.log(ratio) / self.iterations if 0 < ratio < 1 and self.iterations else 0.0
        needed = 0.0 if last <= self.target else math.log(last / self.target) / rate if rate > 0 else math.inf
        pressure = needed / left if left else math.inf
        falling = bool(self.rate) and rate <= self.rate
        self.hits = self.hits + 1 if pressure >= self.EMERGENCY or (pressure >= self.PRESSURE and falling) else 0
        self.start, self.iterations, self.cycles = last, 0, 0
        if self.hits >= self.HITS:
            self.hits, self.rate = 0, None
            return min(2 * restart, self.most)
        self.rate = rate
        return restart


def solve_general(a, b, m=None, options: SolverOptions = SolverOptions(), general: GeneralOptions = GeneralOptions(), x=None, method=fgmres) -> tuple:
    """FGMRES under a restart policy: ``(x, outcome, last restart)``. Escalating runs stages of bounded iterations, doubling the restart after each.

    ``method`` is :func:`fgmres` for arrays or :func:`fgmres_tables` for tables: the policy is the same.
    """
    if general.policy is Restart.FIXED:
        return method(a, b, m, x, options, general.restart)
    if general.policy is Restart.BUDGET_AWARE:
        norm = float(np.linalg.norm(b)) if isinstance(b, np.ndarray) else algebra.norms(b).first().l2
        return method(a, b, m, x, options, general.restart, BudgetAware(options.target(norm), general.max_restart))
    restart, total = general.restart, None
    while True:
        left = options.max_iterations - (total.iterations if total else 0)
        if left <= 0:
            return x, total or Outcome(Status.MAX_ITERATIONS, 0, math.nan, math.nan), restart
        budget = left if restart == general.max_restart else min(general.stage_iterations, left)
        x, out, _ = method(a, b, m, x, SolverOptions(options.relative_tolerance, options.absolute_tolerance, budget), restart)
        total = total.then(out) if total else out
        if out.status is not Status.MAX_ITERATIONS:
            return x, total, restart
        restart = min(2 * restart, general.max_restart)


def lanczos(a: Product, n: int, steps: int = 50, seed: int = 1) -> tuple[float, float, int]:
    """Smallest and largest Ritz values after at most ``steps`` with full reorthogonalisation, and the steps taken."""
    v = np.random.default_rng(seed).normal(size=n)
    basis, alpha, beta = [v / np.linalg.norm(v)], [], []
    for k in range(min(steps, n)):
        w = a(basis[k])
        alpha.append(float(basis[k] @ w))
        for _ in range(2):
            for q in basis:
                w = w - (q @ w) * q
        norm = float(np.linalg.norm(w))
        if norm <= 1e-12 * max(abs(x) for x in alpha) or k + 1 == min(steps, n):
            break
        beta.append(norm)
        basis.append(w / norm)
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    values = np.linalg.eigvalsh(t)
    return float(values[0]), float(values[-1]), len(alpha)
