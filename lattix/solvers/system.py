"""Analyze, prepare, solve many: the facade over all backends.

A prepared system keeps the canonical matrix, its preconditioner and what an adaptive solve has
learnt. It serves only matrices with the signatures it was prepared for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.operators import profile as P
from lattix.operators.partition import owner_balanced
from lattix.plans.storage import materialize
from lattix.schema import InvalidArgument, InvalidMatrix, LattixError, NumericalBreakdown, SparseMatrix, UnsupportedProblem
from lattix.solvers import regions as R
from lattix.solvers.backend import LOCAL_NNZ, BlockedMatrix, LocalMatrix, choose, entries_of, packed_rows, to_array, to_vector
from lattix.solvers.krylov import PcgSession, pcg, fgmres_tables, pcg_tables, solve_general, verified
from lattix.solvers.options import Execution, GeneralOptions, GeneralPreconditioner, HybridOptions, Outcome, ProblemClass, Report, SolverOptions, Status
from lattix.solvers.precond import Identity, Ilu0, Jacobi, Sum, factor_bytes, ilu0_blocks, rigid_body, schwarz, two_level


@dataclass(frozen=True)
class Analysis:
    nrows: int
    nnz: int
    positive_diagonal: bool
    problem: ProblemClass
    execution: Execution
    structure: int
    values: int
    #: Whether the pattern is known to be symmetric.
    mirrored: bool = False


def analyze(a: SparseMatrix, problem: ProblemClass = ProblemClass.SPD, execution: Execution = Execution.AUTO) -> Analysis:
    """Profile and signatures in two aggregate jobs, or one pass over packed blocks; the class is the caller's word, checked where that is cheap."""
    if a.need_square().blocks is not None:
        told = P.told_by_blocks(a)
        if told["bad"]:
            raise InvalidMatrix(f"entry {told['bad']} is not a finite entry of a {a.nrows} x {a.ncols} matrix")
        positive = told["positive"] == a.nrows
        if problem is ProblemClass.SPD and not positive:
            raise UnsupportedProblem("an SPD matrix has a positive diagonal in every row")
        return Analysis(a.nrows, told["nnz"], positive, problem, choose(a, told["nnz"]) if execution is Execution.AUTO else execution, told["structure"], told["values"], told["mirrored"])
    a.validate()
    one, sign = P.profile(a).first(), P.signature(a).first()
    if problem is ProblemClass.SPD and not one.positive_diagonal:
        raise UnsupportedProblem("an SPD matrix has a positive diagonal in every row")
    return Analysis(a.nrows, one.nnz, one.positive_diagonal, problem, choose(a, one.nnz) if execution is Execution.AUTO else execution, sign.structure, sign["values"])


class PreparedSystem:
    def __init__(self, a: SparseMatrix, analysis: Analysis, options: SolverOptions, hybrid: HybridOptions, general: GeneralOptions, coords: DataFrame | None = None, balanced: bool = False):
        # blocks are canonical and in the order of their rows
        if hasattr(a.blocks, "_stored_at"):
            self.a = a
        elif coords is not None and analysis.execution is Execution.BLOCKS:
            blocks = materialize(packed_rows(a.df, a.nrows, a.ncols) if a.blocks is None else a.blocks, "system")
            self.a = SparseMatrix(entries_of(blocks, a.ncols), a.nrows, a.ncols, blocks)
        else:
            self.a = SparseMatrix(materialize(a.canonical(drop_zeros=False).df.repartitionByRange("i"), "system"), a.nrows, a.ncols)
        self.analysis, self.options, self.hybrid, self.general = analysis, options, hybrid, general
        self.execution, self.sequence = analysis.execution, 0
        self.structural = coords is not None
        self.regions: list[R.Region] = []
        self.learnt = None
        self.coarse_dimension = 0
        self.product = {Execution.LOCAL: LocalMatrix.collect, Execution.BLOCKS: BlockedMatrix, Execution.DATAFRAME: lambda m: None}[self.execution](self.a)
        if analysis.problem is ProblemClass.GENERAL_SQUARE:
            self.name, self.base = self._general()
        elif coords is not None:
            self.name, self.base = self._structural(coords, balanced)
        elif hybrid.enabled and hybrid.coarse.enabled:
            c = hybrid.coarse
            self.base = two_level(self.a, c.dofs_per_node, c.target_dimension, c.aggregation, c.basis)
            self.name, self.coarse_dimension = "two_level", self.base.dimension
        else:
            self.name, self.base = "jacobi", Jacobi.from_matrix(self.a)

    def _general(self):
        kind = self.general.preconditioner
        if kind is GeneralPreconditioner.JACOBI:
            return "jacobi", Jacobi.from_matrix(self.a, general=True)
        if self.execution is not Execution.LOCAL and kind is not GeneralPreconditioner.ILU0_IDENTITY_FALLBACK:
            # beyond the driver the factors are those of even ranges of rows, each made and kept where its rows are
            ranks = max(1, -(-self.analysis.nnz // LOCAL_NNZ))
            owners = self.a.rows().select("i", owner_balanced(F.col("i"), self.a.nrows, ranks).alias("owner"))
            return f"{kind.value}_blocks", ilu0_blocks(self.a, owners)
        if self.execution is not Execution.LOCAL:
            raise UnsupportedProblem("rows that fall back to the identity need a matrix that fits the driver")
        return kind.value, Ilu0(self.product, kind is GeneralPreconditioner.ILU0_IDENTITY_FALLBACK)

    def _structural(self, coords: DataFrame, balanced: bool):
        arrays = self.execution is not Execution.DATAFRAME
        try:
            m = rigid_body(self.a, coords, self.hybrid.coarse.target_dimension, "graph", balanced, arrays, self.analysis.mirrored)
            name = "rigid_body_graph"
        except (NumericalBreakdown, InvalidArgument):  # a component too small, or a coarse space that breaks down
            m = rigid_body(self.a, coords, self.hybrid.coarse.target_dimension, "contiguous", balanced, arrays)
            name = "rigid_body_contiguous"
        self.coarse_dimension = m.dimension
        return name, m

    def check(self, a: SparseMatrix) -> None:
        """Refuse a matrix that is not the prepared one."""
        sign = P.signature(a).first()
        if (a.nrows, sign.structure, sign["values"]) != (self.analysis.nrows, self.analysis.structure, self.analysis.values):
            raise LattixError("the matrix differs from the one that was prepared")

    def solve(self, b: DataFrame, matrix: SparseMatrix | None = None) -> tuple[DataFrame, Report]:
        """Solution ``(i, v)`` and report. Right-hand sides may follow one another; what was learnt stays."""
        if matrix is not None:
            self.check(matrix)
        self.sequence += 1
        if self.execution is Execution.DATAFRAME:
            general = self.analysis.problem is ProblemClass.GENERAL_SQUARE
            x, out, restart = solve_general(self.a, b, self.base, self.options, self.general, method=fgmres_tables) if general else (*pcg_tables(self.a, b, self.base, self.options), 0)
            report = self._report("fgmres" if general else "pcg", self.name, out, float(b.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0))
            report.restart = restart
            return x, report
        rhs = to_array(b, self.a.nrows)
        norm = float(np.linalg.norm(rhs))
        if self.analysis.problem is ProblemClass.GENERAL_SQUARE:
            x, out, restart = solve_general(self.product, rhs, self.base, self.options, self.general)
            report = self._report("fgmres", self.name, out, norm)
            report.restart = restart
        elif self.structural:
            x, out = pcg(self.product, rhs, self.base, options=self.options)
            report = self._report("pcg", self.name, verified(self.product, rhs, x, out, self.options), norm)
        elif self.learnt is not None:
            x, out = pcg(self.product, rhs, self.learnt, options=self.options)
            report = self._report("hybrid", self.name + "+local", out, norm)
            report.reused, report.regions, report.factor_bytes = True, len(self.regions), factor_bytes(self.a.nrows, [len(g) for g in self.regions])
        else:
            x, report = self._adaptive(rhs, norm)
        return to_vector(self.a.spark, x), report

    def _report(self, solver: str, preconditioner: str, out: Outcome, norm: float) -> Report:
        relative = out.final_residual / norm if norm > 0 else out.final_residual
        return Report(out.status.value, solver, preconditioner, self.execution.value, out.iterations, out.initial_residual, out.final_residual, relative, coarse_dimension=self.coarse_dimension, sequence=self.sequence, reused=self.sequence > 1)

    def _adaptive(self, b: np.ndarray, norm: float) -> tuple[np.ndarray, Report]:
        """A probe, then the same session on; or, if progress is poor, local factors where the residual is strong and a restart."""
        o, h = self.options, self.hybrid
        probe = o.max_iterations if o.max_iterations <= 1 else max(1, min(h.probe_iterations, o.max_iterations - 1))
        session = PcgSession.start(self.product, b, None, self.base, o)
        out = session.advance(probe)
        left = o.max_iterations - out.iterations
        poor = h.enabled and out.status is Status.MAX_ITERATIONS and out.initial_residual > 0 and out.final_residual / out.initial_residual > h.poor_ratio
        if not left or out.status is not Status.MAX_ITERATIONS or not poor or self.execution is not Execution.LOCAL:
            if left and out.status is Status.MAX_ITERATIONS:
                out = out.then(session.advance(left))
            return session.x, self._report("pcg" if not self.coarse_dimension else "hybrid", self.name, out, norm)
        a, stages, hard, escalations = self.product, [], 0, 0
        diagonal = a.diagonal()
        risk = self._risk(a, diagonal)
        while left > 0 and escalations < h.max_escalations:
            r = b - a(session.x)
            peak = np.abs(r).max(initial=0.0)
            seeds = np.abs(r) >= h.seed_fraction * peak if peak > 0 else np.zeros(len(r), bool)
            cores = R.discover(a, risk, seeds, r, h)
            hard = max(hard, len({k for g in cores for k in g}))
            chosen, _ = R.within_budget(a.nrows, self.regions, R.expand(a, cores, r, h), r, 1 / diagonal, h.selection, h.factor_bytes)
            if not chosen or (chosen == self.regions and self.learnt is not None):
                break
            self.regions, escalations = chosen, escalations + 1
            self.learnt = self._local_preconditioner(chosen)
            session = PcgSession.start(a, b, session.x, self.learnt, o)
            stage = session.advance(left if escalations >= h.max_escalations else min(left, h.stage_iterations))
            out = out.then(stage)
            left -= stage.iterations
            stages.append({"stage": escalations, "iterations": stage.iterations, "regions": len(chosen), "residual": stage.final_residual})
            if stage.status is not Status.MAX_ITERATIONS or stage.final_residual / max(stage.initial_residual, 1e-300) <= h.poor_ratio:
                break
        if left > 0 and out.status is Status.MAX_ITERATIONS:
            out = out.then(session.advance(left))
        report = self._report("hybrid", self.name + "+local" if escalations else self.name, out, norm)
        report.escalations, report.regions, report.hard_dofs, report.stages = escalations, len(self.regions), hard, stages
        report.factor_bytes = factor_bytes(a.nrows, [len(g) for g in self.regions])
        return session.x, report

    def _risk(self, a: LocalMatrix, diagonal: np.ndarray) -> np.ndarray:
        d, off = np.abs(diagonal), a.i != a.j
        sums = np.bincount(a.i[off], np.abs(a.v[off]), a.nrows)
        jump = np.ones(a.nrows)
        near = off & (d[a.i] > 0) & (d[a.j] > 0)
        np.maximum.at(jump, a.i[near], np.maximum(d[a.i[near]] / d[a.j[near]], d[a.j[near]] / d[a.i[near]]))
        return (d > 0) & ((sums >= self.hybrid.coupling * d) | (jump >= self.hybrid.scale_jump))

    def _local_preconditioner(self, chosen: list[R.Region]):
        table = self.a.spark.createDataFrame([(k, i) for k, g in enumerate(chosen) for i in g], "region bigint, i bigint")
        local = schwarz(self.a, table)
        if self.name == "jacobi":
            return local
        only = SparseMatrix(local.minv.df.join(table.select("i").distinct(), "i", "left_semi"), self.a.nrows, self.a.ncols)
        return Sum(self.base, type(local)(only))


class Solver:
    """Options in one place, and one-shot calls."""

    def __init__(self, options: SolverOptions = SolverOptions(), problem: ProblemClass = ProblemClass.SPD, execution: Execution = Execution.AUTO, hybrid: HybridOptions = HybridOptions(), general: GeneralOptions = GeneralOptions()):
        self.options, self.problem, self.execution, self.hybrid, self.general = options, problem, execution, hybrid, general

    def analyze(self, a: SparseMatrix) -> Analysis:
        return analyze(a, self.problem, self.execution)

    def prepare(self, a: SparseMatrix, analysis: Analysis | None = None) -> PreparedSystem:
        return PreparedSystem(a, analysis or self.analyze(a), self.options, self.hybrid, self.general)

    def prepare_structural(self, a: SparseMatrix, coords: DataFrame, balanced: bool = False) -> PreparedSystem:
        """Three rows for each node and the nodes' coordinates."""
        if self.problem is not ProblemClass.SPD or a.nrows % 3:
            raise UnsupportedProblem("structural systems are SPD with three rows for each node")
        return PreparedSystem(a, self.analyze(a), self.options, self.hybrid, self.general, coords, balanced)

    @staticmethod
    def stored(a: SparseMatrix) -> SparseMatrix:
        """The matrix evaluated once, since analysis and preparation read it several times."""
        if hasattr(a.blocks, "_stored_at"):
            return a
        if a.blocks is None:
            return SparseMatrix(materialize(a.df, "matrix"), a.nrows, a.ncols)
        blocks = materialize(a.blocks, "matrix")
        return SparseMatrix(entries_of(blocks, a.ncols), a.nrows, a.ncols, blocks)

    def solve(self, a: SparseMatrix, b: DataFrame) -> tuple[DataFrame, Report]:
        return self.prepare(self.stored(a)).solve(b)

    def solve_structural(self, a: SparseMatrix, coords: DataFrame, b: DataFrame) -> tuple[DataFrame, Report]:
        return self.prepare_structural(self.stored(a), coords).solve(b)


__all__ = ["Analysis", "Identity", "PreparedSystem", "Solver", "analyze"]
