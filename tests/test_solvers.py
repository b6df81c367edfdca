import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.operators import algebra, layout, partition, profile
from lattix.plans import admission
from lattix.schema import DimensionMismatch, InvalidArgument, InvalidMatrix, LattixError, MissingDiagonal, NumericalBreakdown, SparseMatrix, UnsupportedProblem
from lattix.solvers import coarse, contiguous, krylov, partitioners, precond, regions
from lattix.solvers.backend import BlockedMatrix, LocalMatrix, kron_identity, packed_rows, product_table, stored_entries, to_array, to_vector
from lattix.solvers.options import CoarseOptions, Execution, GeneralOptions, GeneralPreconditioner, HybridOptions, ProblemClass, Restart, Selection, SolverOptions, Status
from lattix.solvers.schur import Schur
from lattix.solvers.system import Solver
from lattix.sources import block_diagonal, chain, csr_to_matrix, grid7, poisson_1d
from lattix.sources.generators import spd_surrogate


@pytest.fixture(scope="module")
def nonsymmetric(spark):
    """4 x 4 with a negative diagonal entry."""
    return csr_to_matrix(spark, 4, 4, [0, 2, 5, 8, 10], [0, 1, 0, 1, 2, 1, 2, 3, 2, 3], [4.0, 1.0, 2.0, -5.0, 1.0, 1.0, 6.0, 2.0, 1.0, 3.0])


@pytest.fixture(scope="module")
def cube(spark):
    """8 nodes of a unit cube, three rows each: diagonal 4, minus one along its 12 edges."""
    edges = [(a, b) for a in range(8) for b in range(a) if bin(a ^ b).count("1") == 1]
    rows = [(3 * n + c, 3 * n + c, 4.0) for n in range(8) for c in range(3)]
    rows += [(3 * p + c, 3 * q + c, -1.0) for a, b in edges for p, q in ((a, b), (b, a)) for c in range(3)]
    coords = spark.createDataFrame([(n, float(n & 1), float(n >> 1 & 1), float(n >> 2)) for n in range(8)], "node bigint, x double, y double, z double")
    return SparseMatrix(spark.createDataFrame(rows, "i bigint, j bigint, v double"), 24, 24), coords


def solution(df, n):
    return to_array(df, n)


def ones_problem(a):
    local = LocalMatrix.collect(a)
    return local, local(np.ones(a.nrows))


@pytest.mark.parametrize("execution", [Execution.LOCAL, Execution.BLOCKS, Execution.DATAFRAME])
def test_pcg_on_all_backends(spark, execution):
    a = grid7(spark, 4, 4, 3)
    local, b = ones_problem(a)
    x, report = Solver(execution=execution).solve(a, to_vector(spark, b))
    assert report.status == "converged" and report.execution == execution.value
    assert np.abs(solution(x, a.nrows) - 1).max() < 1e-6
    assert report.to_df(spark).count() == 1


def test_session_keeps_conjugacy_over_segments(spark):
    a, b = ones_problem(poisson_1d(spark, 60))
    whole = krylov.PcgSession.start(a, b)
    out = whole.advance(200)
    parts = krylov.PcgSession.start(a, b, trace=True)
    done = sum(parts.advance(7).iterations for _ in range(30))
    assert out.status is Status.CONVERGED and done == out.iterations and (whole.x == parts.x).all() and len(parts.trace) == done + 1
    assert parts.advance(5).iterations == 0


def test_starts_and_breakdowns(spark):
    a, b = ones_problem(poisson_1d(spark, 10))
    x, out = krylov.pcg(a, b, x=np.ones(10))
    assert out.status is Status.CONVERGED and out.iterations == 0
    assert krylov.pcg(a, np.zeros(10))[1].iterations == 0
    indefinite = lambda v: v * np.array([1, -1, 1, 1])
    assert krylov.pcg(indefinite, np.array([0.0, 1, 0, 0]))[1].status is Status.BREAKDOWN

    class Negative:
        def solve(self, r):
            return -r

    with pytest.raises(NumericalBreakdown):
        krylov.pcg(a, b, Negative())
    _, claimed = krylov.pcg(a, b)
    assert krylov.verified(lambda v: 2 * a(v), b, np.ones(10), claimed, SolverOptions()).status is Status.MAX_ITERATIONS


def test_options_are_checked():
    for bad in (dict(relative_tolerance=0.0), dict(relative_tolerance=-1.0), dict(max_iterations=-1)):
        with pytest.raises(InvalidArgument):
            SolverOptions(**bad)
    assert SolverOptions(0.0, 1e-3).target(100) == 1e-3
    for bad in (dict(overlap=9), dict(seed_fraction=0.0), dict(scale_jump=0.5)):
        with pytest.raises(InvalidArgument):
            HybridOptions(**bad)
    with pytest.raises(InvalidArgument):
        GeneralOptions(restart=80)
    o = HybridOptions()
    assert (o.probe_iterations, o.max_escalations, o.stage_iterations, o.region_size, o.regions, o.factor_bytes) == (12, 3, 24, 128, 8, 64 << 20)


def test_general_square(spark, nonsymmetric):
    truth = np.array([1.0, -2.0, 3.0, 0.5])
    b = to_vector(spark, LocalMatrix.collect(nonsymmetric)(truth))
    for general in (GeneralOptions(), GeneralOptions(preconditioner=GeneralPreconditioner.ILU0), GeneralOptions(restart=2, policy=Restart.ESCALATING, max_restart=4, stage_iterations=3), GeneralOptions(restart=2, policy=Restart.BUDGET_AWARE)):
        x, report = Solver(SolverOptions(1e-12), ProblemClass.GENERAL_SQUARE, general=general).solve(nonsymmetric, b)
        assert report.status == "converged" and np.abs(solution(x, 4) - truth).max() < 1e-9
    with pytest.raises(UnsupportedProblem):
        Solver().solve(nonsymmetric, b)


def test_restart_policies():
    control = krylov.BudgetAware(1e-8, 70)
    kept = [control(30, 30, 1.0, 0.999, 100) for _ in range(4)]
    assert kept == [30] * 4
    assert [control(30, 30, 0.999, 0.998, 100) for _ in range(4)][-1] == 60
    assert control(70, 1, 1, 1, 1) == 70
    fast = krylov.BudgetAware(1e-8, 70)
    assert {fast(30, 30, 0.5**k, 0.5 ** (k + 1), 2000 - 30 * k) for k in range(24)} == {30}


def test_ilu(spark, nonsymmetric):
    a = LocalMatrix.collect(poisson_1d(spark, 30))  # no fill: the factors are exact
    b = a(np.arange(30.0))
    assert np.abs(precond.Ilu0(a).solve(b) - np.arange(30)).max() < 1e-9
    low, up = precond.Ilu0(a).levels()
    assert low.tolist() == list(range(30)) and up.tolist() == list(range(29, -1, -1))
    messy = csr_to_matrix(spark, 2, 2, [0, 3, 5], [1, 0, 0, 1, 0], [1.0, 1.5, 2.5, 3.0, 2.0])
    tidy = csr_to_matrix(spark, 2, 2, [0, 2, 4], [0, 1, 0, 1], [4.0, 1.0, 2.0, 3.0])
    r = np.array([1.0, 2.0])
    assert (precond.Ilu0(messy).solve(r) == precond.Ilu0(tidy).solve(r)).all()
    missing = csr_to_matrix(spark, 2, 2, [0, 1, 3], [1, 0, 1], [1.0, 2.0, 3.0])
    with pytest.raises(MissingDiagonal):
        precond.Ilu0(missing)
    assert np.isfinite(precond.Ilu0(missing, identity_fallback=True).solve(r)).all()
    with pytest.raises(NumericalBreakdown):
        precond.Ilu0(csr_to_matrix(spark, 2, 2, [0, 2, 4], [0, 1, 0, 1], [1.0, 1.0, 1.0, 1.0]))


def test_preconditioners_are_positive_and_agree_on_tables_and_arrays(spark):
    a = grid7(spark, 4, 3, 2)
    owners = partition.owners_of(spark, partition.balanced(24, 3))
    overlap = spark.createDataFrame([(0, i) for i in range(10)] + [(1, i) for i in range(7, 17)], "region bigint, i bigint")
    made = [precond.Jacobi.from_matrix(a), precond.block_jacobi(a, 5), precond.block_jacobi(a, 5, owners), precond.schwarz(a, overlap), precond.ic0_blocks(a, owners), precond.two_level(a, 1, 6), precond.two_level(a, 2, 8, "graph"),
            precond.two_level(a, 1, 6, "graph", "jacobi_smoothed"), precond.rank_constant(a, owners), precond.Sum(precond.Jacobi.from_matrix(a), precond.Identity())]
    rng = np.random.default_rng(0)
    local, b = ones_problem(a)
    for m in made:
        r, s = rng.normal(size=24), rng.normal(size=24)
        z = m.solve(r)
        assert r @ z > 0 and abs(s @ z - r @ m.solve(s)) < 1e-9 * max(1, abs(s @ z))
        assert np.abs(solution(m.apply(to_vector(spark, r)), 24) - z).max() < 1e-10
        x, out = krylov.pcg(local, b, m)
        assert out.status is Status.CONVERGED and np.abs(x - 1).max() < 1e-6


def test_block_factors_reject_bad_blocks():
    with pytest.raises(NumericalBreakdown):
        precond.cholesky(np.array([[1.0, 0.5], [0.4, 1.0]]))
    with pytest.raises(NumericalBreakdown):
        precond.cholesky(np.array([[1.0, 2.0], [2.0, 1.0]]))
    with pytest.raises(NumericalBreakdown):
        precond.cholesky(np.zeros((2, 2)))


def test_galerkin_is_the_dense_product(spark):
    a = grid7(spark, 4, 3, 1)
    aggregates, count = coarse.contiguous_aggregates(a, 1, 5)
    p = coarse.piecewise_transfer(a, 1, aggregates, count)
    s = coarse.smoothed_transfer(a, p, 1.7)
    for t in (p, s):
        dense, full = LocalMatrix.collect(t).dense(), LocalMatrix.collect(a).dense()
        assert np.abs(LocalMatrix.collect(algebra.galerkin(a, t)).dense() - dense.T @ full @ dense).max() < 1e-12
    own = aggregates.select(F.col("node").alias("i"), F.col("agg").alias("c"))
    assert np.abs(LocalMatrix.collect(algebra.galerkin_piecewise(a, own, count)).dense() - LocalMatrix.collect(algebra.galerkin(a, p)).dense()).max() < 1e-12


def test_rigid_body_modes(spark, cube):
    a, coords = cube
    for balanced in (False, True):
        x, report = Solver(hybrid=HybridOptions(coarse=CoarseOptions(target_dimension=12))).prepare_structural(a, coords, balanced).solve(algebra.spmv(a, to_vector(spark, np.ones(24))))
        assert report.status == "converged" and np.abs(solution(x, 24) - 1).max() < 1e-6 and report.coarse_dimension in (6, 12)
    aggregates, count = coarse.contiguous_aggregates(a, 3, 8)
    modes = LocalMatrix.collect(coarse.rigid_transfer(a, coords, aggregates, count)).dense()
    assert modes.shape == (24, 6) and np.linalg.matrix_rank(modes) == 6
    assert (modes[0::3, 0] == 1).all() and (modes[1::3, 0] == 0).all()
    flat = coords.withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0)).withColumn("z", F.lit(0.0))
    with pytest.raises(NumericalBreakdown):
        coarse.rigid_transfer(a, flat, aggregates, count)
    x, report = Solver().solve_structural(a, coords, to_vector(spark, np.ones(24)))
    assert report.status == "converged"
    with pytest.raises(UnsupportedProblem):
        Solver().prepare_structural(poisson_1d(spark, 4), coords)


def test_aggregate_sizes():
    assert coarse.recommended_rigid_nodes(1000, 60) == 128
    assert coarse.recommended_rigid_nodes(3, 6) == 3
    assert all(n % coarse.recommended_rigid_nodes(n, 36) not in (1, 2) or coarse.recommended_rigid_nodes(n, 36) == n for n in range(3, 300))
    assert coarse.recommended_nodes(30, 3, 9) == 4
    with pytest.raises(InvalidArgument):
        coarse.recommended_nodes(31, 3, 9)


def test_graph_aggregation():
    path = [np.array([k for k in (i - 1, i + 1) if 0 <= k < 10]) for i in range(10)]
    own, count = coarse.grow_aggregates(path, 4)
    assert own.tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2] and count == 3
    own, count = coarse.grow_aggregates(path, 9)  # the last node alone is below a quarter and merges
    assert count == 1
    own, count = coarse.grow_aggregates(path, 4, least=3)
    assert count == 2 and own.tolist() == [0] * 4 + [1] * 6
    with pytest.raises(InvalidArgument):
        coarse.grow_aggregates([np.array([1]), np.array([0])], 4, least=3)


def test_regions_and_budget(spark):
    a = LocalMatrix.collect(block_diagonal(spark, 4, [6, 3], 2))
    n = a.nrows
    risk = np.array([k in {*range(4, 10), *range(12, 15)} for k in range(n)])
    r = np.zeros(n)
    r[[6, 13]] = [5.0, 7.0]
    seeds = np.abs(r) > 0
    o = HybridOptions(region_size=4)
    found = regions.discover(a, risk, seeds, r, o)
    assert found == [(12, 13, 14), (4, 5, 6, 7), (8, 9)]
    assert regions.discover(a, np.zeros(n, bool), seeds, r, o) == [(13,), (6,)]
    assert regions.expand(a, [(6,)], r, o) == [(5, 6, 7)]
    assert regions.expand(a, [(5, 6)], r, HybridOptions(region_size=3)) == [(4, 5, 6)]
    inv = np.ones(n)
    room = precond.factor_bytes(n, [3])
    for rule in (Selection.BENEFIT_PER_BYTE, Selection.JACOBI_ENERGY_PER_BYTE):
        assert regions.within_budget(n, [], found, r, inv, rule, room) == ([(12, 13, 14)], 2)
    assert regions.within_budget(n, [], [(0, 1), (2,), (2,)], r, inv, Selection.CANDIDATE_ORDER, precond.factor_bytes(n, [1])) == ([(2,)], 1)
    with pytest.raises(InvalidArgument):
        regions.within_budget(n, [(0, 1, 2)], [], r, inv, Selection.CANDIDATE_ORDER, 10)


def test_adaptive_solve_escalates_and_learns(spark):
    a = block_diagonal(spark, 16, [32], 0)
    local, b = ones_problem(a)
    b = b + np.arange(a.nrows) % 3
    o = HybridOptions(probe_iterations=4, region_size=64)
    system = Solver(hybrid=o).prepare(a)
    x, report = system.solve(to_vector(spark, b))
    assert report.status == "converged" and report.escalations >= 1 and report.solver == "hybrid"
    assert np.linalg.norm(b - local(solution(x, a.nrows))) <= 2e-8 * np.linalg.norm(b)
    plain, _ = Solver(hybrid=HybridOptions(enabled=False)).solve(a, to_vector(spark, b))
    again, second = system.solve(to_vector(spark, b))
    assert second.reused and second.iterations < report.iterations
    assert np.abs(solution(again, a.nrows) - solution(plain, a.nrows)).max() < 1e-5
    with pytest.raises(LattixError):
        system.solve(to_vector(spark, b), block_diagonal(spark, 16, [31, 1], 0))
    with pytest.raises(LattixError):
        system.check(SparseMatrix(a.df.withColumn("v", F.col("v") * 2), a.nrows, a.ncols))


def test_coarse_solve(spark):
    a = grid7(spark, 4, 4, 4)
    _, b = ones_problem(a)
    x, report = Solver(hybrid=HybridOptions(coarse=CoarseOptions(True, 1, 8, "graph"))).solve(a, to_vector(spark, b))
    assert report.status == "converged" and 0 < report.coarse_dimension <= 16 and np.abs(solution(x, 64) - 1).max() < 1e-6


def test_blocked_product(spark):
    a = chain(spark, 500)
    x = np.random.default_rng(1).normal(size=500)
    blocked = BlockedMatrix(a, 4)
    assert np.abs(blocked(x) - LocalMatrix.collect(a)(x)).max() < 1e-12 and (blocked.diagonal() == 2).all()


def test_schur(spark):
    a = LocalMatrix.collect(grid7(spark, 4, 4, 2))
    owners = partitioners.multisource(a.neighbours(), 3)
    dense = a.dense()
    s = Schur(a, owners)
    g = s.interface
    inner = np.setdiff1d(np.arange(32), g)
    exact = dense[np.ix_(g, g)] - dense[np.ix_(g, inner)] @ np.linalg.inv(dense[np.ix_(inner, inner)]) @ dense[np.ix_(inner, g)]
    assert np.abs(s.form() - exact).max() < 1e-12
    b = np.arange(32.0)
    for made in (s, Schur(a, owners, SolverOptions(1e-13))):
        assert np.abs(made.solve(b, SolverOptions(1e-11))[0] - np.linalg.solve(dense, b)).max() < 1e-8


def test_spectra(spark):
    a = LocalMatrix.collect(grid7(spark, 4, 4, 3))
    low, high, _ = krylov.lanczos(a, 48, 48)
    values = np.linalg.eigvalsh(a.dense())
    assert abs(low - values[0]) < 1e-8 and abs(high - values[-1]) < 1e-8
    d = a.diagonal()
    scaled = a.dense() / np.sqrt(np.outer(d, d))
    x = 1.0 + (np.arange(48) * 17 + 11) % 101
    for _ in range(10):
        x = scaled @ (x / np.linalg.norm(x))
    assert abs(coarse.spectral_radius(a.to_df(spark)) - np.linalg.norm(x)) < 1e-9


def two_clusters():
    near = [np.array([k for k in range(6 * (i // 6), 6 * (i // 6) + 6) if k != i]) for i in range(12)]
    near[5], near[6] = np.append(near[5], 6), np.append(5, near[6])
    return near


def test_partitioners(spark):
    lines = [np.array([k for k in (i - 2, i + 2) if 0 <= k < 8]) for i in range(8)]  # two interleaved chains
    grown = partitioners.region_growth(lines, 2)
    assert partitioners.cut(lines, grown) == 0 and partitioners.cut(lines, np.arange(8) // 4) > 0
    for near in (two_clusters(), LocalMatrix.collect(grid7(spark, 4, 4, 4)).neighbours(), LocalMatrix.collect(chain(spark, 21)).neighbours()):
        for ranks in (1, 2, 3):
            sizes = partitioners.targets(len(near), ranks)
            for how in (partitioners.region_growth, partitioners.multisource):
                own = how(near, ranks)
                assert np.bincount(own, minlength=ranks).tolist() == sizes and (own == how(near, ranks)).all()
            own = partitioners.multilevel(near, ranks, per_rank=4)
            assert np.bincount(own, minlength=ranks).max() <= math.ceil(len(near) / ranks) * 1.03 + 1
            better = partitioners.refine_boundary(near, partitioners.multisource(near, ranks), ranks)
            assert partitioners.cut(near, better) <= partitioners.cut(near, partitioners.multisource(near, ranks))
    assert partitioners.cut(two_clusters(), partitioners.multilevel(two_clusters(), 2, per_rank=2)) == 2
    with pytest.raises(InvalidArgument):
        partitioners.region_growth(two_clusters(), 13)


def test_reverse_cuthill_mckee():
    rng = np.random.default_rng(2)
    names = rng.permutation(50)
    near = [None] * 50
    for k in range(50):
        near[names[k]] = np.sort(np.array([names[m] for m in (k - 1, k + 1) if 0 <= m < 50]))
    order = partitioners.reverse_cuthill_mckee(near)
    place = np.argsort(order)
    assert sorted(order) == list(range(50)) and max(abs(place[i] - place[j]) for i in range(50) for j in near[i]) == 1


def test_cut_refinement():
    bounds, pressure = list(range(0, 21, 2)), {10: 9, 8: 1, 12: 4}
    load = [5 * k for k in range(11)]
    got = partitioners.refine_cuts(bounds, pressure, load, [10], radius=2, cap=1.3)
    assert got.accepted and got.cuts == [14] or got.cuts == [8]
    assert pressure.get(got.cuts[0], 0) < 9
    assert partitioners.refine_cuts(bounds, pressure, load, [10], radius=2, cap=1.0).cuts == [10]


def test_admission(spark):
    assert admission.calibration_key((1, 2), 3, 4, "x") != admission.calibration_key((1, 2), 3, 5, "x")
    epochs = lambda rows: spark.createDataFrame(rows, "epoch int, baseline_ns bigint, graph_ns bigint")
    good = [(k, 1000 + k, 900) for k in range(3)]
    assert admission.robust_cost(epochs(good), 799, 10).first().admitted
    assert not admission.robust_cost(epochs(good), 800, 10).first().admitted  # not strictly above with a quarter more
    assert not admission.robust_cost(epochs(good[:2]), 1, 10).first().admitted
    assert not admission.robust_cost(epochs([*good, (9, 5, 5)]), 1, 10).first().admitted


def blocks_of(spark, sizes):
    return layout.offsets(spark.createDataFrame([(k, s, 0) for k, s in enumerate(sizes)], "block_index bigint, components bigint, field_id int"))


def test_cost_aware_cuts(spark):
    """Two heavy clusters joined by one edge at 9: the even cut at 8 crosses a cluster."""
    pairs = [(a, b) for a in range(9) for b in range(9) if a != b] + [(a, b) for a in range(9, 16) for b in range(9, 16) if a != b] + [(8, 9), (9, 8)]
    rows = [(k, k, 20.0) for k in range(16)] + [(a, b, -1.0) for a, b in pairs]
    a = SparseMatrix(spark.createDataFrame(rows, "i bigint, j bigint, v double"), 16, 16)
    lay = blocks_of(spark, [1] * 16)
    good = (1000, 500, 10)
    decide = lambda ranks=2, **o: contiguous.cost_aware(a, lay, ranks, contiguous.CostOptions(**o))
    assert decide(1)[2] == "single_rank" and decide()[2] == "no_expected_reuse"
    assert decide(expected_products=9)[2] == "no_calibration"
    assert decide(expected_products=9, calibration=good, radius=0)[2] == "zero_search_radius"
    assert decide(expected_products=9, calibration=(500, 500, 1))[2] == "no_calibrated_speedup"
    assert decide(expected_products=9, calibration=(1000, 500, 4500))[2] == "unamortized_preparation"
    assert decide(expected_products=9, calibration=good, row_imbalance=1.0, nnz_imbalance=1.5)[2] == "load_imbalance_limit"
    parts, kind, why = decide(expected_products=9, calibration=good, row_imbalance=1.2, nnz_imbalance=1.5)
    assert (parts, kind, why) == ([(0, 0, 9), (1, 9, 16)], "graph", "graph_selected")
    assert decide(expected_products=9, calibration=good, nnz_imbalance=1.0)[2] in ("graph_proposal_rejected", "graph_not_distinct")
    with pytest.raises(DimensionMismatch):
        contiguous.cost_aware(a, blocks_of(spark, [1] * 15), 2)
    with pytest.raises(InvalidArgument):
        contiguous.CostOptions(row_imbalance=0.9)


def test_field_halos_and_topology(spark):
    a, lay = chain(spark, 12), blocks_of(spark, [3, 3, 3, 3])
    halos = contiguous.FieldHalos(a, lay, [(0, 0, 6), (1, 6, 12)])
    assert sorted(tuple(r) for r in halos.plan.collect()) == [(0, 1, 6), (1, 0, 5)] and halos.matrices.count() == 34
    with pytest.raises(InvalidArgument):
        contiguous.FieldHalos(a, lay, [(0, 0, 5), (1, 5, 12)])
    seeds = spark.createDataFrame([(7, 4), (8, 0)], "region bigint, i bigint")
    topology = contiguous.FieldTopology(a, lay)
    got = {}
    for r in topology.grow(seeds, 1).collect():
        got.setdefault(r.region, set()).add(r.i)
    assert got == {7: set(range(9)), 8: set(range(6))}


def test_promotion(spark):
    a = grid7(spark, 5, 5, 2)
    local, b = ones_problem(a)
    b = b + np.arange(50) % 4
    strong = precond.block_jacobi(a, 10)
    x, out, promoted, trace = krylov.pcg_promoting(local, b, precond.Identity(), lambda r: strong, window=3, ratio=1e-6)
    assert promoted == 3 and out.status is Status.CONVERGED and np.abs(local(x) - b).max() < 1e-5
    _, out, promoted, trace = krylov.pcg_promoting(local, b, strong, lambda r: strong, window=3, ratio=0.99)
    assert promoted is None and trace[0][0] == 0 and trace[-1][0] == out.iterations
    assert krylov.trace_table(spark, trace).count() == len(trace)


def test_selected_blocks(spark):
    a = block_diagonal(spark, 2, [4, 4], 0)
    r = to_vector(spark, np.array([0.0, 0, 1, 1, 1, 1, 9, 0, 0, 0]))
    picked = partition.score_blocks(a, r, 5, "residual_energy", 25 * 8)
    assert [x.block for x in picked.where("taken").collect()] == [1]
    m = precond.selected_blocks(a, picked, 5)
    assert np.isfinite(m.solve(np.ones(10))).all() and m.solve(np.ones(10))[0] == 1.0
    assert partition.score_blocks(a, r, 5, "boundary_coupling", 400).where("taken").count() == 2


def test_spd_classes(spark):
    assert profile.classify_spd(grid7(spark, 3, 2, 2)) == "strict_diagonal_dominance"
    assert profile.classify_spd(poisson_1d(spark, 12)) == "anchored_weak_diagonal_dominance"
    dense = csr_to_matrix(spark, 2, 2, [0, 2, 4], [0, 1, 0, 1], [2.0, 1.9, 1.9, 1.9])
    assert profile.classify_spd(dense) == "bounded_cholesky"
    with pytest.raises(UnsupportedProblem):
        profile.classify_spd(csr_to_matrix(spark, 2, 2, [0, 2, 4], [0, 1, 0, 1], [1.0, 2.0, 2.0, 1.0]))
    with pytest.raises(UnsupportedProblem):
        profile.classify_spd(csr_to_matrix(spark, 2, 2, [0, 2, 4], [0, 1, 0, 1], [3.0, 1.0, 1.5, 3.0]))
    assert profile.rayleigh_screen(poisson_1d(spark, 12)).first().smallest > 0


def test_dispatch_and_single_precision(spark):
    a = grid7(spark, 3, 3, 2)
    owners = partition.owners_of(spark, partition.balanced(18, 2))
    r = np.arange(18.0)
    for kind in ("identity", "jacobi", "block_jacobi", "local_block_cholesky", "local_ic0", "rank_constant"):
        assert np.isfinite(precond.make(kind, a, owners=owners, width=4).solve(r)).all()
    with pytest.raises(InvalidArgument):
        precond.make("magic", a)
    wide, single = precond.two_level(a, 1, 6), precond.two_level(a, 1, 6, single=True)
    assert np.abs(wide.solve(r) - single.solve(r)).max() < 1e-4


@pytest.mark.parametrize("policy", ["BUDGET_AWARE", "ESCALATING"])
def test_restart_policy_is_the_same_over_tables(spark, policy):
    """Beyond the driver's size the restarts are those that small systems get, step by step."""
    a = SparseMatrix(chain(spark, 24).df.withColumn("v", F.when(F.col("j") > F.col("i"), F.col("v") / 2).otherwise(F.col("v"))), 24, 24)
    b = spark.range(24).select(F.col("id").alias("i"), (1.0 + F.col("id") % 5).alias("v"))
    general = GeneralOptions(restart=1, max_restart=4, stage_iterations=3, policy=Restart[policy])
    found = []
    for execution in (Execution.LOCAL, Execution.DATAFRAME):
        x, report = Solver(SolverOptions(1e-12, max_iterations=11), ProblemClass.GENERAL_SQUARE, execution, general=general).solve(a, b)
        found.append((report.iterations, report.restart, report.final_residual, to_array(x, 24)))
    assert found[0][:2] == found[1][:2] and found[0][1] > 1
    assert abs(found[0][2] - found[1][2]) < 1e-9 and np.abs(found[0][3] - found[1][3]).max() < 1e-9


@pytest.mark.parametrize("symmetric", [True, False])
@pytest.mark.parametrize("dealt", ["floor(i / 10)", "i % 3"])
def test_owner_factors_are_stored_in_pieces(spark, monkeypatch, symmetric, dealt):
    """No piece has more entries than a block may, whatever the owner's block has; all ways to apply them agree."""
    monkeypatch.setattr(precond, "BLOCK_ENTRIES", 16)
    n = 30
    dense = np.array([[-1.0 if i != j and (i * j + i + j) % 3 else 0.0 for j in range(n)] for i in range(n)])
    dense[np.arange(n), np.arange(n)] = 1 - dense.sum(1)
    if not symmetric:
        dense = np.where(np.triu(np.ones((n, n)), 1) > 0, dense / 2, dense)
    a = SparseMatrix(spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)], "i bigint, j bigint, v double"), n, n)
    owners = a.rows().selectExpr("i", f"cast({dealt} as int) as owner")
    made = precond.OwnerFactors(a, owners, symmetric)
    sizes = [r.n for r in made.packed.collect()]
    assert len(sizes) > 3 and max(sizes) <= 16
    r = np.arange(1.0, n + 1)
    local = made.solve(r)
    table = {x.i: x.v for x in made.apply(spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "i bigint, v double")).collect()}
    made.local = False
    assert np.allclose(made.solve(r), local) and np.allclose([table[i] for i in range(n)], local)
    owned = np.array([x.owner for x in owners.orderBy("i").collect()])
    for k in range(3):
        block = dense[np.ix_(owned == k, owned == k)]
        low, up = ilu0_dense(block)
        assert np.allclose(low @ up @ local[owned == k], r[owned == k])


def ilu0_dense(block):
    """Incomplete LU without fill by brute force; for a symmetric matrix L U = L D Lt is the incomplete Cholesky product."""
    lu, kept = block.copy(), block != 0
    for i in range(len(lu)):
        for k in range(i):
            if kept[i, k]:
                lu[i, k] /= lu[k, k]
                lu[i, k + 1 :] -= np.where(kept[i, k + 1 :] & kept[k, k + 1 :], lu[i, k] * lu[k, k + 1 :], 0.0)
    return np.tril(lu, -1) + np.eye(len(lu)), np.triu(lu)


def test_factors_go_level_by_level():
    rng = np.random.default_rng(3)
    for n, fill in ((1, 1.0), (60, 0.1), (60, 1.0), (40, 0.0)):
        dense = np.where(rng.random((n, n)) < fill, rng.normal(size=(n, n)), 0.0)
        dense = dense + dense.T + np.eye(n) * 10 * n
        i, j = np.nonzero(np.tril(dense))
        ptr, col, val = np.searchsorted(i, np.arange(n + 1)), j, dense[i, j].copy()
        precond._incomplete_cholesky(ptr, col, val)
        level = precond._levels(ptr, col)
        assert (level[i[i > j]] > level[j[i > j]]).all() and level.max() < n
        low, up = ilu0_dense(dense)
        r = rng.normal(size=n)
        assert np.allclose(low @ up @ precond._triangular(ptr, col, val, level, r, True), r)


def test_packed_tables_are_stored_in_small_groups(spark):
    from pathlib import Path

    import pyarrow.parquet as pq

    from lattix.plans.storage import materialize

    rng = np.random.default_rng(0)
    stored = materialize(spark.createDataFrame([(bytearray(rng.bytes(1 << 20)),) for _ in range(40)], "packed binary").coalesce(1))
    groups = [f.metadata.row_group(k).num_rows for f in map(pq.ParquetFile, Path(stored._stored_at.removeprefix("file:")).glob("*.parquet")) for k in range(f.num_row_groups)]
    assert sum(groups) == 40 and max(groups) <= 20


@pytest.fixture(scope="module")
def threefold(spark):
    """Three rows for each node of a grid, kept as copies of packed blocks, and the same matrix entry by entry."""
    a = grid7(spark, 5, 4, 3)
    wide = Solver.stored(kron_identity(a, 3))
    explicit = a.df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)]))).select((3 * F.col("i") + F.col("k")).alias("i"), (3 * F.col("j") + F.col("k")).alias("j"), "v")
    coords = spark.createDataFrame([(n, float(n % 5), float(n // 5 % 4), float(n * n % 11)) for n in range(60)], "node bigint, x double, y double, z double")
    return wide, SparseMatrix(explicit, 180, 180), coords


def test_copies_stand_for_a_kronecker_product(spark, threefold):
    wide, explicit, _ = threefold
    assert (LocalMatrix.collect(wide).dense() == LocalMatrix.collect(explicit).dense()).all() and stored_entries(wide) == explicit.df.count()
    assert (LocalMatrix.collect(kron_identity(wide, 2)).dense() == np.kron(LocalMatrix.collect(explicit).dense(), np.eye(2))).all()
    x = np.random.default_rng(1).random(180)
    y = LocalMatrix.collect(explicit)(x)
    assert np.abs(BlockedMatrix(wide)(x) - y).max() < 1e-12 and np.abs(to_array(product_table(wide, x), 180) - y).max() < 1e-12
    assert Solver.stored(wide) is wide
    gaps = SparseMatrix(spark.createDataFrame([(0, 1, 2.0), (3, 0, 1.0), (3, 3, 4.0)], "i bigint, j bigint, v double"), 5, 5)
    assert BlockedMatrix(gaps)(np.arange(5.0)).tolist() == [2.0, 0.0, 0.0, 12.0, 0.0]


def test_blocks_tell_what_tables_tell(spark, threefold):
    wide, explicit, _ = threefold
    rows = [(0, 0, 2.0), (0, 2, -0.0), (1, 1, 1.5), (2, 2, 3.0), (2, 1, -1.0)]
    odd = SparseMatrix(spark.createDataFrame(rows, "i bigint, j bigint, v double"), 3, 3)
    for a, plain, even in ((wide, explicit, True), (kron_identity(odd, 1), odd, False), (kron_identity(odd, 3), LocalMatrix.collect(kron_identity(odd, 3)).to_df(spark), False)):
        told, sign = profile.told_by_blocks(a), profile.signature(plain).first()
        assert (told["structure"], told["values"], told["nnz"], told["positive"]) == (sign.structure, sign["values"], plain.df.count(), a.nrows)
        assert told["mirrored"] is even and told["bad"] is None
    for bad in ((1, 2, float("nan")), (1, 7, 1.0)):
        a = SparseMatrix(spark.createDataFrame([*rows, bad], "i bigint, j bigint, v double"), 3, 3)
        with pytest.raises(InvalidMatrix):
            Solver().analyze(SparseMatrix(a.df, 3, 3, packed_rows(a.df, 3, 3)))
    with pytest.raises(UnsupportedProblem):
        a = SparseMatrix(odd.df.where("i < 2"), 3, 3)
        Solver().analyze(SparseMatrix(a.df, 3, 3, packed_rows(a.df, 3, 3)))


def test_rigid_modes_in_blocks_equal_those_in_tables(threefold):
    wide, explicit, coords = threefold
    r = np.random.default_rng(2).random(180)
    for kind in ("graph", "contiguous"):
        for balanced in (False, True):
            there = precond.rigid_body(explicit, coords, 30, kind, balanced)
            here = precond.rigid_body(wide, coords, 30, kind, balanced, arrays=True, mirrored=True)
            assert isinstance(here, precond.RigidBody) and here.dimension == there.dimension > 6
            assert np.abs(here.coarse - there.coarse).max() < 1e-10 and np.abs(here.solve(r) - there.solve(r)).max() < 1e-10
    flat = coords.withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0)).withColumn("z", F.lit(0.0))
    with pytest.raises(NumericalBreakdown):
        precond.rigid_body(wide, flat, 30, "contiguous", arrays=True)
    # a node without coordinates, or with two, goes by tables
    assert coarse.node_coordinates(coords.where("node <> 5"), 60) is None and coarse.node_coordinates(coords.where("node <> 5").union(coords.where("node = 4")), 60) is None


def test_structural_solve_makes_no_entries_of_the_wide_matrix(spark, threefold, monkeypatch):
    """Neither the products nor the coarse matrix nor the graph join or exchange entries: at 434 million of them that had no end."""
    wide, explicit, coords = threefold

    def refuse(*_, **__):
        raise AssertionError("entries are joined or exchanged")

    for owner, name in ((algebra, "galerkin"), (coarse, "node_graph"), (precond, "block_jacobi"), (profile, "signature")):
        monkeypatch.setattr(owner, name, refuse)
    solver = Solver(SolverOptions(1e-10), execution=Execution.BLOCKS, hybrid=HybridOptions(coarse=CoarseOptions(target_dimension=30)))
    x = np.random.default_rng(3).random(180)
    got, report = solver.solve_structural(wide, coords, product_table(wide, x))
    assert report.status == "converged" and report.preconditioner == "rigid_body_graph" and np.abs(to_array(got, 180) - x).max() < 1e-8


def test_structural_solve_without_blocks_packs_once(spark, threefold):
    _, explicit, coords = threefold
    solver = Solver(SolverOptions(1e-10), execution=Execution.BLOCKS, hybrid=HybridOptions(coarse=CoarseOptions(target_dimension=30)))
    x = np.random.default_rng(4).random(180)
    system = solver.prepare_structural(explicit, coords)
    got, report = system.solve(to_vector(spark, LocalMatrix.collect(explicit)(x)))
    assert isinstance(system.base, precond.RigidBody) and report.status == "converged" and np.abs(to_array(got, 180) - x).max() < 1e-8
    system.check(explicit)


def test_node_rows_that_go_on_in_another_block(spark):
    a = spd_surrogate(grid7(spark, 4, 4, 3))  # 48 rows, 16 nodes
    packed = SparseMatrix(a.df, 48, 48, packed_rows(a.df, 48, 48, tasks=7))
    near, want = coarse.NodeRows(packed, 3), coarse.adjacency(coarse.node_graph(a, 3), 16)
    assert packed.blocks.count() == 7 and len(near) == 16
    assert [near[k].tolist() for k in range(16)] == [want[k].tolist() for k in range(16)]
    assert near.of(np.array([3, 0, 3])).tolist() == want.of(np.array([3, 0, 3])).tolist() == [*want[3], *want[0], *want[3]]


def test_growth_by_queues_is_that_node_by_node():
    """The order of a queue decides which nodes an aggregate of bounded size takes."""
    rng = np.random.default_rng(5)
    for n, edges, target in ((1, 0, 3), (40, 60, 5), (40, 400, 9), (60, 50, 4), (50, 200, 1)):
        pairs = {(int(i), int(j)) for i, j in rng.integers(0, n, (edges, 2)) if i != j}
        near = [np.array(sorted({j for i, j in pairs | {(j, i) for i, j in pairs} if i == k}), np.int64) for k in range(n)]
        own = [-1] * n
        for number, seed in enumerate(k for k in range(n) if own[k] < 0):
            queue, size = [seed], 0
            while queue and size < target:
                node = queue.pop(0)
                if own[node] < 0:
                    own[node], size = number, size + 1
                    queue += [int(j) for j in near[node] if own[j] < 0]
        whole = coarse.grow_aggregates(near, target, 1)[0] if target < 8 else None  # below 8 none is small enough to merge
        grown = np.full(n, -1)
        for number, seed in enumerate(k for k in range(n) if grown[k] < 0):
            grown[seed], front, size = number, np.array([seed]), 1
            while len(front) and size < target:
                front = coarse._grown(near, front, grown, number, target - size)
                size += len(front)
        assert grown.tolist() == own and (whole is None or whole.tolist() == own)
