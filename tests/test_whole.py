"""Queries over whole tables, on small fixtures, against brute force in Python."""

import pytest

from lattix import datasets
from lattix import queries as engine
from lattix.operators import graph
from lattix.schema import InvalidArgument, SparseMatrix
from lattix.solvers import regions
from lattix.solvers.options import HybridOptions


@pytest.fixture
def tables(spark, tmp_path):
    """Writes named tables as the star schema has them; the rest of a table's columns are not read here."""

    def put(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put


def test_components_links_parts_through_every_order(spark, tables):
    lines = [(60, 1), (60, 2), (61, 2), (61, 3), (7, 9), (7, 8), (120, 5), (121, 5), (121, 8)]
    d = tables(lineitem=(lines, "l_orderkey bigint, l_partkey bigint"))
    edges = [(p, 1_000_000_000 + o) for o, p in lines]
    parent = {k: k for e in edges for k in e}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for e in edges:
        a, b = sorted(map(root, e))
        parent[b] = a
    got = {r.node: r.component for r in engine.QUERIES["components"](spark, d).collect()}
    assert got == {k: root(k) for k in parent}


LINES = [(o, s) for o in range(1, 60) for s in {(o * 7) % 11, (o * o) % 11, (o * 5 + 3) % 11} if (o + s) % 3]


def longest(pairs, n):
    below = {i: {j for k, j in pairs if k == i} for i in range(n)}

    def chain(i):
        return max((1 + chain(j) for j in below[i]), default=0)

    return {i: chain(i) for i in range(n)}


def test_dependency_levels_reads_every_order(spark, tables):
    d = tables(lineitem=(LINES, "l_orderkey bigint, l_suppkey bigint"), supplier=([(s,) for s in range(12)], "s_suppkey bigint"))
    pairs = {(i, j) for o, i in LINES for q, j in LINES if o == q and j < i}
    got = {r.i: r.level for r in engine.QUERIES["dependency_levels"](spark, d).collect()}
    assert got == longest(pairs, 12)


@pytest.mark.parametrize("limit", [0, None])
def test_levels_on_the_driver_and_in_rounds(spark, limit):
    pairs = [(i, j) for i in range(9) for j in range(i) if (i * j + i) % 3 == 1 or j == i - 4]
    got = graph.levels(spark.createDataFrame(pairs, "i bigint, j bigint"), spark.range(9).withColumnRenamed("id", "i"), limit)
    assert {r.i: r.level for r in got.collect()} == longest(pairs, 9)


@pytest.mark.parametrize("name", ["common_neighbours", "common_neighbours_words"])
def test_common_neighbours_scores_every_edge(spark, tables, name):
    lines = [(o, p) for o in range(30) for p in {o % 23, (o * o + 1) % 23, (o * 3 + 15) % 23, 22}]
    d = tables(lineitem=(lines, "l_orderkey bigint, l_partkey bigint"), part=([(p,) for p in range(70)], "p_partkey bigint"))
    near = {p: {r for o, q in lines if q == p for n, r in lines if n == o and r != p} for p in range(23)}
    expected = {(a, b): len(near[a] & near[b]) for a in near for b in near[a] if a < b}
    assert any(a >= 12 for a, _ in expected)
    assert {(r.a, r.b): r.common for r in engine.QUERIES[name](spark, d).collect()} == expected


def test_matrix_market_queries_write_every_entry(spark, tables):
    lines = [(o, (o * 3) % 7, float(o % 5 + 1)) for o in range(1, 34)] + [(11, 5, 2.0), (20, 4, 3.0), (33, 1, 1.0)]
    d = tables(lineitem=(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double"), orders=([(o,) for o in range(34)], "o_orderkey bigint"), part=([(p,) for p in range(7)], "p_partkey bigint"))
    expected = {}
    for o, p, q in lines:
        expected[o, p] = expected.get((o, p), 0.0) + q
    assert {(r.i, r.j): r.v for r in engine.QUERIES["matrix_market_round_trip"](spark, d).collect()} == expected
    info = engine.QUERIES["matrix_market_info"](spark, d).first()
    assert (info.nrows, info.ncols, info.input_entries, info.duplicates_combined) == (34, 7, 36, 36 - len(expected))


def chunks(lines, risky, seeds, strength, size, most):
    """Core regions by brute force over neighbour sets."""
    near = {i: {q for o, p in lines if p == i for u, q in lines if u == o} for _, i in lines}
    by_strength = lambda nodes: sorted(nodes, key=lambda k: (-strength[k], k))
    left, found = set(risky), []
    while left:
        part, edge = set(), {min(left)}
        while edge:
            part |= edge
            edge = {q for k in edge for q in near[k]} & set(risky) - part
        left -= part
        free = set(part)
        for root in by_strength(part) if part & set(seeds) else ():
            order = [root] if root in free else []
            for k in order:
                order += [q for q in sorted(near[k]) if q in free and q not in order]
            order = order[:size]
            free -= set(order)
            found += [sorted(order)] if order else []
    return sorted(found, key=lambda g: (-max(strength[k] for k in g), g[0]))[:most]


@pytest.mark.parametrize("size, most", [(4, 3), (2, 50), (100, 100)])
def test_core_regions_equal_brute_force(spark, size, most):
    lines = [(o, p) for o in range(40) for p in {(o * 7) % 31, (o * o + 1) % 31} if (o + p) % 4]
    one = spark.createDataFrame(lines, "o bigint, p bigint")
    a = datasets.laplacian(one, 31)
    strength = {i: float((i * 13) % 9) for i in range(31)}
    nodes = {p for _, p in lines}
    risky, seeds = [i for i in sorted(nodes) if i % 5], [i for i in sorted(nodes) if strength[i] >= 7]
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "i bigint")
    r = spark.createDataFrame([(i, v if i % 2 else -v) for i, v in strength.items()], "i bigint, v double")
    got: dict[int, list[int]] = {}
    for row in regions.core_regions(a, ids(risky), ids(seeds), r, HybridOptions(regions=most, region_size=size)).collect():
        got.setdefault(row.region, []).append(row.i)
    assert [sorted(got[k]) for k in sorted(got)] == chunks(lines, risky, seeds, strength, size, most)
    assert regions.core_regions(a, ids([]), ids([]), r, HybridOptions()).count() == 0
    with pytest.raises(InvalidArgument):
        regions.core_regions(a, ids(risky), ids(seeds), r, HybridOptions(), limit=3)


def test_graphs_of_any_size_go_to_a_file_on_the_driver(spark, monkeypatch):
    """Neighbours, products and dense blocks from the file, though blocks are tiny and duplicates and empty rows are there."""
    import numpy as np

    from lattix.solvers import backend, coarse

    monkeypatch.setattr(backend, "BLOCK_ENTRIES", 7)
    assert not hasattr(coarse, "MOST_NODES")
    rng = np.random.default_rng(3)
    rows = [(int(i), int(j), float(v)) for i, j, v in zip(rng.integers(0, 40, 300) // 2 * 2, rng.integers(0, 40, 300), rng.integers(1, 9, 300), strict=True)]
    a = SparseMatrix(spark.createDataFrame(rows, "i bigint, j bigint, v double"), 40, 40)
    local, near, full = backend.LocalMatrix.collect(a), coarse.adjacency(a.df, 40), backend.DiskRows(a.df, 40, values=True)
    x = rng.normal(size=40)
    assert all(near[k].tolist() == full[k].tolist() == local.row(k)[0].tolist() for k in range(40)) and len(list(near)) == 40
    assert np.abs(full(x) - local(x)).max() < 1e-12 and (full.dense(np.array([2, 4, 9])) == local.dense(np.array([2, 4, 9]))).all()
    blocked = backend.BlockedMatrix(a)
    assert np.abs(blocked(x) - local(x)).max() < 1e-12 and blocked.packed.count() > 16  # no task packs its whole share at once


def test_sequential_solves_have_no_limit_of_entries(spark, monkeypatch):
    """Levels, regions and the interface system of more entries than LOCAL_NNZ."""
    from lattix import queries as Q
    from lattix.solvers import backend, schur

    sf, want = "/root/testdata/sf0.001", {}
    for name in ("dependency_levels", "core_regions", "schur_solve"):
        want[name] = sorted(Q.QUERIES[name](spark, sf).collect())
    monkeypatch.setattr(backend, "LOCAL_NNZ", 10)
    monkeypatch.setattr(schur, "DENSE_ROWS", 0)
    monkeypatch.setattr(backend.LocalMatrix, "collect", None)
    for name, rows in want.items():
        assert sorted(Q.QUERIES[name](spark, sf).collect()) == rows
