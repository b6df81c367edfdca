import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.functions import trailing_zeros
from lattix.operators import algebra, graph, layout, masks, partition, profile, topology
from lattix.operators.components import connected_components
from lattix.plans.storage import materialize
from lattix.schema import DimensionMismatch, InvalidArgument, InvalidMatrix, MissingDiagonal, SparseMatrix
from lattix.solvers.backend import LocalMatrix
from lattix.sources import chain, grid7


def matrix(spark, rows, nrows, ncols):
    return SparseMatrix(spark.createDataFrame(rows, "i bigint, j bigint, v double"), nrows, ncols)


def vector(spark, values):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "i bigint, v double")


@pytest.fixture(scope="module")
def ragged(spark):
    """Unsorted, with duplicates, an explicit zero, an empty row and bits in the last place of a word."""
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(0, 90)), int(rng.integers(0, 200)), float(rng.integers(-4, 5))) for _ in range(900)]
    rows = [r for r in rows if r[0] != 17] + [(3, 63, 2.0), (3, 127, 1.0), (3, 0, 5.0), (4, 191, 0.0), (5, 63, 1.0)]
    return matrix(spark, rows, 90, 200), rows


def dense(rows, shape):
    out = np.zeros(shape)
    for i, j, v in rows:
        out[i, j] += v
    return out


def array(df, n):
    out = np.zeros(n)
    for r in df.collect():
        out[r.i] = r.v
    return out


def test_products_on_every_layout(spark, ragged):
    a, rows = ragged
    m, x = dense(rows, (90, 200)), np.arange(200) % 7 - 3.0
    y, xs = m @ x, vector(spark, np.arange(200) % 7 - 3.0)
    assert (array(algebra.spmv(a, xs), 90) == y).all() and algebra.spmv(a, xs).count() == 90
    assert (array(topology.tiled_spmv(topology.tiles(a), xs), 90) == y).all()
    for width in (3, 6, 7):
        assert (array(topology.block_spmv(topology.dense_blocks(a, width), xs, width, 90), 90) == y).all()
    assert (LocalMatrix.collect(a)(x) == y).all()
    assert (array(algebra.spmv_transposed(a, vector(spark, np.ones(90))), 200) == m.T @ np.ones(90)).all()
    with pytest.raises(DimensionMismatch):
        algebra.spgemm(a, a)


def test_restriction_matches_dense(spark, ragged):
    a, rows = ragged
    m = dense(rows, (90, 200))
    active = [j for j in range(200) if j % 3 == 0 or j in (63, 127)]
    mask = masks.mask_of(spark, 200, active)
    keep = m * np.isin(np.arange(200), active)
    for restricted in (masks.restrict_columns(a, mask), masks.restrict_words(a, mask)):
        assert (dense([tuple(r) for r in restricted.df.select("i", "j", "v").collect()], (90, 200)) == keep).all()
    square = SparseMatrix(a.df.where("j < 90"), 90, 90)
    region = list(range(3, 80, 5))
    local, order = masks.restrict_local(square, masks.mask_of(spark, 90, region))
    assert (dense([tuple(r) for r in local.df.collect()], (len(region),) * 2) == m[np.ix_(region, region)]).all()
    back = masks.scatter(masks.gather(vector(spark, range(90)), order), order)
    assert sorted((r.i, r.v) for r in back.collect()) == [(k, float(k)) for k in region]
    with pytest.raises(InvalidArgument):
        masks.mask_of(spark, 3, [3])
    assert masks.intersects(mask, masks.mask_of(spark, 200, [63])) and not masks.contains(mask, 1)


def test_words_keep_zeros_as_structure_and_tiles_drop_them(spark, ragged):
    a, rows = ragged
    t = topology.words(a.pattern())
    assert topology.stats(t).first().nnz == len({(i, j) for i, j, _ in rows})
    assert sorted(topology.entries(t).collect()) == sorted({(i, j) for i, j, _ in rows})
    kept = {(r.i, r.j) for r in topology.untile(topology.tiles(a)).collect()}
    m = dense(rows, (90, 200))
    assert kept == {(int(i), int(j)) for i, j in np.argwhere(m != 0)}
    assert topology.untile(topology.tiles(a, drop_zeros=False)).count() == topology.stats(t).first().nnz
    assert topology.contains(t, 3, 63) and not topology.contains(t, 17, 0)
    assert topology.violations(t, 90, 200).count() == 0 and topology.violations(t, 90, 150).count() > 0


def test_boolean_algebra(spark, ragged):
    a, _ = ragged
    p, q = topology.words(a.pattern().where("j % 2 = 1")), topology.words(a.pattern().where("j % 3 = 0"))
    get = lambda t: {(r.i, r.w, r.mask) for r in t.collect()}
    assert get(topology.xor(p, q)) == get(topology.union(topology.and_not(p, q), topology.and_not(q, p)))
    assert get(topology.and_not(topology.union(p, q), q)) == get(topology.and_not(p, topology.intersection(p, q)))
    assert get(topology.combine(p, q, lambda x, y: x.bitwiseOR(y))) == get(topology.union(p, q))
    assert get(topology.transpose(topology.transpose(p))) == get(p)
    assert get(topology.xor(p, p)) == set()


def test_rank_and_select_are_inverse(spark, ragged):
    a, rows = ragged
    seen = {}
    for r in topology.rank_select(topology.words(a.pattern())).collect():
        seen.setdefault(r.i, {})[r["rank"]] = r.j
    assert all([own[k] for k in range(len(own))] == sorted({j for i, j, _ in rows if i == row}) for row, own in seen.items())


def test_trailing_zeros(spark):
    words = [1, 6, -(1 << 63), 0, -8, 1 << 62]
    got = spark.createDataFrame([(w,) for w in words], "m bigint").select(trailing_zeros(F.col("m"))).collect()
    assert [r[0] for r in got] == [0, 1, 63, 64, 3, 62]


def test_validation_and_diagonal(spark):
    with pytest.raises(InvalidMatrix):
        matrix(spark, [(0, 2, 1.0)], 2, 2).validate()
    with pytest.raises(InvalidMatrix):
        matrix(spark, [(0, 0, float("inf"))], 2, 2).validate()
    lost = matrix(spark, [(0, 1, 1.0), (1, 1, 2.0)], 2, 2)
    with pytest.raises(MissingDiagonal):
        profile.need_diagonal(lost)
    signed = matrix(spark, [(0, 0, -1.0), (1, 1, 1.5), (1, 1, 0.5)], 2, 2)
    assert {r.i: r.v for r in profile.need_diagonal(signed).collect()} == {0: -1.0, 1: 2.0}
    with pytest.raises(MissingDiagonal):
        profile.need_diagonal(signed, positive=True)


def test_bit_exactness_sees_the_sign_of_zero(spark):
    a, b = matrix(spark, [(0, 0, 0.0)], 1, 1), matrix(spark, [(0, 0, -0.0)], 1, 1)
    assert not profile.bit_exact(a, b) and profile.bit_exact(a, a)


def test_empty_matrix(spark):
    a = matrix(spark, [], 3, 3)
    assert [r.v for r in algebra.spmv(a, vector(spark, [1, 2, 3])).collect()] == [0.0] * 3
    one = profile.profile(a).first()
    assert one.nnz == 0 and not one.full_diagonal and one.max_row_nnz == 0
    assert topology.words(a.pattern()).count() == 0 and profile.bandwidth(a).first()[0] == 0
    assert masks.risk_mask(a).count() == 0 and masks.residual_seeds(vector(spark, [0, 0])).count() == 0


def test_growth_follows_edges_both_ways(spark):
    directed = matrix(spark, [(0, 1, 1.0), (1, 2, 1.0), (3, 2, 1.0), (4, 4, 1.0)], 5, 5)
    pairs = graph.edges(directed)
    grow = lambda seeds, hops: {r.i: r.level for r in graph.grow(pairs, masks.mask_of(spark, 5, seeds), hops).collect()}
    assert grow([1], 1) == {1: 0, 0: 1, 2: 1} and grow([1], 9) == {1: 0, 0: 1, 2: 1, 3: 2} and grow([4], 3) == {4: 0} and grow([0], 0) == {0: 0}
    assert {r.i for r in topology.expand_mask(topology.words(directed.pattern()), masks.mask_of(spark, 5, [1])).collect()} == {1, 2}
    stats = {r.level: (r.nodes, r.visited_edges) for r in graph.growth_stats(pairs, graph.grow(pairs, masks.mask_of(spark, 5, [1]), 1)).collect()}
    assert stats == {0: (1, 2), 1: (2, 3)}


def test_mixed_layout(spark):
    """Displacements, rotations, a temperature and multipliers on a few entities."""
    sizes, fields = [3, 3, 3, 3, 3, 1, 2], [0, 1, 0, 1, 0, 2, 3]
    blocks = spark.createDataFrame([(k, s, f) for k, (s, f) in enumerate(zip(sizes, fields, strict=True))], "block_index bigint, components bigint, field_id int")
    lay = layout.offsets(blocks, group=2)
    assert [(r.start, r.end) for r in lay.orderBy("block_index").collect()] == [(0, 3), (3, 6), (6, 9), (9, 12), (12, 15), (15, 16), (16, 18)]
    assert sorted(r.i for r in layout.field_mask(lay, 0).collect()) == [0, 1, 2, 6, 7, 8, 12, 13, 14]
    found = {r.i: (r.block_index, r.component) for r in layout.locate(lay, spark.range(20).select(F.col("id").alias("i")), step=4).collect()}
    assert found[0] == (0, 0) and found[15] == (5, 0) and found[17] == (6, 1) and len(found) == 18
    assert sorted(r.i for r in layout.close_to_blocks(lay, masks.mask_of(spark, 18, [4, 15])).collect()) == [3, 4, 5, 15]
    owners = spark.createDataFrame([(k, 0 if k < 7 else 1) for k in range(18)], "i bigint, owner int")
    assert [r.block_index for r in layout.split_blocks(lay, owners).collect()] == [2]
    line = matrix(spark, [(5, 6, 1.0)], 18, 18)
    assert sorted(r.i for r in graph.grow_fields(graph.edges(line), lay, masks.mask_of(spark, 18, [4]), 1).collect()) == [3, 4, 5, 6, 7, 8]


def test_components_on_long_chains_and_noise(spark):
    rng = np.random.default_rng(5)
    order = rng.permutation(700)
    pairs = [(int(order[k]), int(order[k + 1])) for k in range(499)] + [(int(a), int(b)) for a, b in zip(order[500:650], order[550:700], strict=True)] + [(None, 3), (999, 999)]
    parent = {k: k for k in [*range(700), 999]}

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in pairs:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    assert got == {k: root(k) for k in got} and len(got) >= 650
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_halos(spark):
    for a in (chain(spark, 12, 3.5), grid7(spark, 3, 3, 2), matrix(spark, [(0, 5, 1.0), (5, 5, 1.0), (2, 2, 3.0)], 6, 6)):
        for owners in (partition.owners_of(spark, partition.balanced(a.nrows, 3)), a.rows().select("i", (F.col("i") % 3).cast("int").alias("owner"))):
            plan = partition.halo(a, owners)
            assert partition.halo_violations(plan, owners).count() == 0
            assert sorted(plan.collect()) == sorted(partition.halo_from_words(topology.words(a.pattern()), owners).collect())
            x = a.rows().select("i", (F.col("i") * 3 + 1).cast("double").alias("v"))
            assert sorted(partition.distributed_spmv(a, owners, x).collect()) == sorted(algebra.spmv(a, x).collect())
            assert partition.exchange(x, plan).count() == plan.count()
            t = partition.telemetry(a, owners).first()
            assert t.ghosts <= t.cut_nnz and t.ghosts == plan.count()
    chained = partition.telemetry(chain(spark, 12), partition.owners_of(spark, partition.balanced(12, 3))).first()
    assert (chained.cut_nnz, chained.ghosts, chained.max_peers) == (4, 4, 2)


def test_partition_arithmetic(spark):
    assert partition.balanced(10, 4) == [(0, 0, 3), (1, 3, 6), (2, 6, 8), (3, 8, 10)]
    got = {r.i: r.owner for r in spark.range(10).select(F.col("id").alias("i"), partition.owner_balanced(F.col("id"), 10, 4).alias("owner")).collect()}
    assert got == {r.i: r.owner for r in partition.owners_of(spark, partition.balanced(10, 4)).collect()}
    assert partition.from_offsets([0, 2, 5]) == [(0, 0, 2), (1, 2, 5)]
    for bad in ([0], [1, 2], [0, 2, 2]):
        with pytest.raises(InvalidArgument):
            partition.from_offsets(bad)


def test_regions(spark):
    regions = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 1), (2, 3), (2, 4), (2, 5)], "region bigint, i bigint")
    assert sorted((r.region, r.members) for r in graph.merge_unique(regions).collect()) == [(0, [1, 2]), (2, [3, 4, 5])]
    s = graph.multiplicity_stats(regions).first()
    assert (s.covered, s.overlap_pairs, s.max_multiplicity, s.overlap_fraction) == (5, 2, 2, 0.4)
    r = vector(spark, [0, 5, -9, 1, 1, -2])
    capped = graph.cap_regions(regions.where("region = 2 and i = 3"), regions.where("region = 2"), r, 2)
    assert sorted(x.i for x in capped.collect()) == [3, 5]


def test_affinity_forms_agree(spark):
    pairs = graph.edges(grid7(spark, 4, 3, 2)).union(spark.createDataFrame([(0, 5), (5, 0), (0, 17), (17, 0)], "i bigint, j bigint")).distinct()
    assert sorted(graph.affinity(pairs).collect()) == sorted(graph.affinity_bitmaps(pairs).collect())


def test_stream_accumulates(spark, tmp_path):
    from lattix.streaming import accumulate, entry_stream

    chain(spark, 5).df.write.parquet(str(tmp_path / "in"))
    for more in (None, [(0, 0, 1.0), (4, 1, 2.0)]):
        if more:
            spark.createDataFrame(more, "i bigint, j bigint, v double").write.mode("append").parquet(str(tmp_path / "in"))
        q = accumulate(entry_stream(spark, str(tmp_path / "in")), f"sums{bool(more)}", str(tmp_path / f"cp{bool(more)}"))
        q.awaitTermination()
    got = {(r.i, r.j): r.v for r in spark.table("sumsTrue").collect()}
    assert got[0, 0] == 3.0 and got[4, 1] == 2.0 and len(got) == 14


@pytest.mark.parametrize("bitmaps", [False, True])
def test_affinity_stores_no_wedges(spark, monkeypatch, bitmaps):
    """Rows go round in slabs, of which none holds all; what is stored are rows and scores."""
    stored = []
    monkeypatch.setattr(graph, "SLAB_BYTES", 200)
    monkeypatch.setattr(graph, "materialize", lambda df, name: stored.append((name, out := materialize(df, name), out.count())) or out)
    near = {(i, j) for i in range(40) for j in range(40) if i != j and (i * j + i + j) % 3 == 0 or i * j == 0 and i != j}
    got = graph.affinity(spark.createDataFrame(sorted(near), "i bigint, j bigint"), bitmaps).collect()
    expected = {(i, j): sum((i, k) in near and (j, k) in near for k in range(40)) for i, j in near if i < j}
    assert {(r.a, r.b): r.common for r in got} == expected and len(got) == len(expected)
    scores = [count for name, _, count in stored if name == "affinity"]
    assert len(scores) > 1 and sum(scores) == len(expected) and {name for name, *_ in stored} == {"affinity-rows", "affinity"}


def test_affinity_of_ids_below_zero(spark):
    pairs = spark.createDataFrame([(i, j) for i in (-5, 2, 9) for j in (-5, 2, 9) if i != j], "i bigint, j bigint")
    assert sorted(tuple(r) for r in graph.affinity(pairs).collect()) == [(-5, 2, 1), (-5, 9, 1), (2, 9, 1)]


def test_bit_exactness_is_decided_slice_by_slice(spark, monkeypatch):
    """Both are exchanged in several parts, none of which holds all; a change in the last part is seen, and so is an entry twice."""
    from lattix.operators import meetings

    monkeypatch.setattr(profile, "SLICE_ENTRIES", 20)
    seen, whole = [], meetings.differing
    monkeypatch.setattr(meetings, "differing", lambda a, b, *rest: seen.append(a.count()) or whole(a, b, *rest))
    rows = [(i, j, -float(i - j)) for i in range(20) for j in range(20) if (i + j) % 3 == 0]
    schema = "i bigint, j bigint, v double"
    a = SparseMatrix(spark.createDataFrame(rows, schema), 20, 20)
    assert profile.bit_exact(a, SparseMatrix(spark.createDataFrame(rows[::-1], schema), 20, 20))
    assert len(seen) > 3 and sum(seen) == len(rows)
    for changed in ([*rows[:-1], (rows[-1][0], rows[-1][1], 7.0)], [*rows, rows[-1]], rows[:-1], [*rows[:-1], (*rows[-1][:2], None)]):
        assert not profile.bit_exact(a, SparseMatrix(spark.createDataFrame(changed, schema), 20, 20))


def test_words_of_blocks_are_those_of_the_pattern(spark):
    from lattix.solvers.backend import packed_rows

    pairs = spark.createDataFrame([(i, (i * 37 + k * k) % 200) for i in range(50) for k in range(9)], "i bigint, j bigint")
    made = topology.words_of_blocks(packed_rows(pairs, 50, 200, values=False), 200, 10, 40)
    assert sorted(made.collect()) == sorted(topology.words(pairs.where("i >= 10 and i < 40")).collect())
