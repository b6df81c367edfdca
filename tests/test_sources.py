import pytest
from pyspark.sql import functions as F

from lattix import sources as S
from lattix.operators import algebra, profile
from lattix.schema import DimensionMismatch, FormatError, InvalidMatrix, SparseMatrix, UnsupportedProblem
from lattix.sources.matrix_market import Admission


def entries(a):
    return sorted((r.i, r.j, r.v) for r in a.df.collect())


def put(tmp_path, name, text):
    f = tmp_path / name
    f.write_text(text)
    return str(f)


def test_symmetric_file_is_mirrored(spark, tmp_path):
    path = put(tmp_path, "s.mtx", "%%MatrixMarket matrix coordinate real symmetric\n% a comment\n3 3 5\n1 1 2\n2 1 -1\n2 2 2\n3 2 -1\n3 3 2\n")
    a, info = S.read_matrix_market(spark, path)
    assert len(entries(a)) == 7 and info.input_entries == 5 and info.symmetric
    y = algebra.spmv(a, spark.range(3).select(F.col("id").alias("i"), F.lit(1.0).alias("v")))
    assert [r.v for r in y.orderBy("i").collect()] == [1.0, 0.0, 1.0]


def test_duplicates_add_and_zeros_go(spark, tmp_path):
    path = put(tmp_path, "d.mtx", "%%MatrixMarket matrix coordinate integer general\n2 2 4\n1 1 1\n1 1 2\n2 2 4\n2 1 0\n")
    a, info = S.read_matrix_market(spark, path)
    assert entries(a) == [(0, 0, 3.0), (1, 1, 4.0)]
    assert (info.duplicates_combined, info.zeros_removed) == (1, 1)


def test_entries_that_look_like_the_size_line(spark, tmp_path):
    a, _ = S.read_matrix_market(spark, put(tmp_path, "x.mtx", "%%MatrixMarket matrix coordinate real general\n2 2 2\n2 2 2\n1 1 5\n"))
    assert entries(a) == [(0, 0, 5.0), (1, 1, 2.0)]


@pytest.mark.parametrize(
    "text",
    [
        "", "%%MatrixMarket matrix array real general\n1 1 1\n1 1 1\n", "%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 1\n", "%%MatrixMarket matrix coordinate real hermitian\n1 1 1\n1 1 1\n",
        "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n0 1 1\n",
        "%%MatrixMarket matrix coordinate real general\n2 2 1\n1 1 nan\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n1 1 x\n", "%%MatrixMarket matrix coordinate real symmetric\n2 3 1\n1 1 1\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n1 1 1 1\n",
    ],
)
def test_broken_files_are_refused(spark, tmp_path, text):
    with pytest.raises(FormatError):
        S.read_matrix_market(spark, put(tmp_path, "b.mtx", text))


@pytest.mark.parametrize("single", [True, False])
def test_round_trip_is_bit_exact(spark, tmp_path, single):
    a = SparseMatrix(S.chain(spark, 40).df.withColumn("v", F.col("v") / 3 + F.col("i") * 1e-7), 40, 40)
    S.write_matrix_market(a, str(tmp_path / "out"), single)
    back, _ = S.read_matrix_market(spark, str(tmp_path / "out"))
    assert profile.bit_exact(a, back)


def test_admission(spark, tmp_path):
    S.write_matrix_market(S.poisson_1d(spark, 6), str(tmp_path / "weak"))
    S.write_matrix_market(S.grid7(spark, 2, 2, 2), str(tmp_path / "strict"))
    with pytest.raises(UnsupportedProblem):
        S.read_spd(spark, str(tmp_path / "weak"))
    assert S.read_spd(spark, str(tmp_path / "weak"), Admission.EXPERIMENTAL).nrows == 6
    assert S.read_spd(spark, str(tmp_path / "strict"), ranks=2).df.count() == 32


def test_vectors_coordinates_and_labels(spark, tmp_path):
    path = put(tmp_path, "v.txt", "﻿# head\n1.5 2\n% more\n\n3e0\n")
    assert [(r.i, r.v) for r in S.read_vector(spark, path, 3).orderBy("i").collect()] == [(0, 1.5), (1, 2.0), (2, 3.0)]
    with pytest.raises(DimensionMismatch):
        S.read_vector(spark, path, 4)
    with pytest.raises(FormatError):
        S.read_vector(spark, put(tmp_path, "w.txt", "1 inf"), 2)
    cube = "8\n" + "\n".join(f"{x} {y} {z}" for z in (0, 1) for y in (0, 1) for x in (0, 1))
    got = S.read_coordinates(spark, put(tmp_path, "c.txt", cube)).orderBy("node").collect()
    assert len(got) == 8 and (got[5].x, got[5].y, got[5].z) == (1.0, 0.0, 1.0)
    with pytest.raises(FormatError):
        S.read_coordinates(spark, put(tmp_path, "c2.txt", "2\n0 0 0\n"))
    owners = spark.createDataFrame([(k, k % 3) for k in range(30)], "i bigint, owner int")
    S.write_labels(owners, str(tmp_path / "labels"))
    assert sorted(S.read_labels(spark, str(tmp_path / "labels"), 3, 30).collect()) == sorted(owners.collect())
    with pytest.raises(FormatError):
        S.read_labels(spark, str(tmp_path / "labels"), 2)


def test_lines_keep_the_order_of_part_files_of_any_size(spark, tmp_path):
    """Spark reads the longest split first; the numbers follow the files all the same, and a file's splits each other."""
    sizes = {"part-00000-a.txt": 3, "part-00001-a.txt": 900, "part-00002-a.txt": 40, "part-99999-a.txt": 5, "part-100000-a.txt": 2000}
    (tmp_path / "v").mkdir()
    at = 0
    for name, n in sizes.items():
        put(tmp_path / "v", name, "".join(f"{k}\n" for k in range(at, at + n)))
        at += n
    put(tmp_path, "one.txt", "".join(f"{k}\n" for k in range(at)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for most in (before, "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        for name in ("v", "one.txt"):
            assert [(r.i, r.v) for r in S.read_vector(spark, str(tmp_path / name), at).orderBy("i").collect()] == [(k, float(k)) for k in range(at)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_graph_and_owned_rows(spark, tmp_path):
    from lattix.operators.graph import edges

    a = S.chain(spark, 4)
    S.write_graph(edges(a), 4, str(tmp_path / "graph"))
    assert [r.value for r in spark.read.text(str(tmp_path / "graph")).collect()] == ["4 3", "2", "1 3", "2 4", "3"]
    S.write_owned_rows(a, spark.createDataFrame([(k, k // 2) for k in range(4)], "i bigint, owner int"), str(tmp_path / "owned"))
    assert S.read_owned_rows(spark, str(tmp_path / "owned"), 1).count() == 5


def test_csr_is_checked(spark):
    a = S.csr_to_matrix(spark, 2, 2, [1, 3, 4], [2, 1, 2], [5, 6, 7], base=1)
    assert entries(a) == [(0, 0, 6.0), (0, 1, 5.0), (1, 1, 7.0)]
    for bad in (([0, 1], [0], [1.0]), ([0, 2, 1], [0], [1.0]), ([0, 1, 1], [7], [1.0]), ([0, 1, 1], [0], [float("nan")])):
        with pytest.raises(InvalidMatrix):
            S.csr_to_matrix(spark, 2, 2, *bad)


def test_generators(spark):
    assert profile.spd_certificate(S.grid7(spark, 3, 2, 2)).first().certified
    sur = S.spd_surrogate(SparseMatrix(spark.createDataFrame([(0, 1, 9.0), (2, 0, 1.0), (3, 3, 1.0)], "i bigint, j bigint, v double"), 4, 4))
    assert profile.spd_certificate(sur).first().certified and entries(sur)[-1] == (3, 3, 1.0)
    assert S.block_diagonal(spark, 3, [4, 2], 1).nrows == 10
