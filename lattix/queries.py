"""Registry of the engine's queries and their DuckDB oracles.

All matrices come from the star-schema tables (:mod:`lattix.datasets`); their values are whole
numbers, so sums are exact on every engine, and quotients are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix import datasets as D
from lattix.operators import algebra, graph, layout, masks, partition, profile, topology
from lattix.operators.components import connected_components
from lattix.schema import SparseMatrix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Shared SQL: ``a`` is the part graph, ``x`` the probe vector, ``own`` four balanced owners of parts.
PARTS = """
np AS (SELECT max(p_partkey) + 1 AS n FROM part),
op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
offd AS (SELECT s.p AS i, t.p AS j, CAST(-count(*) AS DOUBLE) AS v FROM op s JOIN op t ON s.o = t.o AND s.p <> t.p GROUP BY 1, 2),
node AS (SELECT unnest(range(n)) AS i FROM np),
a AS (SELECT i, j, v FROM offd UNION ALL SELECT node.i, node.i, 1 + coalesce(s, 0) FROM node LEFT JOIN (SELECT i, -sum(v) AS s FROM offd GROUP BY i) q ON q.i = node.i),
x AS (SELECT i, CAST(1 + (i * 17 + 11) % 101 AS DOUBLE) AS v FROM node)
"""
OWN = """
own AS (SELECT i, CAST(CASE WHEN i < (n % 4) * (n // 4 + 1) THEN i // (n // 4 + 1) ELSE n % 4 + (i - (n % 4) * (n // 4 + 1)) // (n // 4) END AS INTEGER) AS owner FROM node, np),
placed AS (SELECT a.*, r.owner AS oi, c.owner AS oj FROM a JOIN own r ON r.i = a.i JOIN own c ON c.i = a.j)
"""
WORDS = "CAST(sum(CASE WHEN j % 64 < 32 THEN 1::BIGINT << (j % 64)::INT ELSE 0 END) AS BIGINT) AS lo, CAST(sum(CASE WHEN j % 64 >= 32 THEN 1::BIGINT << (j % 64 - 32)::INT ELSE 0 END) AS BIGINT) AS hi"


def query(sql: str | None = None, parts: bool = True):
    """Register a query; ``sql`` follows the shared tables if ``parts``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {PARTS}{'' if sql.lstrip().upper().startswith('SELECT') else ','} {sql}" if parts else sql
        return f

    return add


def _x(a: SparseMatrix) -> DataFrame:
    return D.probe(a.spark, a.ncols)


def _owners(a: SparseMatrix, ranks: int = 4) -> DataFrame:
    return a.rows().select("i", partition.owner_balanced(F.col("i"), a.nrows, ranks).alias("owner"))


def _halves(t: DataFrame) -> DataFrame:
    """Words as two unsigned 32-bit halves, since their sign is no value."""
    return t.select("i", "w", F.col("mask").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"), F.shiftrightunsigned("mask", 32).alias("hi"))


def _two(a: SparseMatrix) -> tuple[DataFrame, DataFrame]:
    return topology.words(a.pattern().where("(i + j) % 2 = 0")), topology.words(a.pattern().where("(i * j) % 3 = 0"))


# --- matrices and vectors -------------------------------------------------------------------------


@query("SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0", parts=False)
def mat_canonical(spark, d):
    return D.order_part(spark, d).canonical().df


@query("""SELECT (SELECT n FROM np) AS nrows, (SELECT n FROM np) AS ncols, CAST(sum(c) AS BIGINT) AS nnz, true AS square, bool_and(dn > 0) AS full_diagonal, bool_and(dn > 0 AND dv > 0) AS positive_diagonal,
  round(avg(c), 6) AS avg_row_nnz, max(c) AS max_row_nnz FROM (SELECT i, count(*) AS c, count(*) FILTER (i = j) AS dn, sum(v) FILTER (i = j) AS dv FROM a GROUP BY i)""")
def mat_profile(spark, d):
    return profile.profile(D.part_graph(spark, d)).withColumn("avg_row_nnz", F.round("avg_row_nnz", 6))


@query("SELECT i, sum(v) AS v FROM a WHERE i = j GROUP BY i")
def mat_diagonal(spark, d):
    return profile.diagonal(D.part_graph(spark, d))


@query("SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i")
def spmv(spark, d):
    a = D.part_graph(spark, d)
    return algebra.spmv(a, _x(a))


@query("""SELECT r.i, coalesce(s.v, 0) AS v FROM (SELECT unnest(range(max(o_orderkey) + 1)) AS i FROM orders) r
  LEFT JOIN (SELECT l_orderkey AS i, sum(l_quantity * (1 + (l_partkey * 17 + 11) % 101)) AS v FROM lineitem GROUP BY 1) s ON s.i = r.i""", parts=False)
def spmv_rect(spark, d):
    a = D.order_part(spark, d)
    return algebra.spmv(a, _x(a))


@query("""SELECT node.i, coalesce(s.v, 0) AS v FROM node LEFT JOIN (SELECT l_partkey AS i, sum(l_quantity * (1 + (l_orderkey * 17 + 11) % 101)) AS v FROM lineitem GROUP BY 1) s ON s.i = node.i""")
def spmv_transposed(spark, d):
    a = D.order_part(spark, d)
    return algebra.spmv_transposed(a, D.probe(spark, a.nrows))


@query(ORACLES["spmv"].split("WITH RECURSIVE " + PARTS)[1])
def spmv_partitioned(spark, d):
    a = D.part_graph(spark, d)
    return algebra.spmv_partitioned(a, _x(a), 8)


@query(ORACLES["spmv"].split("WITH RECURSIVE " + PARTS)[1])
def spmv_by_owner(spark, d):
    a = D.part_graph(spark, d)
    return algebra.spmv_by_owner(a, a.rows().select("i", (F.col("i") * 7 % 5).alias("owner")), _x(a))


@query("""WITH m AS (SELECT l_partkey AS p, l_suppkey AS s, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)
  SELECT l.s AS i, r.s AS j, sum(l.v * r.v) AS v FROM m l JOIN m r ON l.p = r.p GROUP BY 1, 2""", parts=False)
def spgemm_common_parts(spark, d):
    a = D.part_supp(spark, d)
    return algebra.spgemm(algebra.transpose(a), a).df


@query("SELECT l_partkey AS i, l_orderkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2", parts=False)
def transpose(spark, d):
    return algebra.transpose(D.order_part(spark, d).canonical()).df


@query("SELECT (SELECT n FROM np) - 1 - i AS i, (SELECT n FROM np) - 1 - j AS j, v FROM a")
def permute(spark, d):
    a = D.part_graph(spark, d)
    return algebra.permute(a, a.rows().select(F.col("i").alias("old"), (F.lit(a.nrows - 1) - F.col("i")).alias("new"))).df


@query("SELECT sum(abs(v)) AS l1, round(sqrt(sum(v * v)), 6) AS l2, max(abs(v)) AS linf FROM x")
def vec_norms(spark, d):
    a = D.part_graph(spark, d)
    return algebra.norms(_x(a)).withColumn("l2", F.round("l2", 6))


@query("SELECT sum(x.v * y.v) AS dot FROM x JOIN (SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i) y ON x.i = y.i")
def vec_dot(spark, d):
    a = D.part_graph(spark, d)
    return algebra.dot(_x(a), algebra.spmv(a, _x(a)))


@query("SELECT i, 3 * v + 1 AS v FROM x")
def vec_axpy(spark, d):
    a = D.part_graph(spark, d)
    return algebra.axpy(3.0, _x(a), D.ones(spark, a.nrows))


@query("SELECT a.i, 1000 - sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i")
def residual(spark, d):
    a = D.part_graph(spark, d)
    return algebra.residual(a, _x(a), D.ones(spark, a.nrows).withColumn("v", F.lit(1000.0)))


@query("""SELECT round(sqrt(sum((1000 - y.v) * (1000 - y.v))) / sqrt(sum(1e6)), 8) AS relative_residual FROM (SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i) y""")
def relative_residual(spark, d):
    a = D.part_graph(spark, d)
    return algebra.relative_residual(a, _x(a), D.ones(spark, a.nrows).withColumn("v", F.lit(1000.0))).select(F.round("relative_residual", 8).alias("relative_residual"))


@query("SELECT x.i, x.v / a.v AS v FROM x JOIN a ON a.i = x.i AND a.j = x.i")
def jacobi_apply(spark, d):
    from lattix.solvers.precond import Jacobi

    a = D.part_graph(spark, d)
    return Jacobi.from_matrix(a).apply(_x(a))


@query("SELECT i // 50 AS i, j // 50 AS j, sum(v) AS v FROM a GROUP BY 1, 2")
def galerkin_coarse(spark, d):
    a = D.part_graph(spark, d)
    return algebra.galerkin_piecewise(a, a.rows().withColumn("c", F.floor(F.col("i") / 50)), -(-a.nrows // 50)).df


@query("""p AS (SELECT i, i // 50 AS c, CAST(1 + i % 3 AS DOUBLE) AS v FROM node UNION ALL SELECT i, (i // 50 + 1) % ((n + 49) // 50), 1 FROM node, np WHERE i % 5 = 0)
  SELECT l.c AS i, r.c AS j, sum(l.v * a.v * r.v) AS v FROM a JOIN p l ON l.i = a.i JOIN p r ON r.i = a.j GROUP BY 1, 2""")
def galerkin_transfer(spark, d):
    a = D.part_graph(spark, d)
    return algebra.galerkin(a, _transfer(a)).df


def _transfer(a: SparseMatrix) -> SparseMatrix:
    """A sparse transfer with weights 1 to 3 and a second aggregate for each fifth row."""
    count = -(-a.nrows // 50)
    own = a.rows().select("i", F.floor(F.col("i") / 50).alias("j"), (1 + F.col("i") % 3).cast("double").alias("v"))
    more = a.rows().where("i % 5 = 0").select("i", ((F.floor(F.col("i") / 50) + 1) % count).alias("j"), F.lit(1.0).alias("v"))
    return SparseMatrix(own.union(more), a.nrows, count)


@query("""p AS (SELECT i, i // 50 AS c, CAST(1 + i % 3 AS DOUBLE) AS v FROM node UNION ALL SELECT i, (i // 50 + 1) % ((n + 49) // 50), 1 FROM node, np WHERE i % 5 = 0),
  c AS (SELECT p.c, sum(p.v * x.v) AS v FROM p JOIN x ON x.i = p.i GROUP BY 1) SELECT p.i, sum(p.v * c.v) AS v FROM p JOIN c ON c.c = p.c GROUP BY 1""")
def restrict_prolong(spark, d):
    a = D.part_graph(spark, d)
    return algebra.prolong(_transfer(a), algebra.restrict(_transfer(a), _x(a)))


# --- masks and restriction ------------------------------------------------------------------------


@query("SELECT i, j, v FROM a WHERE j % 3 = 0")
def col_restrict(spark, d):
    a = D.part_graph(spark, d)
    return masks.restrict_columns(a, a.rows().where("i % 3 = 0")).df


@query("SELECT i, j, v FROM a WHERE j % 3 = 0")
def col_restrict_words(spark, d):
    a = D.part_graph(spark, d)
    return masks.restrict_words(a, a.rows().where("i % 3 = 0")).df


@query("SELECT i // 7 AS i, j // 7 AS j, v FROM a WHERE i % 7 = 0 AND j % 7 = 0")
def local_restrict(spark, d):
    a = D.part_graph(spark, d)
    return masks.restrict_local(a, a.rows().where("i % 7 = 0"))[0].df


@query("SELECT i // 7 AS i, v FROM x WHERE i % 7 = 0")
def local_gather(spark, d):
    a = D.part_graph(spark, d)
    return masks.gather(_x(a), masks.renumber(a.rows().where("i % 7 = 0")))


@query("SELECT i // 7 AS i, j // 7 AS j, 2 * v AS v FROM a WHERE i % 7 = 0 AND j % 7 = 0")
def local_refresh(spark, d):
    a = D.part_graph(spark, d)
    plan = masks.local_plan(a, a.rows().where("i % 7 = 0"))
    return masks.refresh(plan, SparseMatrix(a.df.withColumn("v", F.col("v") * 2), a.nrows, a.ncols))


@query("""dg AS (SELECT i, abs(v) AS d FROM a WHERE i = j AND v <> 0),
  s AS (SELECT a.i, sum(abs(a.v)) / any_value(r.d) AS c, max(greatest(r.d / c.d, c.d / r.d)) AS jump FROM a JOIN dg r ON r.i = a.i LEFT JOIN dg c ON c.i = a.j WHERE a.i <> a.j GROUP BY a.i)
  SELECT i FROM s WHERE c >= 0.995 OR jump >= 3""")
def risk_mask(spark, d):
    return masks.risk_mask(D.part_graph(spark, d), 0.995, 3.0)


@query("""y AS (SELECT a.i, 1000 - sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i) SELECT i FROM y WHERE abs(v) >= 0.25 * (SELECT max(abs(v)) FROM y)""")
def residual_seeds(spark, d):
    return masks.residual_seeds(residual(spark, d))


@query()
def core_regions(spark, d):
    """Connected chunks of risky parts around the strongest residuals; sequential claims have no SQL, a test holds them to brute force."""
    from lattix.solvers.options import HybridOptions
    from lattix.solvers.regions import core_regions as f

    return f(D.part_graph(spark, d), risk_mask(spark, d), residual_seeds(spark, d), residual(spark, d), HybridOptions())


@query("""SELECT a.i, coalesce(sum(a.v * x.v) FILTER (a.j % 4 = 0), 0) AS v, count(*) AS candidates, count(*) FILTER (a.j % 4 = 0) AS executed, count(*) FILTER (a.j % 4 <> 0) AS skipped FROM a JOIN x ON x.i = a.j GROUP BY a.i""")
def pruned_dot(spark, d):
    a = D.part_graph(spark, d)
    return masks.pruned_dot(a, a.rows().where("i % 4 = 0"), _x(a))


@query("SELECT count(*) AS candidates, count(*) FILTER (j % 4 = 0) AS executed, count(*) FILTER (j % 4 <> 0) AS skipped, round(count(*) FILTER (j % 4 <> 0) / count(*), 9) AS pruning_ratio FROM a")
def pruning_stats(spark, d):
    return masks.pruning_stats(pruned_dot(spark, d)).withColumn("pruning_ratio", F.round("pruning_ratio", 9))


@query("SELECT i FROM node WHERE (i % 2 = 0 OR i % 3 = 0) AND NOT i % 5 = 0 AND i % 7 <> 0")
def mask_algebra(spark, d):
    r = D.part_graph(spark, d).rows()
    both = masks.union(r.where("i % 2 = 0"), r.where("i % 3 = 0"))
    return masks.intersection(masks.difference(both, r.where("i % 5 = 0")), r.where("i % 7 <> 0"))


# --- words and tiles ------------------------------------------------------------------------------


@query(f"SELECT i, j // 64 AS w, {WORDS} FROM a GROUP BY 1, 2")
def bitmap_words(spark, d):
    return _halves(topology.words(D.part_graph(spark, d).pattern()))


@query("SELECT count(*) AS nnz, count(DISTINCT (i, j // 64)) AS words, round(count(*) / (count(DISTINCT (i, j // 64)) * 64), 9) AS fill_ratio, round(count(DISTINCT (i, j // 64)) * 12 / count(*), 9) AS bytes_per_nnz FROM a")
def bitmap_stats(spark, d):
    return topology.stats(topology.words(D.part_graph(spark, d).pattern())).withColumns({c: F.round(c, 9) for c in ("fill_ratio", "bytes_per_nnz")})




def _register(name: str, f, where: str):
    QUERIES[name] = f
    ORACLES[name] = f"WITH RECURSIVE {PARTS} SELECT i, j // 64 AS w, {WORDS} FROM a WHERE {where} GROUP BY 1, 2"


_EVEN, _THIRD = "(i + j) % 2 = 0", "(i * j) % 3 = 0"
_register("bitmap_and", lambda spark, d: _halves(topology.intersection(*_two(D.part_graph(spark, d)))), f"{_EVEN} AND {_THIRD}")
_register("bitmap_or", lambda spark, d: _halves(topology.union(*_two(D.part_graph(spark, d)))), f"({_EVEN} OR {_THIRD})")
_register("bitmap_andnot", lambda spark, d: _halves(topology.and_not(*_two(D.part_graph(spark, d)))), f"{_EVEN} AND NOT {_THIRD}")
_register("bitmap_xor", lambda spark, d: _halves(topology.xor(*_two(D.part_graph(spark, d)))), f"({_EVEN}) <> ({_THIRD})")
_register("bitmap_combine", lambda spark, d: _halves(topology.combine(*_two(D.part_graph(spark, d)), lambda p, q: p.bitwiseAND(F.bitwise_not(q)))), f"{_EVEN} AND NOT {_THIRD}")


@query("SELECT l_orderkey AS i, l_partkey AS j, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS rank FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)", parts=False)
def rank_select(spark, d):
    return topology.rank_select(topology.words(D.order_part(spark, d).pattern()))


@query("SELECT l_orderkey AS i, min(l_partkey) AS j FROM lineitem GROUP BY 1", parts=False)
def first_of_row(spark, d):
    return topology.first_of_row(topology.words(D.order_part(spark, d).pattern()))


@query("SELECT DISTINCT l_partkey AS i, l_orderkey AS j FROM lineitem", parts=False)
def bitmap_transpose(spark, d):
    return topology.entries(topology.transpose(topology.words(D.order_part(spark, d).pattern())))


@query("SELECT DISTINCT i FROM (SELECT j AS i FROM a WHERE i % 500 = 3 UNION ALL SELECT i FROM node WHERE i % 500 = 3)")
def expand_mask(spark, d):
    a = D.part_graph(spark, d)
    return topology.expand_mask(topology.words(a.pattern()), a.rows().where("i % 500 = 3"))


@query("""SELECT s.l_suppkey AS ia, t.l_suppkey AS ib, count(*) AS common FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) s JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) t USING (l_partkey) GROUP BY 1, 2""", parts=False)
def row_intersections(spark, d):
    t = topology.words(algebra.transpose(D.part_supp(spark, d)).pattern())
    return topology.row_intersections(t, t)


@query("SELECT i, j // 64 AS w, CAST(count(*) AS INTEGER) AS n, sum(v) AS total, CASE WHEN count(*) <= 8 THEN 'sparse' WHEN count(*) >= 40 THEN 'dense' ELSE 'bitmap' END AS kind FROM a GROUP BY 1, 2")
def tiles(spark, d):
    t = topology.tiles(D.part_graph(spark, d))
    return t.select("i", "w", F.size("vals").alias("n"), F.aggregate("vals", F.lit(0.0), lambda s, v: s + v).alias("total"), topology.tile_kind(F.col("mask")).alias("kind"))


@query("SELECT kind, count(*) AS tiles, CAST(sum(n) AS BIGINT) AS nnz FROM (SELECT count(*) AS n, CASE WHEN count(*) <= 8 THEN 'sparse' WHEN count(*) >= 40 THEN 'dense' ELSE 'bitmap' END AS kind FROM a GROUP BY i, j // 64) GROUP BY kind")
def tile_stats(spark, d):
    return topology.tile_stats(topology.tiles(D.part_graph(spark, d)))


@query("SELECT i, j, v FROM a")
def untile(spark, d):
    return topology.untile(topology.tiles(D.part_graph(spark, d)))


@query(ORACLES["spmv"].split("WITH RECURSIVE " + PARTS)[1])
def tiled_spmv(spark, d):
    a = D.part_graph(spark, d)
    return topology.tiled_spmv(topology.tiles(a), _x(a))


@query(ORACLES["spmv"].split("WITH RECURSIVE " + PARTS)[1])
def block_spmv(spark, d):
    a = D.part_graph(spark, d)
    return topology.block_spmv(topology.dense_blocks(a, 6), _x(a), 6, a.nrows)


@query("SELECT count(*) AS blocks, round(sum(n) / (count(*) * 9), 9) AS fill, round(count(*) * 9 / sum(n), 9) AS padding_ratio, round(avg(CASE WHEN n = 9 THEN 1.0::DOUBLE ELSE 0 END), 9) AS full_share FROM (SELECT count(*) AS n FROM a GROUP BY i // 3, j // 3)")
def block_stats(spark, d):
    return topology.block_stats(D.part_graph(spark, d), 3).withColumns({c: F.round(c, 9) for c in ("fill", "padding_ratio", "full_share")})


# --- diagnostics ----------------------------------------------------------------------------------


@query("""SELECT count(*) AS off_diagonal, count(*) FILTER (t.v IS NULL) AS missing_transpose, count(*) FILTER (abs(a.v - t.v) > 1e-12 * greatest(1, abs(a.v), abs(t.v))) AS asymmetric, coalesce(max(abs(a.v - t.v)), 0) AS max_difference
  FROM (SELECT i, j, CASE WHEN j > i THEN v / 2 ELSE v END AS v FROM a WHERE i <> j AND NOT (i % 10 = 0 AND j > i)) a LEFT JOIN (SELECT i, j, CASE WHEN j > i THEN v / 2 ELSE v END AS v FROM a WHERE i <> j AND NOT (i % 10 = 0 AND j > i)) t ON t.i = a.j AND t.j = a.i""")
def symmetry_check(spark, d):
    a = D.convection(spark, d)
    return profile.symmetry(SparseMatrix(a.df.where("not (i % 10 = 0 and j > i)"), a.nrows, a.ncols))


@query("""SELECT count(*) FILTER (NOT d > o) AS rows_not_dominant, CAST(0 AS BIGINT) AS missing_transpose, CAST(0 AS BIGINT) AS asymmetric, count(*) FILTER (NOT d > o) = 0 AS certified FROM (SELECT sum(v) FILTER (i = j) AS d, coalesce(sum(abs(v)) FILTER (i <> j), 0) AS o FROM a GROUP BY i)""")
def spd_certificate(spark, d):
    return profile.spd_certificate(D.part_graph(spark, d))


@query("""SELECT i, sum(v) FILTER (i = j) AS diag, coalesce(sum(abs(v)) FILTER (i <> j), 0) AS "off", CASE WHEN abs(sum(v) FILTER (i = j)) > coalesce(sum(abs(v)) FILTER (i <> j), 0) THEN 'strict' ELSE 'none' END AS class
  FROM (SELECT i, j, CASE WHEN i = j AND i % 2 = 0 THEN v / 2 ELSE v END AS v FROM a) GROUP BY i""")
def dominance(spark, d):
    a = D.part_graph(spark, d)
    return profile.dominance(SparseMatrix(a.df.withColumn("v", F.when((F.col("i") == F.col("j")) & (F.col("i") % 2 == 0), F.col("v") / 2).otherwise(F.col("v"))), a.nrows, a.ncols))


@query("""SELECT quantile_cont(n, 0.5) AS row_nnz_p50, quantile_cont(n, 0.95) AS row_nnz_p95, CAST(sum(n * n) AS BIGINT) AS ilu_work, round(avg(CASE WHEN d > o THEN 1.0::DOUBLE ELSE 0 END), 9) AS dominant_share, round(sum(neg) / greatest(sum(neg + pos), 1), 9) AS negative_share, round(avg(1 - abs(s) / l1), 9) AS cancellation
  FROM (SELECT count(*) AS n, sum(CASE WHEN i = j THEN abs(v) ELSE 0 END) AS d, sum(CASE WHEN i <> j THEN abs(v) ELSE 0 END) AS o, sum(v) AS s, sum(abs(v)) AS l1, count(*) FILTER (i <> j AND v < 0) AS neg, count(*) FILTER (i <> j AND v > 0) AS pos FROM a GROUP BY i)""")
def matrix_signals(spark, d):
    return profile.signals(D.part_graph(spark, d)).withColumns({c: F.round(c, 9) for c in ("dominant_share", "negative_share", "cancellation")})


@query("SELECT max(abs(i - j)) AS bandwidth FROM a")
def bandwidth(spark, d):
    return profile.bandwidth(D.part_graph(spark, d))


@query("""b AS (SELECT i // 40 AS bi, j // 40 AS bj, sqrt(sum(v * v)) AS norm FROM a GROUP BY 1, 2)
  SELECT b.bi, b.bj, round(b.norm, 8) AS norm, round(b.norm / sqrt(r.norm * c.norm), 8) AS strength FROM b JOIN b r ON r.bi = b.bi AND r.bj = b.bi JOIN b c ON c.bi = b.bj AND c.bj = b.bj""")
def block_strength(spark, d):
    return profile.block_strength(D.part_graph(spark, d), 40).withColumns({"norm": F.round("norm", 8), "strength": F.round("strength", 8)})


@query("""c AS (SELECT p_partkey AS i, p_partkey // 25 AS g, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 97 AS DOUBLE) AS y, CAST(p_partkey % 53 AS DOUBLE) AS z FROM part),
  m AS (SELECT g, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM c GROUP BY g)
  SELECT c.g AS agg, count(*) AS nodes, round(any_value(cx), 6) AS cx, round(any_value(cy), 6) AS cy, round(any_value(cz), 6) AS cz, round(sqrt(avg((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))), 6) AS radius FROM c JOIN m USING (g) GROUP BY c.g""")
def centroids(spark, d):
    from lattix.solvers.coarse import centroids as f

    c = D.coordinates(spark, d)
    return f(c, c.select("node", F.floor(F.col("node") / 25).alias("agg"))).withColumns({k: F.round(k, 6) for k in ("cx", "cy", "cz", "radius")})


# --- layouts --------------------------------------------------------------------------------------

_LAYOUT = 'lay AS (SELECT l_orderkey AS block_index, count(*) AS components, CAST(l_orderkey % 3 AS INTEGER) AS field_id FROM lineitem GROUP BY 1), b AS (SELECT *, CAST(sum(components) OVER (ORDER BY block_index) - components AS BIGINT) AS "start", CAST(sum(components) OVER (ORDER BY block_index) AS BIGINT) AS "end" FROM lay)'


@query(f"WITH {_LAYOUT} SELECT * FROM b", parts=False)
def block_offsets(spark, d):
    return layout.offsets(D.order_layout(spark, d))


@query(f'WITH {_LAYOUT}, asked AS (SELECT unnest(range(0, (SELECT max("end") FROM b))) AS i) SELECT i, block_index, i - "start" AS component FROM asked JOIN b ON "start" <= i AND i < "end"', parts=False)
def locate_dof(spark, d):
    b = layout.offsets(D.order_layout(spark, d))
    return layout.locate(b, spark.range(0, b.agg(F.max("end")).first()[0]).select(F.col("id").alias("i")))


@query(f'WITH {_LAYOUT} SELECT unnest(range("start", "end")) AS i FROM b WHERE field_id = 1', parts=False)
def field_mask(spark, d):
    return layout.field_mask(layout.offsets(D.order_layout(spark, d)), 1)


@query(f'WITH {_LAYOUT}, asked AS (SELECT unnest(range(0, (SELECT max("end") FROM b))) AS i) SELECT DISTINCT unnest(range("start", "end")) AS i FROM b WHERE EXISTS (SELECT 1 FROM asked WHERE "start" <= i AND i < "end")', parts=False)
def field_closure(spark, d):
    b = layout.offsets(D.order_layout(spark, d))
    return layout.close_to_blocks(b, spark.range(0, b.agg(F.max("end")).first()[0]).select(F.col("id").alias("i")))


@query(f'WITH {_LAYOUT} SELECT block_index, CAST(2 AS BIGINT) AS owners FROM b WHERE "start" // 1000 <> ("end" - 1) // 1000', parts=False)
def split_blocks(spark, d):
    b = layout.offsets(D.order_layout(spark, d))
    return layout.split_blocks(b, spark.range(b.agg(F.max("end")).first()[0]).select(F.col("id").alias("i"), F.floor(F.col("id") / 1000).alias("owner")))


@query(f"""WITH {_LAYOUT}, t AS (SELECT r AS rank, CAST(round_even((SELECT max("end") FROM b) * r / 5, 0) AS BIGINT) AS target FROM range(1, 5) q(r)), e AS (SELECT "start" AS cut FROM b UNION SELECT "end" FROM b),
  n AS (SELECT rank, target, max(cut) FILTER (cut <= target) AS lo, min(cut) FILTER (cut > target) AS hi FROM t, e GROUP BY 1, 2)
  SELECT CAST(rank AS INTEGER) AS rank, target, CASE WHEN hi IS NULL OR target - lo <= hi - target THEN lo ELSE hi END AS cut FROM n""", parts=False)
def field_aligned_partition(spark, d):
    b = layout.offsets(D.order_layout(spark, d))
    return partition.field_aligned(b, b.agg(F.max("end")).first()[0], 5)


# --- graphs ---------------------------------------------------------------------------------------


@query("""h1 AS (SELECT DISTINCT j AS i FROM a WHERE i = 5 AND j <> 5), h2 AS (SELECT DISTINCT j AS i FROM a WHERE i IN (SELECT i FROM h1) AND j <> 5 AND j NOT IN (SELECT i FROM h1))
  SELECT CAST(0 AS BIGINT) AS region, CAST(5 AS BIGINT) AS i, 0 AS level UNION ALL SELECT 0, i, 1 FROM h1 UNION ALL SELECT 0, i, 2 FROM h2""")
def k_hop_region(spark, d):
    a = D.part_graph(spark, d)
    return graph.grow(graph.edges(a), a.rows().where("i = 5"), 2)


@query("""SELECT count(*) AS covered, CAST(sum(m * (m - 1) // 2) AS BIGINT) AS overlap_pairs, max(m) AS max_multiplicity, round(avg(CASE WHEN m > 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS overlap_fraction FROM (SELECT count(DISTINCT l_suppkey) AS m FROM lineitem GROUP BY l_partkey)""", parts=False)
def region_multiplicity(spark, d):
    return graph.multiplicity_stats(D.supplier_regions(spark, d)).withColumn("overlap_fraction", F.round("overlap_fraction", 9))


@query()
def components(spark, d):
    lines = D.table(spark, d, "lineitem")
    return connected_components(lines.select(F.col("l_partkey").alias("src"), (F.lit(1_000_000_000) + F.col("l_orderkey")).alias("dst")))


_COMMON = """e AS (SELECT i, j FROM a WHERE i <> j), q AS (SELECT i AS a, j AS b FROM e WHERE i < j),
  c AS (SELECT q.a, q.b, count(*) AS common FROM q JOIN e s ON s.i = q.a JOIN e t ON t.i = q.b AND t.j = s.j GROUP BY 1, 2)
  SELECT a, b, coalesce(common, 0) AS common FROM q LEFT JOIN c USING (a, b)"""


def _affinity(spark, d, bitmaps: bool) -> DataFrame:
    """Scores on the part graph's blocks; parts of lines that the part table lacks are no rows of these, so they go by their edges."""
    a = D.part_graph(spark, d)
    ids = D.table(spark, d, "lineitem").agg(F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi")).first()
    if ids.lo is None or ids.lo < 0 or ids.hi >= min(a.nrows, graph.LEVEL_NODES):
        return graph.affinity(graph.edges(a), bitmaps)
    return graph.affinity_of_blocks(a.blocks, a.nrows, bitmaps)


@query(_COMMON)
def common_neighbours(spark, d):
    return _affinity(spark, d, False)


@query(_COMMON)
def common_neighbours_words(spark, d):
    return _affinity(spark, d, True)


@query("SELECT i, count(*) AS degree, row_number() OVER (ORDER BY count(*) DESC, i) - 1 AS visit FROM a WHERE i <> j GROUP BY i")
def coarsening_order(spark, d):
    return graph.coarsening_order(graph.edges(D.part_graph(spark, d)))


@query("SELECT i, count(*) AS degree FROM a WHERE i <> j GROUP BY i ORDER BY degree DESC, i LIMIT 1")
def seed_node(spark, d):
    return graph.seed_node(graph.edges(D.part_graph(spark, d)))


@query("""y AS (SELECT a.i, 1000 - sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i)
  SELECT l_suppkey AS region, max(abs(v)) AS peak, min(l_partkey) AS "first" FROM lineitem JOIN y ON y.i = l_partkey GROUP BY 1 ORDER BY peak DESC, "first", region LIMIT 8""")
def top_regions(spark, d):
    return graph.top_regions(D.supplier_regions(spark, d), residual(spark, d), 8)


@query("""y AS (SELECT a.i, 1000 - sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i), g AS (SELECT DISTINCT l_suppkey AS region, l_partkey AS i FROM lineitem)
  SELECT region, i FROM (SELECT region, g.i, row_number() OVER (PARTITION BY region ORDER BY CASE WHEN g.i % 11 = 0 THEN 1 ELSE 0 END DESC, CASE WHEN g.i % 11 = 0 THEN 0 ELSE abs(v) END DESC, g.i) AS n FROM g JOIN y ON y.i = g.i) WHERE n <= 40""")
def cap_regions(spark, d):
    grown = D.supplier_regions(spark, d)
    return graph.cap_regions(grown.where("i % 11 = 0"), grown, residual(spark, d), 40)


@query("""SELECT min(region) AS region, array_to_string(members, ',') AS members FROM (SELECT l_orderkey AS region, list_sort(list(DISTINCT l_suppkey)) AS members FROM lineitem GROUP BY 1) GROUP BY members""", parts=False)
def merge_unique_regions(spark, d):
    regions = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("region"), F.col("l_suppkey").alias("i"))
    return graph.merge_unique(regions).select("region", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("""WITH RECURSIVE dep AS (SELECT DISTINCT s.l_suppkey AS i, t.l_suppkey AS j FROM lineitem s JOIN lineitem t USING (l_orderkey) WHERE t.l_suppkey < s.l_suppkey),
  n AS (SELECT unnest(range(max(s_suppkey) + 1)) AS i FROM supplier), r AS (SELECT i, 0 AS level FROM n UNION SELECT dep.i, r.level + 1 FROM r JOIN dep ON dep.j = r.i) SELECT i, max(level) AS level FROM r GROUP BY i""", parts=False)
def dependency_levels(spark, d):
    lines = D.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    dep = lines.select("l_orderkey", F.col("l_suppkey").alias("i")).join(lines.select("l_orderkey", F.col("l_suppkey").alias("j")), "l_orderkey").where("j < i").select("i", "j").distinct()
    n = D.table(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0] + 1
    return graph.levels(dep, spark.range(n).select(F.col("id").alias("i")))


# --- partitions -----------------------------------------------------------------------------------


@query("SELECT CAST(r AS INTEGER) AS rank, r * (n // 7) + least(r, n % 7) AS lo, (r + 1) * (n // 7) + least(r + 1, n % 7) AS hi FROM np, range(7) q(r)")
def balanced_partition(spark, d):
    return partition.ranges(spark, partition.balanced(D.part_graph(spark, d).nrows, 7))


@query(f"{OWN} SELECT DISTINCT oi AS rank, oj AS peer, j AS dof FROM placed WHERE oi <> oj")
def halo_plan(spark, d):
    a = D.part_graph(spark, d)
    return partition.halo(a, _owners(a))


@query(f"{OWN} SELECT DISTINCT oi AS rank, oj AS peer, j AS dof FROM placed WHERE oi <> oj")
def halo_plan_words(spark, d):
    a = D.part_graph(spark, d)
    return partition.halo_from_words(topology.words(a.pattern()), _owners(a))


@query(f"""{OWN}, h AS (SELECT oi, count(DISTINCT j) AS g, count(DISTINCT oj) AS p FROM placed WHERE oi <> oj GROUP BY oi), e AS (SELECT oi, count(*) AS z, count(*) FILTER (oi <> oj) AS c FROM placed GROUP BY oi), r AS (SELECT owner, count(*) AS m FROM own GROUP BY owner)
  SELECT CAST(sum(c) AS BIGINT) AS cut_nnz, CAST(sum(g) AS BIGINT) AS ghosts, max(g) AS max_ghosts, max(p) AS max_peers, min(m) AS min_rows, max(m) AS max_rows, min(z) AS min_nnz, max(z) AS max_nnz, round(max(m) / avg(m), 9) AS row_imbalance, round(max(z) / avg(z), 9) AS nnz_imbalance
  FROM r JOIN e ON e.oi = r.owner JOIN h ON h.oi = r.owner""")
def partition_telemetry(spark, d):
    a = D.part_graph(spark, d)
    return partition.telemetry(a, _owners(a)).withColumns({c: F.round(c, 9) for c in ("row_imbalance", "nnz_imbalance")})


@query(f"""{OWN}, g AS (SELECT DISTINCT i FROM placed WHERE oi <> oj UNION SELECT DISTINCT j FROM placed WHERE oi <> oj)
  SELECT oi AS owner, count(*) FILTER (i NOT IN (FROM g) AND j NOT IN (FROM g)) AS ii, count(*) FILTER (i NOT IN (FROM g) AND j IN (FROM g)) AS ig, count(*) FILTER (i IN (FROM g) AND j NOT IN (FROM g)) AS gi, count(*) FILTER (i IN (FROM g) AND j IN (FROM g)) AS gg FROM placed GROUP BY oi""")
def interface_blocks(spark, d):
    a = D.part_graph(spark, d)
    return partition.interface_blocks(a, _owners(a))


@query("""e AS (SELECT i, j FROM a WHERE i < j), ev AS (SELECT i + 1 AS pos, 1 AS d FROM e UNION ALL SELECT j + 1, -1 FROM e), s AS (SELECT pos, sum(d) AS d FROM ev GROUP BY pos) SELECT pos, CAST(sum(d) OVER (ORDER BY pos) AS BIGINT) AS pressure FROM s""")
def boundary_pressure(spark, d):
    return partition.boundary_pressure(D.part_graph(spark, d))


@query(f"""{OWN}, c AS (SELECT owner, count(*) AS n FROM own GROUP BY owner) SELECT oi AS i, oj AS j, round(s / sqrt(r.n * q.n), 8) AS v FROM (SELECT oi, oj, sum(v) AS s FROM placed GROUP BY 1, 2) JOIN c r ON r.owner = oi JOIN c q ON q.owner = oj""")
def rank_constant_coarse(spark, d):
    a = D.part_graph(spark, d)
    return partition.rank_coarse(a, _owners(a)).withColumn("v", F.round("v", 8))


@query(ORACLES["spmv"].split("WITH RECURSIVE " + PARTS)[1])
def distributed_spmv(spark, d):
    a = D.part_graph(spark, d)
    return partition.distributed_spmv(a, _owners(a), _x(a))


@query(f"""{OWN}, h AS (SELECT DISTINCT oi AS rank, oj AS peer, j AS dof FROM placed WHERE oi <> oj), u AS (SELECT owner AS rank, 0 AS ghost, -1 AS peer, i AS dof FROM own UNION ALL SELECT rank, 1, peer, dof FROM h)
  SELECT rank, dof, row_number() OVER (PARTITION BY rank ORDER BY ghost, peer, dof) - 1 AS local, ghost = 1 AS ghost FROM u""")
def local_numbers(spark, d):
    a = D.part_graph(spark, d)
    return partition.local_numbers(_owners(a), partition.halo(a, _owners(a)))


@query(f"{OWN} SELECT DISTINCT oi AS rank, j AS dof, x.v FROM placed JOIN x ON x.i = j WHERE oi <> oj")
def halo_exchange(spark, d):
    a = D.part_graph(spark, d)
    return partition.exchange(_x(a), partition.halo(a, _owners(a)))


@query(f"{OWN} SELECT DISTINCT oi AS rank, j, oj AS owner FROM placed WHERE oi <> oj")
def owner_directory(spark, d):
    a = D.part_graph(spark, d)
    return partition.owner_directory(a, _owners(a))


@query(f"{OWN} SELECT owner, count(DISTINCT own.i) AS rows, count(a.i) AS nnz FROM own LEFT JOIN a ON a.i = own.i GROUP BY owner")
def scatter_preflight(spark, d):
    a = D.part_graph(spark, d)
    return partition.preflight(a, _owners(a))


@query(f"{OWN} SELECT owner, min(i) AS lo, max(i) + 1 AS hi, true AS contiguous FROM own GROUP BY owner")
def owners_as_ranges(spark, d):
    return partition.as_ranges(_owners(D.part_graph(spark, d)))


@query("""y AS (SELECT a.i, 1000 - sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i), e AS (SELECT i // 32 AS block, sum(v * v) AS energy FROM y GROUP BY 1)
  SELECT i // 32 AS block, sum(CASE WHEN i // 32 = j // 32 THEN abs(v) ELSE 0 END) AS internal, sum(CASE WHEN i // 32 <> j // 32 THEN abs(v) ELSE 0 END) AS boundary, any_value(energy) AS energy FROM a JOIN e ON e.block = i // 32 GROUP BY 1""")
def block_coupling(spark, d):
    return partition.block_coupling(D.part_graph(spark, d), residual(spark, d), 32)


@query("""WITH RECURSIVE s AS (SELECT l_suppkey AS block, CAST(count(*) AS BIGINT) AS size, CAST(sum(l_quantity) AS BIGINT) % 1009 AS score FROM lineitem GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, block) AS n FROM s),
  b AS (SELECT CAST(sum(size) // 3 AS BIGINT) AS most FROM s),
  r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS block, false AS taken UNION ALL SELECT o.n, CASE WHEN r.used + o.size <= most THEN r.used + o.size ELSE r.used END, o.block, r.used + o.size <= most FROM r JOIN o ON o.n = r.n + 1, b)
  SELECT s.block, s.size, s.score, r.taken FROM r JOIN s ON s.block = r.block""", parts=False)
def budget_blocks(spark, d):
    s = D.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("block")).agg(F.count("*").alias("size"), (F.sum("l_quantity").cast("long") % 1009).alias("score"))
    return partition.budget_blocks(s, s.agg(F.sum("size")).first()[0] // 3)


# --- sources --------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2", parts=False)
def matrix_market_round_trip(spark, d):
    return _round_trip(spark, D.order_part(spark, d))[0].df


def _round_trip(spark: SparkSession, a: SparseMatrix):
    import uuid

    from lattix.plans.storage import scratch_dir
    from lattix.sources import read_matrix_market, write_matrix_market

    path = f"{scratch_dir(spark)}/mtx-{uuid.uuid4().hex}"
    write_matrix_market(a, path)
    return read_matrix_market(spark, path)


@query("""SELECT (SELECT max(o_orderkey) + 1 FROM orders) AS nrows, (SELECT max(p_partkey) + 1 FROM part) AS ncols, false AS symmetric, count(*) AS input_entries, count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS duplicates_combined, CAST(0 AS BIGINT) AS zeros_removed FROM lineitem""", parts=False)
def matrix_market_info(spark, d):
    from lattix.sources.matrix_market import info_df

    return info_df(spark, _round_trip(spark, D.order_part(spark, d))[1])


@query("SELECT i, v FROM x")
def vector_file_round_trip(spark, d):
    import uuid

    from lattix.plans.storage import scratch_dir
    from lattix.sources import read_vector

    a = D.part_graph(spark, d)
    path = f"{scratch_dir(spark)}/vec-{uuid.uuid4().hex}"
    _x(a).repartitionByRange("i").sortWithinPartitions("i").select(F.col("v").cast("string").alias("value")).write.text(path)
    return read_vector(spark, path, a.ncols)


@query("""WITH g AS (SELECT x + 9 * y + 63 * z AS i, x, y, z FROM range(9) a(x), range(7) b(y), range(5) c(z)), e AS (SELECT p.i, q.i AS j FROM g p JOIN g q ON abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1)
  SELECT i, j, CAST(-1 AS DOUBLE) AS v FROM e UNION ALL SELECT i, i, CAST(count(*) + 1 AS DOUBLE) FROM e GROUP BY i""", parts=False)
def grid7(spark, d):
    from lattix.sources import grid7 as f

    return f(spark, 9, 7, 5).df


@query("""dg AS (SELECT i, count(*) AS d FROM a WHERE i <> j GROUP BY i), w AS (SELECT a.i, a.j, -1 / sqrt((r.d + 1) * (c.d + 1)) AS v FROM a JOIN dg r ON r.i = a.i JOIN dg c ON c.i = a.j WHERE a.i <> a.j)
  SELECT i, j, round(v, 9) AS v FROM w UNION ALL SELECT node.i, node.i, round(coalesce(s, 0) + 1, 9) FROM node LEFT JOIN (SELECT i, -sum(v) AS s FROM w GROUP BY i) q ON q.i = node.i""")
def spd_surrogate(spark, d):
    from lattix.sources import spd_surrogate as f

    return f(D.part_graph(spark, d)).df.withColumn("v", F.round("v", 9))


# --- coarse spaces --------------------------------------------------------------------------------


@query("""p AS (SELECT i, i // 50 AS c FROM node), dg AS (SELECT i, v AS d FROM a WHERE i = j),
  s AS (SELECT a.i, p.c AS j, -(4 / (3 * 1.5)) * sum(a.v) / any_value(dg.d) AS v FROM a JOIN p ON p.i = a.j JOIN dg ON dg.i = a.i GROUP BY a.i, p.c),
  u AS (SELECT i, c AS j, CAST(1 AS DOUBLE) AS v FROM p UNION ALL SELECT * FROM s) SELECT i, j, round(sum(v), 8) AS v FROM u GROUP BY i, j HAVING round(sum(v), 8) <> 0""")
def smoothed_transfer(spark, d):
    from lattix.solvers import coarse

    a = D.part_graph(spark, d)
    aggregates, count = coarse.contiguous_aggregates(a, 1, 50)
    return coarse.smoothed_transfer(a, coarse.piecewise_transfer(a, 1, aggregates, count), 1.5).df.withColumn("v", F.round("v", 8)).where("v <> 0")


@query("""c AS (SELECT p_partkey AS node, p_partkey // 25 AS g, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 97 AS DOUBLE) AS y, CAST(p_partkey % 53 AS DOUBLE) AS z FROM part),
  m AS (SELECT g, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM c GROUP BY g), r AS (SELECT c.g, any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz, sqrt(avg((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))) AS r FROM c JOIN m USING (g) GROUP BY c.g),
  o AS (SELECT node, g, (x - cx) / r AS x, (y - cy) / r AS y, (z - cz) / r AS z FROM c JOIN r USING (g)),
  e AS (SELECT 3 * node AS i, 6 * g AS j, 1.0 AS v FROM o UNION ALL SELECT 3 * node, 6 * g + 4, z FROM o UNION ALL SELECT 3 * node, 6 * g + 5, -y FROM o UNION ALL SELECT 3 * node + 1, 6 * g + 1, 1 FROM o UNION ALL SELECT 3 * node + 1, 6 * g + 3, -z FROM o
    UNION ALL SELECT 3 * node + 1, 6 * g + 5, x FROM o UNION ALL SELECT 3 * node + 2, 6 * g + 2, 1 FROM o UNION ALL SELECT 3 * node + 2, 6 * g + 3, y FROM o UNION ALL SELECT 3 * node + 2, 6 * g + 4, -x FROM o)
  SELECT i, j, round(v, 6) + 0.0 AS v FROM e""")
def rigid_body_transfer(spark, d):
    from lattix.solvers import coarse

    c = D.coordinates(spark, d)
    a = D.part_graph(spark, d)
    aggregates, count = coarse.contiguous_aggregates(a, 1, 25)
    return coarse.rigid_transfer(SparseMatrix(a.df, 3 * a.nrows, 3 * a.ncols), c, aggregates, count).df.withColumn("v", F.round("v", 6) + F.lit(0.0))


@query("SELECT n AS nodes, true AS several FROM np")
def graph_aggregates(spark, d):
    """Coverage of capped aggregates: every part is in exactly one of several."""
    from lattix.solvers import coarse

    a = D.part_graph(spark, d)
    aggregates, _ = coarse.graph_aggregates(a, 1, max(8, a.nrows // 8))
    return aggregates.groupBy("agg").agg(F.count("*").alias("n")).agg(F.sum("n").alias("nodes"), (F.count("*") > 1).alias("several"))


# --- solvers: b = A x for the known probe x, so the solution has an oracle ----------------------------

_SOLUTION = "SELECT i, v FROM x"


def _rhs(a: SparseMatrix, x: DataFrame) -> DataFrame:
    """A x for stored blocks that are too many for the driver by their product, else by joins."""
    from lattix.solvers.backend import BlockedMatrix, choose, stored_entries, to_array, to_vector
    from lattix.solvers.options import Execution

    if a.blocks is None or choose(a, stored_entries(a)) is not Execution.BLOCKS:
        return algebra.spmv(a, x)
    return to_vector(a.spark, BlockedMatrix(a)(to_array(x, a.ncols)))


def _solve(spark, d, make, tolerance: float = 1e-10, matrix=D.part_graph) -> DataFrame:
    """CG with a preconditioner, on the backend that the matrix' size asks for."""
    from lattix.solvers.backend import choose, product_of, stored_entries, to_array, to_vector
    from lattix.solvers.krylov import pcg
    from lattix.solvers.krylov import pcg_tables as over_tables
    from lattix.solvers.options import Execution, SolverOptions
    from lattix.solvers.system import Solver

    a, options = Solver.stored(matrix(spark, d)), SolverOptions(tolerance)
    if choose(a, stored_entries(a)) is Execution.DATAFRAME:
        return over_tables(a, _rhs(a, _x(a)), make(a), options)[0].withColumn("v", F.round("v", 3))
    product = product_of(a)
    x, _ = pcg(product, product(to_array(_x(a), a.ncols)), make(a), options=options)
    return to_vector(spark, x).withColumn("v", F.round("v", 3))


def _system(spark, d, matrix=D.part_graph, **options) -> tuple[DataFrame, object]:
    from lattix.solvers.options import SolverOptions
    from lattix.solvers.system import Solver

    a = Solver.stored(matrix(spark, d))
    x, report = Solver(SolverOptions(1e-10), **options).prepare(a).solve(_rhs(a, _x(a)))
    return x.withColumn("v", F.round("v", 3)), report


@query(_SOLUTION)
def pcg_jacobi(spark, d):
    from lattix.solvers.precond import Jacobi

    return _solve(spark, d, Jacobi.from_matrix)


@query(_SOLUTION)
def pcg_block_jacobi(spark, d):
    from lattix.solvers.precond import block_jacobi

    return _solve(spark, d, lambda a: block_jacobi(a, 8))


@query(_SOLUTION)
def pcg_two_level(spark, d):
    from lattix.solvers.precond import two_level

    return _solve(spark, d, lambda a: two_level(a, 1, 64, "graph"))


@query(_SOLUTION)
def pcg_schwarz(spark, d):
    from lattix.solvers.precond import schwarz

    return _solve(spark, d, lambda a: schwarz(a, a.rows().select(F.floor(F.col("i") / 20).alias("region"), F.explode(F.sequence("i", F.least(F.col("i") + 3, F.lit(a.nrows - 1)))).alias("i"))))


@query(_SOLUTION)
def pcg_rank_constant(spark, d):
    from lattix.solvers.precond import rank_constant

    return _solve(spark, d, lambda a: rank_constant(a, _owners(a)))


@query(_SOLUTION)
def pcg_tables(spark, d):
    from lattix.solvers.options import Execution

    return _system(spark, d, execution=Execution.DATAFRAME)[0]


@query(_SOLUTION)
def pcg_blocks(spark, d):
    from lattix.solvers.options import Execution

    return _system(spark, d, execution=Execution.BLOCKS)[0]


@query(_SOLUTION)
def adaptive_solve(spark, d):
    return _system(spark, d)[0]


@query(_SOLUTION)
def fgmres_jacobi(spark, d):
    from lattix.solvers.options import ProblemClass

    return _system(spark, d, D.convection, problem=ProblemClass.GENERAL_SQUARE)[0]


@query(_SOLUTION)
def fgmres_budget_aware(spark, d):
    from lattix.solvers.options import GeneralOptions, ProblemClass, Restart

    return _system(spark, d, D.convection, problem=ProblemClass.GENERAL_SQUARE, general=GeneralOptions(restart=4, policy=Restart.BUDGET_AWARE))[0]


@query("SELECT i, v FROM x WHERE i < (SELECT max(s_suppkey) + 1 FROM supplier)")
def fgmres_ilu0(spark, d):
    from lattix.solvers.options import GeneralOptions, GeneralPreconditioner, ProblemClass

    return _system(spark, d, D.supp_graph, problem=ProblemClass.GENERAL_SQUARE, general=GeneralOptions(preconditioner=GeneralPreconditioner.ILU0))[0]


@query(_SOLUTION)
def fgmres_tables(spark, d):
    from lattix.solvers.options import Execution, ProblemClass

    return _system(spark, d, D.convection, problem=ProblemClass.GENERAL_SQUARE, execution=Execution.DATAFRAME)[0]


@query(_SOLUTION)
def fgmres_ilu0_blocks(spark, d):
    from lattix.solvers.options import Execution, GeneralOptions, GeneralPreconditioner, ProblemClass

    return _system(spark, d, D.convection, problem=ProblemClass.GENERAL_SQUARE, execution=Execution.BLOCKS, general=GeneralOptions(preconditioner=GeneralPreconditioner.ILU0))[0]


@query(_SOLUTION)
def pcg_ic0(spark, d):
    from lattix.solvers.precond import ic0_blocks

    return _solve(spark, d, lambda a: ic0_blocks(a, _owners(a)))


@query(_SOLUTION)
def schur_solve(spark, d):
    """The interface system of the part graph dealt out over four even ranges."""
    from lattix.solvers.backend import DiskRows, to_array, to_vector
    from lattix.solvers.options import SolverOptions
    from lattix.solvers.schur import Schur
    from lattix.solvers.system import Solver

    a = Solver.stored(D.part_graph(spark, d))
    local, owners = DiskRows(a.df, a.nrows, values=True), to_array(_owners(a).select("i", F.col("owner").alias("v")), a.nrows).astype(int)
    x, _ = Schur(local, owners).solve(local(to_array(_x(a), a.ncols)), SolverOptions(1e-11))
    return to_vector(spark, x).withColumn("v", F.round("v", 3))


@query("SELECT i, v FROM x")
def prepared_solve_many(spark, d):
    """Three right-hand sides with one prepared system; the solutions add up to six times the probe."""
    from lattix.solvers.options import SolverOptions
    from lattix.solvers.system import Solver

    a = Solver.stored(D.part_graph(spark, d))
    system = Solver(SolverOptions(1e-11)).prepare(a)
    b = algebra.spmv(a, _x(a))
    parts = [system.solve(b.select("i", (F.col("v") * k).alias("v")))[0] for k in (1, 2, 3)]
    total = parts[0].union(parts[1]).union(parts[2]).groupBy("i").agg(F.sum("v").alias("v"))
    return total.select("i", F.round(F.col("v") / 6, 3).alias("v"))


@query()
def solve_report(spark, d):
    return _system(spark, d)[1].to_df(spark)


@query("""d AS (SELECT i, v AS d FROM a WHERE i = j), b AS (SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i),
  s0 AS (SELECT b.i, CAST(0 AS DOUBLE) AS x, b.v AS r, b.v / d.d AS p FROM b JOIN d USING (i)), g0 AS (SELECT sum(r * r / d.d) AS rz FROM s0 JOIN d USING (i)),
  a0 AS (SELECT a.i, sum(a.v * s0.p) AS ap FROM a JOIN s0 ON s0.i = a.j GROUP BY a.i), c0 AS (SELECT (SELECT rz FROM g0) / sum(p * ap) AS alpha FROM s0 JOIN a0 USING (i)),
  t1 AS (SELECT i, x + alpha * p AS x, r - alpha * ap AS r, p FROM s0 JOIN a0 USING (i), c0), g1 AS (SELECT sum(r * r / d.d) AS rz FROM t1 JOIN d USING (i)),
  s1 AS (SELECT t1.i, x, r, r / d.d + (SELECT rz FROM g1) / (SELECT rz FROM g0) * p AS p FROM t1 JOIN d USING (i)),
  a1 AS (SELECT a.i, sum(a.v * s1.p) AS ap FROM a JOIN s1 ON s1.i = a.j GROUP BY a.i), c1 AS (SELECT (SELECT rz FROM g1) / sum(p * ap) AS alpha FROM s1 JOIN a1 USING (i))
  SELECT i, round(x + alpha * p, 6) AS v FROM s1 JOIN a1 USING (i), c1""")
def pcg_two_steps(spark, d):
    """Two iterations of Jacobi CG over tables, against the same two written out in SQL."""
    from lattix.solvers.krylov import pcg_tables as f
    from lattix.solvers.options import SolverOptions
    from lattix.solvers.precond import Jacobi

    a = D.part_graph(spark, d)
    x, _ = f(a, algebra.spmv(a, _x(a)), Jacobi.from_matrix(a), SolverOptions(1e-30, max_iterations=2))
    return x.withColumn("v", F.round("v", 6))


@query()
def lanczos_extremes(spark, d):
    from lattix.solvers.backend import product_of
    from lattix.solvers.krylov import lanczos
    from lattix.solvers.system import Solver

    a = product_of(Solver.stored(D.supp_graph(spark, d)))
    low, high, steps = lanczos(a, a.nrows, 40)
    return spark.createDataFrame([(round(low, 4), round(high, 4), steps)], "smallest double, largest double, steps int")


@query()
def spectral_radius(spark, d):
    from lattix.solvers.coarse import spectral_radius as f

    return spark.createDataFrame([(round(f(D.supp_graph(spark, d)), 6),)], "radius double")


# --- partitioners and decisions -----------------------------------------------------------------------

_COUNTS = "SELECT CAST(r AS INTEGER) AS owner, n // 4 + CASE WHEN r < n % 4 THEN 1 ELSE 0 END AS rows FROM np, range(4) q(r)"


def _partitioned(spark, d, how) -> tuple[SparseMatrix, DataFrame]:
    from lattix.solvers.coarse import adjacency

    a = D.part_graph(spark, d)
    own = how(adjacency(graph.edges(a), a.nrows), 4)
    return a, spark.createDataFrame(pa.table({"i": np.arange(a.nrows), "owner": own.astype(np.int32)}))


@query(_COUNTS)
def region_growth_partition(spark, d):
    from lattix.solvers.partitioners import region_growth

    return partition.counts(_partitioned(spark, d, region_growth)[1])


@query(_COUNTS)
def multisource_partition(spark, d):
    from lattix.solvers.partitioners import multisource

    return partition.counts(_partitioned(spark, d, multisource)[1])


@query()
def multilevel_partition(spark, d):
    from lattix.solvers.partitioners import multilevel

    return partition.telemetry(*_partitioned(spark, d, multilevel))


@query("SELECT i AS old FROM node")
def reverse_cuthill_mckee(spark, d):
    """The ordering is a permutation: its old indices are all there are."""
    from lattix.solvers.coarse import adjacency
    from lattix.solvers.partitioners import reverse_cuthill_mckee as f

    a = D.part_graph(spark, d)
    return spark.createDataFrame(pa.table({"old": f(adjacency(graph.edges(a), a.nrows))}))


@query("""WITH e AS (SELECT event_id % 6 AS epoch, CAST(sum(value) * 100 AS BIGINT) AS baseline_ns, CAST(sum(value) * 70 AS BIGINT) AS graph_ns FROM (SELECT event_id, round(value, 0) AS value FROM events) GROUP BY 1)
  SELECT count(*) AS epochs, min(baseline_ns - graph_ns) AS least_gain_ns, count(*) FILTER (baseline_ns - graph_ns <= 0) AS not_better, CAST(125000 AS BIGINT) AS cost_ns, count(*) >= 3 AND count(*) FILTER (baseline_ns - graph_ns <= 0) = 0 AND min(baseline_ns - graph_ns) * 10 > 125000 AS admitted FROM e""", parts=False)
def robust_cost(spark, d):
    from lattix.plans.admission import robust_cost as f

    e = D.table(spark, d, "events").groupBy((F.col("event_id") % 6).alias("epoch")).agg(F.sum(F.round("value", 0)).alias("s"))
    return f(e.select("epoch", (F.col("s") * 100).cast("long").alias("baseline_ns"), (F.col("s") * 70).cast("long").alias("graph_ns")), 100_000, 10)


@query("""WITH RECURSIVE ns AS (SELECT max(s_suppkey) + 1 AS n FROM supplier), os AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS p FROM lineitem),
  off AS (SELECT s.p AS i, t.p AS j, CAST(count(*) AS DOUBLE) AS v FROM os s JOIN os t ON s.o = t.o AND s.p <> t.p GROUP BY 1, 2), nd AS (SELECT unnest(range(n)) AS i FROM ns),
  r AS (SELECT i AS node, i AS c FROM nd UNION SELECT off.j, r.c FROM r JOIN off ON off.i = r.node)
  SELECT (SELECT n FROM ns) AS strict_rows, CAST(0 AS BIGINT) AS weak_rows, CAST(0 AS BIGINT) AS other_rows, (SELECT n FROM ns) AS positive_rows, (SELECT count(*) FROM off) AS off_diagonal, CAST(0 AS BIGINT) AS missing_transpose, CAST(0 AS BIGINT) AS asymmetric, CAST(0 AS DOUBLE) AS max_difference,
  (SELECT count(DISTINCT c) FROM (SELECT node, min(c) AS c FROM r GROUP BY node)) AS components, (SELECT max(abs(i - j)) FROM off) AS bandwidth, 'strictly dominant SPD' AS class""", parts=False)
def matrix_audit(spark, d):
    return profile.audit(D.supp_graph(spark, d))


@query()
def matrix_signature(spark, d):
    return profile.signature(D.part_graph(spark, d))


# --- round trips of files and small structures ---------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    from lattix.plans.storage import scratch_dir

    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT i, j, v FROM a")
def spd_file_round_trip(spark, d):
    """Written as a Matrix Market file and admitted as SPD by certificate."""
    from lattix.sources import read_spd, write_matrix_market

    path = _scratch(spark, "spd")
    write_matrix_market(D.part_graph(spark, d), path)
    return read_spd(spark, path, ranks=4).df


@query("SELECT i, j, v FROM a")
def spd_file_experimental(spark, d):
    """The same file admitted without proof, in one file."""
    from lattix.sources import read_spd, write_matrix_market
    from lattix.sources.matrix_market import Admission

    path = _scratch(spark, "spd")
    write_matrix_market(D.part_graph(spark, d), path, single_file=True)
    return read_spd(spark, path, Admission.EXPERIMENTAL).df


@query(f"{OWN} SELECT oi AS owner, i, j, v FROM placed")
def owned_rows_round_trip(spark, d):
    from lattix.sources import read_owned_rows, write_owned_rows

    a, path = D.part_graph(spark, d), _scratch(spark, "owned")
    write_owned_rows(a, _owners(a), path)
    return read_owned_rows(spark, path).select("owner", "i", "j", "v")


@query(f"{OWN} SELECT i, j, v FROM placed WHERE oi = 2")
def owned_rows_of_one(spark, d):
    """One owner's rows, read without the others'."""
    from lattix.sources import read_owned_rows, write_owned_rows

    a, path = D.part_graph(spark, d), _scratch(spark, "owned")
    write_owned_rows(a, _owners(a), path)
    return read_owned_rows(spark, path, 2).select("i", "j", "v")


@query(f"{OWN} SELECT oi AS owner, i, j, v FROM placed")
def owned_rows(spark, d):
    a = D.part_graph(spark, d)
    return partition.owned_rows(a, _owners(a))


@query(f"{OWN} SELECT i, owner FROM own")
def labels_round_trip(spark, d):
    from lattix.sources import read_labels, write_labels

    a, path = D.part_graph(spark, d), _scratch(spark, "labels")
    write_labels(_owners(a), path)
    return read_labels(spark, path, 4, a.nrows)


@query("SELECT p_partkey - 1 AS i, CAST(p_size % 4 AS INTEGER) AS owner FROM part", parts=False)
def labels_of_a_map(spark, d):
    """An external partitioner's map from 1."""
    from lattix.sources.text import map_to_labels

    return map_to_labels(D.table(spark, d, "part").select(F.col("p_partkey").alias("vertex"), (F.col("p_size") % 4).alias("part")), 1)


@query("""e AS (SELECT i, j FROM a WHERE i <> j), lines AS (SELECT node.i, coalesce(string_agg(CAST(j + 1 AS VARCHAR), ' ' ORDER BY j), '') AS value FROM node LEFT JOIN e ON e.i = node.i GROUP BY node.i)
  SELECT value, count(*) AS times FROM (SELECT value FROM lines UNION ALL SELECT (SELECT n FROM np) || ' ' || (SELECT count(*) // 2 FROM e)) GROUP BY value""")
def graph_file(spark, d):
    """The lines of the adjacency file for partitioners."""
    from lattix.sources import write_graph

    a, path = D.part_graph(spark, d), _scratch(spark, "graph")
    write_graph(graph.edges(a), a.nrows, path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("times"))


@query("SELECT p_partkey AS node, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 97 AS DOUBLE) AS y, CAST(p_partkey % 53 AS DOUBLE) AS z FROM part", parts=False)
def coordinates_round_trip(spark, d):
    from lattix.sources import read_coordinates

    c, path = D.coordinates(spark, d), _scratch(spark, "coords")
    rows = c.select("node", F.concat_ws(" ", *[F.col(k).cast("string") for k in "xyz"]).alias("value"))
    head = c.agg(F.lit(-1).cast("long").alias("node"), F.count("*").cast("string").alias("value"))
    head.union(rows).repartitionByRange("node").sortWithinPartitions("node").select("value").write.text(path)
    return read_coordinates(spark, path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_regionkey AS BIGINT) AS j, CAST(length(n_name) AS DOUBLE) AS v FROM nation", parts=False)
def csr_rows(spark, d):
    """Compressed rows: a nation's row has one entry, in its region's column."""
    from lattix.sources import csr_to_matrix

    rows = sorted(D.table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.length("n_name")).collect())
    return csr_to_matrix(spark, len(rows), 5, list(range(len(rows) + 1)), [r[1] for r in rows], [r[2] for r in rows]).df


@query("SELECT i, i % 3 = 0 AS inside FROM (SELECT CAST(unnest(range(60)) AS BIGINT) AS i)", parts=False)
def mask_members(spark, d):
    mask = masks.mask_of(spark, 60, [0, 0, *range(57, -1, -3)])
    return spark.createDataFrame([(i, masks.contains(mask, i)) for i in range(60)], "i long, inside boolean")


@query("SELECT j FROM a WHERE i = 7")
def topology_row(spark, d):
    return topology.entries(topology.row(topology.words(D.part_graph(spark, d).pattern()), 7)).select("j")


@query("SELECT i FROM a WHERE j = 7")
def topology_column(spark, d):
    return topology.entries(topology.row(topology.transpose(topology.words(D.part_graph(spark, d).pattern())), 7)).select(F.col("j").alias("i"))


@query("SELECT CAST(q.j AS BIGINT) AS j, EXISTS (SELECT 1 FROM a WHERE a.i = 7 AND a.j = q.j) AS stored FROM range(20) q(j)")
def topology_contains(spark, d):
    t = topology.row(topology.words(D.part_graph(spark, d).pattern()), 7).persist()
    return spark.createDataFrame([(j, topology.contains(t, 7, j)) for j in range(20)], "j long, stored boolean")


@query(f"{OWN} SELECT true AS same, false AS changed, CAST(0 AS BIGINT) AS violations FROM np")
def distributed_rows_verified(spark, d):
    """Rows dealt out by owner hold the original's bits; one changed sign is noticed; the words break no rule."""
    from lattix.plans.storage import configured
    from lattix.solvers.backend import stored_entries
    from lattix.solvers.system import Solver

    a = Solver.stored(D.part_graph(spark, d))
    dealt = SparseMatrix(partition.owned_rows(a, _owners(a)).select("i", "j", "v"), a.nrows, a.ncols)
    other = SparseMatrix(a.df.withColumn("v", F.when(F.expr("i = 3 and j = 3"), -F.col("v")).otherwise(F.col("v"))), a.nrows, a.ncols)
    slices = -(-stored_entries(a) // (profile.SLICE_ENTRIES // 2)) + 1
    cuts, broken = [-(1 << 63), *[a.nrows * k // slices for k in range(1, slices)], (1 << 63) - 1], 0
    for lo, hi in zip(cuts, cuts[1:]):
        with configured(spark, sweep="true"):
            broken += topology.violations(topology.words_of_blocks(a.blocks, a.ncols, lo, hi), a.nrows, a.ncols).count()
    return spark.createDataFrame([(profile.bit_exact(a, dealt), profile.bit_exact(a, other), broken)], "same boolean, changed boolean, violations long")


@query(_SOLUTION)
def pcg_promoting(spark, d):
    """CG whose Jacobi gives way to owner factors, checked against the true residual."""
    from lattix.solvers.backend import product_of, to_array, to_vector
    from lattix.solvers.krylov import pcg_promoting as f
    from lattix.solvers.options import SolverOptions
    from lattix.solvers.precond import Jacobi, ic0_blocks
    from lattix.solvers.system import Solver

    a = Solver.stored(D.part_graph(spark, d))
    product = product_of(a)
    x, _, _, _ = f(product, product(to_array(_x(a), a.ncols)), Jacobi.from_matrix(a), lambda r: ic0_blocks(a, _owners(a)), 3, 1e-3, SolverOptions(1e-10))
    return to_vector(spark, x).withColumn("v", F.round("v", 3))


@query("SELECT i, 3 * i AS first, v FROM x")
def structural_solve(spark, d):
    """Three rows for each part: the solution of (A kron I) with rigid-body aggregates, one component shown."""
    from lattix.solvers.backend import kron_identity, product_table, to_array
    from lattix.solvers.options import SolverOptions
    from lattix.solvers.system import Solver

    a = Solver.stored(D.part_graph(spark, d))
    wide = kron_identity(a, 3)
    known = _x(a).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)]))).select((3 * F.col("i") + F.col("k")).alias("i"), "v")
    b = product_table(wide, to_array(known, wide.ncols))
    x, _ = Solver(SolverOptions(1e-10)).solve_structural(wide, a.rows().select(F.col("i").alias("node"), *[((F.col("i") * m + 1) % 101).cast("double").alias(c) for m, c in ((7, "x"), (13, "y"), (29, "z"))]), b)
    return x.where("i % 3 = 0").select((F.col("i") / 3).cast("long").alias("i"), F.col("i").alias("first"), F.round("v", 3).alias("v"))
