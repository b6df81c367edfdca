"""Contiguous partitions that never split a field block, refined by boundary pressure and admitted by cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.operators import layout as layouts
from lattix.operators import partition as P
from lattix.plans.storage import materialize
from lattix.schema import DimensionMismatch, InvalidArgument, SparseMatrix
from lattix.solvers.partitioners import refine_cuts

Ranges = list[tuple[int, int, int]]


def field_cuts(layout: DataFrame, n: int, ranks: int) -> list[int]:
    """Nearest block boundary to each even target."""
    return sorted(r.cut for r in P.field_aligned(layout, n, ranks).collect())


def as_parts(cuts: list[int], n: int) -> Ranges:
    return P.from_offsets([0, *cuts, n])


def graph_cuts(a: SparseMatrix, layout: DataFrame, ranks: int, radius: int = 5, cap: float = 1.15) -> tuple[list[int], bool]:
    """Field cuts moved by at most ``radius`` block boundaries to where fewer edges cross: ``(cuts, accepted)``.

    Pressure and entry counts are computed by Spark. Only boundaries within reach of some cut come
    to the driver, 2 * radius + 1 for each cut.
    """
    cuts = field_cuts(layout, a.nrows, ranks)
    spark = a.spark
    bounds = materialize(layout.select(F.col("start").alias("pos")).union(layout.select(F.col("end").alias("pos"))).distinct(), "bounds")
    near: set[int] = {0, a.nrows}
    for c in cuts:
        near |= {r.pos for r in bounds.where(F.col("pos") <= c).orderBy(F.desc("pos")).limit(radius + 1).collect()}
        near |= {r.pos for r in bounds.where(F.col("pos") > c).orderBy("pos").limit(radius).collect()}
    places = sorted(near)
    asked = spark.createDataFrame([(p,) for p in places], "pos bigint")
    steps = P.boundary_pressure(a)
    # pressure holds from the position where it changed on: the latest change up to each place
    latest = steps.join(F.broadcast(asked.select(F.col("pos").alias("at"))), F.col("pos") <= F.col("at")).groupBy("at").agg(F.max_by("pressure", "pos").alias("pressure"))
    pressure = {r["at"]: r.pressure for r in latest.collect()}
    rows = a.df.groupBy("i").agg(F.count("*").alias("n"))
    slot = F.lit(0)
    for p in places[1:]:
        slot = slot + F.when(F.col("i") >= p, 1).otherwise(0)
    sums = {r.slot: r.n for r in rows.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).collect()}
    load = [0]
    for k in range(len(places) - 1):
        load.append(load[-1] + sums.get(k, 0))
    choice = refine_cuts(places, pressure, load, cuts, radius, cap)
    return choice.cuts, choice.accepted


@dataclass(frozen=True)
class CostOptions:
    """Expected products with a partition, and a calibration (baseline ns, graph ns, preparation ns), if there is one."""

    expected_products: int = 0
    calibration: tuple[int, int, int] | None = None
    radius: int = 5
    row_imbalance: float = 1.15
    nnz_imbalance: float = 1.15

    def __post_init__(self):
        if self.row_imbalance < 1 or self.nnz_imbalance < 1 or self.radius < 0 or self.expected_products < 0:
            raise InvalidArgument("limits out of range")
        if self.calibration is not None and (min(self.calibration[:2]) <= 0 or self.calibration[2] < 0):
            raise InvalidArgument("calibrated times must be positive")


METRICS = ("ghosts", "cut_nnz", "peers", "max_nnz", "max_rows")


def _told(a: SparseMatrix, parts: Ranges) -> dict:
    owners = P.owners_of(a.spark, parts)
    out = P.telemetry(a, owners).first().asDict()
    return out | {"peers": P.halo(a, owners).select("rank", "peer").distinct().count()}


def cost_aware(a: SparseMatrix, layout: DataFrame, ranks: int, options: CostOptions = CostOptions()) -> tuple[Ranges, str, str]:
    """``(ranges, kind, decision)``: equal, field or graph cuts.

    Equal cuts are a candidate only if they split no block, and replace field cuts only if no
    metric is worse. Graph cuts are not even made before the calibrated model says that they pay;
    then no metric may be worse than the baseline's and the loads must keep their limits.
    """
    a.need_square()
    if layout.agg(F.max("end")).first()[0] != a.nrows:
        raise DimensionMismatch("the layout and the matrix differ in size")
    a = SparseMatrix(materialize(a.df, "cost"), a.nrows, a.ncols)
    if ranks == 1:
        return P.balanced(a.nrows, 1), "equal", "single_rank"
    field, equal = as_parts(field_cuts(layout, a.nrows, ranks), a.nrows), P.balanced(a.nrows, ranks)
    base, kind, told = field, "field", _told(a, field)
    inside = {r.pos for r in layout.select(F.col("start").alias("pos")).where(F.col("pos").isin([lo for _, lo, _ in equal])).collect()}
    if {lo for _, lo, _ in equal} <= inside:
        other = _told(a, equal)
        if all(other[m] <= told[m] for m in METRICS):
            base, kind, told = equal, "equal", other
    if options.expected_products == 0:
        return base, kind, "no_expected_reuse"
    if options.calibration is None:
        return base, kind, "no_calibration"
    if options.radius == 0:
        return base, kind, "zero_search_radius"
    plain, graph, preparation = options.calibration
    if graph >= plain:
        return base, kind, "no_calibrated_speedup"
    if (plain - graph) * options.expected_products <= preparation:
        return base, kind, "unamortized_preparation"
    cuts, accepted = graph_cuts(a, layout, ranks, options.radius, options.nnz_imbalance)
    if not accepted:
        return base, kind, "graph_proposal_rejected"
    parts = as_parts(cuts, a.nrows)
    if parts == base:
        return base, kind, "graph_not_distinct"
    new = _told(a, parts)
    if any(new[m] > told[m] for m in METRICS[:3]):
        return base, kind, "graph_does_not_dominate"
    if new["row_imbalance"] > options.row_imbalance or new["nnz_imbalance"] > options.nnz_imbalance:
        return base, kind, "load_imbalance_limit"
    return parts, "graph", "graph_selected"


class FieldHalos:
    """Halo plan and local numbers of a partition that splits no block, made once and stored."""

    def __init__(self, a: SparseMatrix, layout: DataFrame, parts: Ranges):
        owners = P.owners_of(a.spark, parts)
        split = layouts.split_blocks(layout, owners).take(1)
        if split:
            raise InvalidArgument(f"block {split[0].block_index} has several owners")
        self.owners = materialize(owners, "owners")
        self.plan = materialize(P.halo(a, self.owners), "halo")
        self.numbers = materialize(P.local_numbers(self.owners, self.plan), "numbers")
        self.matrices = materialize(P.local_matrices(a, self.owners, self.plan), "local")


class FieldTopology:
    """Edges and layout stored once, to grow many regions."""

    def __init__(self, a: SparseMatrix, layout: DataFrame):
        from lattix.operators.graph import edges

        self.edges, self.layout = materialize(edges(a), "edges"), materialize(layout, "layout")

    def close(self, regions: DataFrame) -> DataFrame:
        """``(region, i)`` grown to whole blocks, all regions at once."""
        where = layouts.locate(self.layout, regions.select("i").distinct()).select("i", "block_index")
        touched = regions.join(where, "i").select("region", "block_index").distinct()
        return layouts.dofs(self.layout).join(touched, "block_index").select("region", "i")

    def grow(self, regions: DataFrame, hops: int) -> DataFrame:
        """Closed, then a hop and closed again for each of ``hops``; all regions in one plan a hop."""
        from lattix.operators.graph import grow

        out = materialize(self.close(regions), "regions")
        for _ in range(hops):
            out = materialize(self.close(grow(self.edges, out, 1).select("region", "i")), "regions")
        return out
