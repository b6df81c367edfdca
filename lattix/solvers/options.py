"""Options with their documented defaults, outcomes, and the solve report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

from lattix.schema import InvalidArgument

TINY = 2.2250738585072014e-308


class Status(str, Enum):
    CONVERGED = "converged"
    MAX_ITERATIONS = "max_iterations"
    BREAKDOWN = "breakdown"


class ProblemClass(str, Enum):
    """What the caller declares about the matrix; it is never inferred."""

    SPD = "spd"
    GENERAL_SQUARE = "general_square"


class Execution(str, Enum):
    AUTO, LOCAL, BLOCKS, DATAFRAME = "auto", "local", "blocks", "dataframe"


class Restart(str, Enum):
    FIXED, ESCALATING, BUDGET_AWARE = "fixed", "escalating", "budget_aware"


class Selection(str, Enum):
    CANDIDATE_ORDER, BENEFIT_PER_BYTE, JACOBI_ENERGY_PER_BYTE = "candidate_order", "benefit_per_byte", "jacobi_energy_per_byte"


class GeneralPreconditioner(str, Enum):
    JACOBI, ILU0, ILU0_IDENTITY_FALLBACK = "jacobi", "ilu0", "ilu0_identity_fallback"


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise InvalidArgument(what)


@dataclass(frozen=True)
class SolverOptions:
    relative_tolerance: float = 1e-8
    absolute_tolerance: float = 0.0
    max_iterations: int = 1000

    def __post_init__(self):
        _need(self.relative_tolerance >= 0 and self.absolute_tolerance >= 0, "tolerances must not be negative")
        _need(self.relative_tolerance > 0 or self.absolute_tolerance > 0, "at least one tolerance must be positive")
        _need(self.max_iterations >= 0, "max_iterations must not be negative")

    def target(self, b_norm: float) -> float:
        return max(self.absolute_tolerance, self.relative_tolerance * max(b_norm, TINY))


@dataclass(frozen=True)
class CoarseOptions:
    enabled: bool = False
    dofs_per_node: int = 3
    target_dimension: int = 1536
    aggregation: str = "contiguous"
    basis: str = "piecewise_constant"

    def __post_init__(self):
        _need(self.dofs_per_node >= 1 and self.target_dimension >= self.dofs_per_node, "coarse dimensions must hold a node")
        _need(self.aggregation in ("contiguous", "graph", "strong_graph"), "unknown aggregation")
        _need(self.basis in ("piecewise_constant", "jacobi_smoothed"), "unknown basis")


@dataclass(frozen=True)
class HybridOptions:
    enabled: bool = True
    probe_iterations: int = 12
    max_escalations: int = 3
    stage_iterations: int = 24
    poor_ratio: float = 0.50
    coupling: float = 0.90
    scale_jump: float = 100.0
    seed_fraction: float = 0.25
    region_size: int = 128
    regions: int = 8
    factor_bytes: int = 64 << 20
    selection: Selection = Selection.JACOBI_ENERGY_PER_BYTE
    overlap: int = 1
    coarse: CoarseOptions = field(default_factory=CoarseOptions)

    def __post_init__(self):
        _need(self.probe_iterations >= 1 and self.stage_iterations >= 1, "iteration budgets must be positive")
        _need(0 < self.seed_fraction <= 1 and 0 < self.poor_ratio, "fractions must be positive")
        _need(self.scale_jump >= 1 and self.coupling > 0, "risk thresholds out of range")
        _need(1 <= self.region_size and 1 <= self.regions and 0 <= self.overlap <= 8, "region limits out of range")


@dataclass(frozen=True)
class GeneralOptions:
    restart: int = 30
    policy: Restart = Restart.FIXED
    max_restart: int = 70
    stage_iterations: int = 300
    preconditioner: GeneralPreconditioner = GeneralPreconditioner.JACOBI

    def __post_init__(self):
        _need(self.restart >= 1 and self.max_restart >= self.restart and self.stage_iterations >= 1, "restart lengths out of range")


@dataclass
class Outcome:
    status: Status
    iterations: int
    initial_residual: float
    final_residual: float

    def then(self, other: Outcome) -> Outcome:
        """This segment followed by another of the same solve."""
        return Outcome(other.status, self.iterations + other.iterations, self.initial_residual, other.final_residual)


@dataclass
class Report:
    status: str
    solver: str
    preconditioner: str
    execution: str
    iterations: int
    initial_residual: float
    final_residual: float
    relative_residual: float
    escalations: int = 0
    regions: int = 0
    hard_dofs: int = 0
    factor_bytes: int = 0
    coarse_dimension: int = 0
    restart: int = 0
    sequence: int = 1
    reused: bool = False
    stages: list[dict] = field(default_factory=list)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The report as a table of one row."""
        schema = (
            "status string, solver string, preconditioner string, execution string, iterations int, initial_residual double, final_residual double, relative_residual double, escalations int, regions int, "
            "hard_dofs int, factor_bytes long, coarse_dimension int, restart int, sequence int, reused boolean, stages array<struct<stage:int,iterations:int,regions:int,residual:double>>"
        )
        return spark.createDataFrame([tuple(asdict(self).values())], schema)


#: Called after each FGMRES cycle with (restart, cycle iterations, first and last residual of the cycle, iterations left); gives the next restart.
RestartControl = Callable[[int, int, float, float, int], int]
