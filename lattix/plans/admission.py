"""Deciding whether a refined partition is worth having: measured gains and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def calibration_key(matrix_signature: tuple[int, int], layout_rows: int, ranks: int, environment: str) -> str:
    """What a calibration holds for; a decision made for another key must not be used."""
    import hashlib

    return hashlib.sha256(repr((matrix_signature, layout_rows, ranks, environment)).encode()).hexdigest()


def robust_cost(epochs: DataFrame, preparation_ns: int, solves: int, contingency: float = 0.25, least: int = 3) -> DataFrame:
    """One row: paired epochs, least gain, cost with contingency, and whether the refined choice is admitted.

    ``epochs`` has epoch, baseline_ns and graph_ns. At least three pairs, every gain positive, and
    the least gain over all solves strictly above the preparation with its contingency.
    """
    gains = epochs.where("baseline_ns is not null and graph_ns is not null").select((F.col("baseline_ns") - F.col("graph_ns")).alias("g"))
    out = gains.agg(F.count("*").alias("epochs"), F.min("g").alias("least_gain_ns"), F.count_if(F.col("g") <= 0).alias("not_better"))
    cost = int(preparation_ns * (1 + contingency))
    good = (F.col("epochs") >= least) & (F.col("not_better") == 0) & (F.col("least_gain_ns") * solves > cost)
    return out.withColumns({"cost_ns": F.lit(cost).cast("long"), "admitted": F.coalesce(good, F.lit(False))})
