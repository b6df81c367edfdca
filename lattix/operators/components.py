"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.plans.storage import materialize, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Return ``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Parent hooking with pointer jumping: each round lets every tree adopt the smallest
    grandparent seen across an edge and then halves all paths, so the number of rounds
    grows with the logarithm of the node count even on long chains. Every round is stored
    in the shared folder, hence a lost executor costs one round at most. Nothing is
    collected but one flag per round. Null endpoints and self-loops link nothing; a
    self-loop still names its node. An empty edge table gives an empty result.
    """
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    both = materialize(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("f")).select(F.col("u").alias("node"), "f"), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), F.col("f").alias("fv")), "v").groupBy("u").agg(F.min("fv").alias("m"))
        cand = labels.join(seen.withColumnRenamed("u", "node"), "node", "left").select("node", "f", F.least("f", F.coalesce("m", "f")).alias("m"))
        hooks = cand.select(F.explode(F.array(F.struct(F.col("node").alias("k"), F.col("m").alias("p")), F.struct(F.col("f").alias("k"), F.col("m").alias("p")))).alias("h"))
        parents = hooks.select("h.k", "h.p").groupBy("k").agg(F.min("p").alias("p"))
        hooked = materialize(labels.join(parents.withColumnRenamed("k", "node"), "node", "left").select("node", F.col("f").alias("old"), F.least("f", F.coalesce("p", "f")).alias("f")), "cc-hooked")
        roots = hooked.select(F.col("node").alias("f"), F.col("f").alias("g"))
        fresh = materialize(hooked.join(roots, "f", "left").select("node", "old", F.least("f", F.coalesce("g", "f")).alias("f")), "cc-labels")
        changed = fresh.where("f <> old").limit(1).count()
        release(hooked)
        release(labels)
        if not changed:
            release(both)
            return fresh.select("node", F.col("f").alias("component"))
        labels = fresh.select("node", "f")
        labels._stored_at = fresh._stored_at
