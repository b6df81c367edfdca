"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget descends a tree (domain, language, source). At each node children get shares by
weight, but none more than its capacity (its tokens times the most epochs allowed); what one
child can't take goes to its siblings by weight, and only what the whole family can't take was
never given to it, so it went to the family's own siblings above. A leaf with budget A and L tokens
takes A div L whole epochs and, of one more, the prefix of A mod L tokens in that epoch's seeded order.
All amounts are integers, so results are the same on every engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.llm.common import Numbered
from lattix.plans.storage import materialize, release

#: Names of the tree's levels from the top, and how to compute each from the table's columns.
Levels = dict[str, Callable[[Numbered], Column]]

#: A word is a run of characters other than U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Fewest hex digits of the order key that number the cells of a leaf: only one cell of a leaf is sorted.
CELL_DIGITS = 2


#: Production weights by level; nodes that are not named weigh 1.
CORPUS_WEIGHTS = {"domain": {"domain0": 5, "domain1": 3, "domain2": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 2}}


def corpus_levels() -> Levels:
    """The tree of ``documents``: three domains by the number that ends a source's name (0 without one), then lang and source."""

    def domain(t: Numbered) -> Column:
        number = F.coalesce(F.regexp_extract(t["source"].cast("string"), "([0-9]+)$", 1).try_cast("int"), F.lit(0))
        return F.concat(F.lit("domain"), (number % 3).cast("string"))

    return {"domain": domain, "lang": lambda t: t["lang"], "source": lambda t: t["source"]}


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def label(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("unknown"))


def waterfill(children: DataFrame, family: list[str]) -> DataFrame:
    """Adds ``budget`` to rows with family columns, ``weight``, ``cap`` and the family's ``given``.

    Children fill up in order of cap / weight: one is full if its share of what is left reaches
    its cap. The others share the rest by weight, rounded down. A child of weight 0 gets nothing.
    """
    fed = F.col("weight") > 0
    ranked = Window.partitionBy(*family, fed).orderBy(F.try_divide("cap", "weight"), "cap", "weight", "name")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    rest = ranked.rowsBetween(0, Window.unboundedFollowing)
    step = children.withColumns({"taken": F.coalesce(F.sum("cap").over(before), F.lit(0)), "heavy": F.sum("weight").over(rest)})
    step = step.withColumn("full", fed & (F.col("cap") * F.col("heavy") <= F.col("weight") * (F.col("given") - F.col("taken"))))
    whole = Window.partitionBy(*family)
    step = step.withColumns({"spent": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole), "open": F.sum(F.when(~F.col("full") & fed, F.col("weight")).otherwise(0)).over(whole)})
    share = F.expr("weight * (given - spent) div nullif(open, 0)")
    return step.withColumn("budget", F.when(F.col("full"), F.col("cap")).when(~fed, 0).otherwise(share).cast("long")).drop("taken", "heavy", "full", "spent", "open")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``leaves`` (levels and n_tokens) with ``budget``; the root is given total * share[0] div share[1] tokens."""
    capped = leaves.withColumn("cap", F.col("n_tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n
    given = min(total * share[0] // share[1], total * max_epochs)
    up: list[str] = []
    nodes = None
    for level in levels:
        path = [*up, level]
        weight = F.lit(1).cast("long")
        for name, w in weights.get(level, {}).items():
            weight = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(weight)
        node = capped.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumns({"weight": weight, "name": F.col(level)})
        node = node.withColumn("given", F.lit(given).cast("long")) if nodes is None else node.join(nodes, up)
        nodes = waterfill(node, up).select(*path, F.col("budget").alias("given"))
        up = path
    return capped.drop("cap").join(nodes.withColumnRenamed("given", "budget"), levels)


def mix(
    docs: DataFrame,
    levels: Levels,
    weights: dict[str, dict[str, int]],
    share: tuple[int, int] = (1, 2),
    max_epochs: int = 2,
    seed: int = 0,
) -> DataFrame:
    """Rows of ``docs`` once for each epoch that takes them, with ``n_tokens``, ``epoch`` and the ``levels`` as ``leaf`` (a struct).

    ``levels`` names the tree's levels from the top and how to compute them; a null value is the node
    ``unknown``. ``weights`` gives integer weights by level and name, 1 where none is given. The
    order of an epoch is that of md5(seed:epoch:doc_id), so rows that repeat an id stand at
    one place and are taken together or not at all. A row without tokens (null or empty text) is
    in every whole epoch of its leaf and in a prefix that passes it. Budgets that exceed
    ``max_epochs`` of everything are cut to that. An empty table gives no rows. Columns named like results, in any
    case, are replaced.
    """
    results = ("n_tokens", "epoch", "leaf")
    table, names = Numbered(docs), list(levels)
    held, plain, columns = table.plain(results)
    doc_id, text = table["doc_id"].cast("string"), table["text"].cast("string")
    leaf = F.struct(*[label(levels[k](table)).alias(k) for k in names])
    base = materialize(table.df.select(doc_id.alias("id"), leaf.alias("leaf"), tokens(text).alias("n_tokens")).select("id", "n_tokens", "leaf.*"), "mix-base")
    totals = materialize(base.groupBy(*names).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")), "mix-leaves")
    epochs, rest = (F.when(F.col("n_tokens") > 0, F.expr(f"budget {op} n_tokens")).otherwise(0) for op in ("div", "%"))
    # as many cells in a leaf as rows in a cell, about: neither is more than the root of the leaf's rows times 16
    digits = F.greatest(F.lit(CELL_DIGITS), F.ceil(F.log2(F.greatest("n_rows", F.lit(1))) / 8)).cast("int")
    plan = materialize(budgets(totals, names, weights, share, max_epochs).select(*names, "budget", epochs.alias("epochs"), rest.alias("rest"), digits.alias("digits")), "mix-plan")

    def key(doc_id: Column, epoch: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id, F.lit(""))))

    partial = plan.where("rest > 0")
    keyed = base.join(partial, names).withColumn("key", key(F.col("id"), F.col("epochs"))).withColumn("cell", F.expr("substring(key, 1, digits)"))
    cells = keyed.groupBy(*names, "cell").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*names).orderBy("cell")
    crossed = materialize(cells.withColumn("upto", F.sum("n").over(run)).where("upto - n <= rest and upto > rest").select(*names, F.col("cell").alias("cut"), F.col("upto").alias("upto"), (F.col("upto") - F.col("n")).alias("before")), "mix-cells")
    inside = keyed.join(crossed, names).where("cell = cut").groupBy(*names, "key").agg(F.sum("n_tokens").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    order = Window.partitionBy(*names).orderBy("key")
    last = inside.withColumn("run", F.col("before") + F.sum("n").over(order)).where("run <= rest").groupBy(*names).agg(F.max("key").alias("last"))
    cuts = materialize(plan.join(crossed.select(*names, "cut"), names, "left").join(last, names, "left").select(F.struct(*names).alias("node"), "epochs", F.coalesce("last", "cut").alias("bound"), F.col("last").isNotNull().alias("closed")), "mix-cuts")
    release(base, totals, plan, crossed)

    source = table.df.select(*held, leaf.alias("own"), text.alias("body"), doc_id.alias("id"))
    joined = source.join(cuts, F.col("own") == F.col("node"))
    at = key(F.col("id"), F.col("epochs"))
    extra = F.when(F.col("bound").isNotNull() & ((at < F.col("bound")) | (F.col("closed") & (at == F.col("bound")))), 1).otherwise(0)
    taken = joined.withColumn("times", (F.col("epochs") + extra).cast("int")).where("times > 0")
    out = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return out.select(*plain, tokens(F.col("body")).alias("n_tokens"), "epoch", F.col("own").alias("leaf")).toDF(*columns, *results)
