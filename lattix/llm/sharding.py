"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until splitters fit.

Rows are ordered by (hash of the text, doc_id). Each round counts the exact bytes between
candidate boundaries over all partitions (a small grouped sum) and narrows the interval of every
splitter that is not yet within tolerance. A boundary first falls between different hashes, so
equal texts stay together; only a group larger than the tolerance is cut, by doc_id. When all
splitters are settled the rows are exchanged once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.llm.common import Numbered
from lattix.plans.storage import materialize, release

_LOW, _HIGH = -(1 << 63), 1 << 63
#: Rows of a cell, the unit in which rows of a shard are ordered and numbered (more in tables of over a
#: billion rows, which have this many cells).
CELL_ROWS, MOST_CELLS = 20_000, 50_000


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _order(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LOW))


class _Splitter:
    """One boundary in search: rows below it are counted exactly at every candidate."""

    def __init__(self, target: float):
        self.target, self.lo, self.hi, self.below, self.within = target, _LOW, _HIGH, 0, None
        self.found: tuple[int, int] | None = None

    def key(self) -> tuple:
        return (self.within, self.lo, self.hi)

    def narrow(self, step: int, cells: dict[int, int], tolerance: float, ids: tuple[int, int]) -> None:
        """``cells``: bytes in each step-wide cell of the interval. Settle on a near edge or descend into the cell across the target."""
        run, at, size = self.below, self.lo, 0
        for k in sorted(cells):
            if run + cells[k] > self.target:
                at, size = self.lo + k * step, cells[k]
                break
            run += cells[k]
            at = self.lo + (k + 1) * step
        near, edge = min((abs(run - self.target), at), (abs(run + size - self.target), min(at + step, self.hi)))
        if near <= tolerance or size == 0 or (step == 1 and self.within is not None):
            self.found = (edge, _LOW) if self.within is None else (self.within, edge)
        elif step == 1:  # one text holds more than the tolerance: go on by id
            self.within, self.lo, self.hi, self.below = at, ids[0], ids[1] + 1, run
        else:
            self.lo, self.hi, self.below = at, min(at + step, self.hi), run


def splitters(keys: DataFrame, shards: int, tolerance: float, probes: int = 256) -> list[tuple[int, int]]:
    """``shards - 1`` boundaries (hash, id): a row belongs below one if its pair is smaller.

    ``keys`` has h, id and size. Every boundary is within ``tolerance`` (a share of a shard's
    even size) of its target wherever single rows allow it.
    """
    total = keys.agg(F.sum("size").alias("t"), F.min("id").alias("a"), F.max("id").alias("b")).first()
    if not total.t:
        return [(_LOW, _LOW)] * (shards - 1)
    search = [_Splitter(total.t * k / shards) for k in range(1, shards)]
    slack = tolerance * total.t / shards
    while pending := [s for s in search if s.found is None]:
        spans = sorted({s.key() for s in pending}, key=str)
        cell = F.lit(None).cast("struct<span:int,cell:long>")
        for number, (within, lo, hi) in enumerate(spans):
            step = -(-(hi - lo) // probes)
            value = F.col("h") if within is None else F.col("id")
            inside = (value >= lo) & (value <= hi - 1) if within is None else (F.col("h") == within) & (value >= lo) & (value <= hi - 1)
            # decimals, since the width of the first interval is no long
            place = F.floor((value.cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")) / F.lit(step).cast("decimal(20,0)")).cast("long") if step > 1 else value - lo
            cell = F.when(inside, F.struct(F.lit(number).alias("span"), place.alias("cell"))).otherwise(cell)
        counted = keys.select(cell.alias("x"), "size").where("x is not null").groupBy("x.span", "x.cell").agg(F.sum("size").alias("n")).collect()
        for s in pending:
            number = spans.index(s.key())
            s.narrow(-(-(s.hi - s.lo) // probes), {r.cell: r.n for r in counted if r.span == number}, slack, (total.a, total.b))
    return [s.found for s in search]


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.005, cell_rows: int = CELL_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (0 up to ``shards``) and ``slot`` (gapless from 0 in each shard).

    Shards hold nearly equal bytes (:func:`text_bytes`). Slots follow the order of (hash of the text, doc_id), but
    for cells that few texts fill: their rows are dealt out by a hash of the row. A null text counts as an empty one, a null
    id sorts first, and rows equal in text and id get any slots of their shard. With fewer
    rows than shards some shards are empty; an empty table gives no rows. Columns named shard or
    slot, in any case, are replaced.
    """
    table = Numbered(docs)
    held, plain, names = table.plain(("shard", "slot"))
    others = [F.col(c) for c, t in table.df.dtypes if "<" not in t and c != table.at("text")]
    keyed = table.df.select(*held, _order(table["text"]).alias("h"), _id(table["doc_id"]).alias("id"), F.xxhash64(_order(table["text"]), *others).alias("z"), text_bytes(table["text"].cast("string")).alias("size"))
    keys = materialize(keyed.select("h", "id", "z", "size"), "shard-keys")
    bounds = splitters(keys, shards, tolerance)
    shard_of = F.lit(0)
    for a, b in bounds:
        below = F.lit(False) if a <= _LOW else F.lit(True) if a >= _HIGH else (F.col("h") < a) if b <= _LOW else (F.col("h") < a) | ((F.col("h") == a) & (F.col("id") <= b - 1))
        shard_of = shard_of + F.when(below, 0).otherwise(1)

    # cells of at least a 50 000th of all rows: what is broadcast here has a fixed bound
    rows = keys.count()
    per = max(cell_rows, rows // MOST_CELLS)
    bits = max(0, math.ceil(math.log2(max(rows, 1) / per)))
    placed = {"shard": shard_of.cast("int"), "cell": F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long")}
    counts = keys.withColumns(placed).groupBy("shard", "cell").count()
    full = materialize(counts.where(F.col("count") > 2 * per).select("shard", "cell", F.ceil(F.col("count") / per).alias("parts")), "shard-full")

    def dealt(table: DataFrame) -> DataFrame:
        return table.withColumns(placed).join(F.broadcast(full), ["shard", "cell"], "left").withColumn("cut", F.coalesce(F.pmod("z", "parts"), F.lit(0)))

    before = Window.partitionBy("shard").orderBy("cell", "cut").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt(keys).groupBy("shard", "cell", "cut").count()
    offsets = materialize(counts.select("shard", "cell", "cut", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")), "shard-offsets")
    within = Window.partitionBy("shard", "cell", "cut").orderBy("h", "id")
    out = dealt(keyed).withColumn("row", F.row_number().over(within)).join(F.broadcast(offsets), ["shard", "cell", "cut"])
    release(keys)
    return out.select(*plain, "shard", (F.col("offset") + F.col("row") - 1).alias("slot")).toDF(*names, "shard", "slot")
