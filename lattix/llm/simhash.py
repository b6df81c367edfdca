"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into ``d // 2 + 1`` segments. Two fingerprints that differ in at
most ``d`` bits then agree on some segment up to one bit, so the segment is indexed under
each of its one-wildcard variants (one bit cleared): equal variants are the candidates,
found by one hash exchange, and the exact Hamming distance verifies them. Two segments of
32 bits serve d = 2 and d = 3 alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.llm.common import Numbered, attach, map_arrow, slices
from lattix.llm.xxh64 import xxh64
from lattix.operators.components import connected_components
from lattix.plans.storage import materialize, release

#: Largest group of equal variants that is compared pair by pair. Members of larger groups are
#: linked through two-wildcard (for d = 3: three-wildcard) variants, which is exact as well.
GROUP = 48


def _byte_table() -> np.ndarray:
    """Bytes as they are hashed: A-Z lower-cased, 0x09-0x0D as the blank 0x20."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9:14] = 32
    return table


_HASHED = _byte_table()
_LANES = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many hashes of each run of ``sizes`` (none zero) have each of the 64 bits.

    Eight counters share a 64-bit word, a byte each, so up to 255 hashes are added before these are unpacked.
    """
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    within = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    at = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * within
    ones = np.empty((len(sizes), 8, 8), np.int64)
    for k in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, at)
        ones[:, :, k] = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    return ones.reshape(-1, 64)


def simhashes(part: pa.Array, width: int = 3) -> np.ndarray:
    """Fingerprints of a slice of texts (large strings without nulls): a bit is set if it is set in over half the shingle hashes."""
    n, out = len(part), np.zeros(len(part), np.uint64)
    _, offsets, data = part.buffers()
    if not n or data is None:
        return out
    bounds = np.frombuffer(offsets, np.int64, n + 1, part.offset * 8)
    raw = _HASHED[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    raw = np.insert(raw, bounds[1:], 32)  # a blank after each text
    inside = raw != 32
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    counts = np.add.reduceat(head, bounds[:-1] + np.arange(n), dtype=np.int64)
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    raw = raw[keep]  # every word and one blank
    end = np.flatnonzero(raw == 32)
    start = np.append(0, end[:-1] + 1)
    last, own = np.repeat(np.cumsum(counts), counts), np.repeat(counts, counts)
    at = np.arange(len(end))
    begins = np.flatnonzero((at + width <= last) | ((own < width) & (at == last - own)))
    hashes = xxh64(raw, start[begins], end[np.minimum(begins + width, last[begins]) - 1], 42)
    some = np.flatnonzero(counts)
    sizes = np.maximum(counts[some] - width + 1, 1)
    if len(some):
        out[some] = np.packbits(2 * _bit_counts(hashes, sizes) > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the signed 64-bit carrier of each whole text's SimHash. A null text is an empty one (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, np.uint64)
            for at, part in slices(batch.column(1)):
                out[at : at + len(part)] = simhashes(part, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    table = Numbered(docs)
    return map_arrow(table.df.select(table["doc_id"].cast("long").alias("doc_id"), table["text"].cast("string").alias("text")), run, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """``(lowest bit, width)`` of each segment."""
    count = distance // 2 + 1
    edges = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """``(slot, part, fp)``: slot numbers the wildcard bit, part is that bit's segment with the bit cleared."""
    rows = []
    for low, width in segments(distance):
        for bit in range(low, low + width):
            keep = ((1 << width) - 1) << low & ~(1 << bit)
            rows.append(F.struct(F.lit(bit).cast("byte").alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(keep))).alias("part")))
    return fps.select("fp", F.explode(F.array(*rows)).alias("x")).select("x.slot", "x.part", "fp")


def _slot_of(diff: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """The one variant under which a pair with these differing bits is reported: first segment with at most one of them."""
    slot = np.full(len(diff), 255, np.uint8)
    for low, width in reversed(cuts):
        part = (diff >> np.uint64(low)) & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(part)
        bit = np.bitwise_count((part & (~part + np.uint64(1))) - np.uint64(1))
        slot = np.where(ones == 0, low, np.where(ones == 1, low + bit, slot)).astype(np.uint8)
    return slot


def _match(distance: int, group: int):
    """Streams rows sorted by (slot, part): verified pairs, and (fp, fp) for each member of a group that is too large."""
    cuts = segments(distance)

    def closed(slot: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        head = np.concatenate([[True], (slot[1:] != slot[:-1]) | (part[1:] != part[:-1])]) if len(fp) else np.zeros(0, bool)
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(fp)))
        big = np.repeat(size > group, size)
        left, right = [fp[big]], [fp[big]]
        slot, part, fp = slot[~big], part[~big], fp[~big]
        for lag in range(1, group):
            near = np.flatnonzero((part[lag:] == part[:-lag]) & (slot[lag:] == slot[:-lag])) if len(fp) > lag else np.zeros(0, int)
            if not len(near):
                break
            a, b = fp[near], fp[near + lag]
            diff = (a ^ b).view(np.uint64)
            good = (np.bitwise_count(diff) <= distance) & (_slot_of(diff, cuts) == slot[near])
            left.append(np.minimum(a[good], b[good]))
            right.append(np.maximum(a[good], b[good]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = (np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64))
        flooded = None
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            slot, part, fp = (np.concatenate([h, x]) for h, x in zip(held, new, strict=True))
            if not len(fp):
                continue
            if flooded is not None:  # the open group has been reported as too large so far
                same = (slot == flooded[0]) & (part == flooded[1])
                n = int(same.argmin()) if not same.all() else len(same)
                yield pa.RecordBatch.from_arrays([pa.array(fp[:n])] * 2, ["a", "b"])
                slot, part, fp = slot[n:], part[n:], fp[n:]
                if not len(fp):
                    held = (slot, part, fp)
                    continue
                flooded = None
            tail = int(((slot == slot[-1]) & (part == part[-1])).argmax())
            yield closed(slot[:tail], part[:tail], fp[:tail])
            held = (slot[tail:], part[tail:], fp[tail:])
            if len(held[2]) > group:
                flooded = (held[0][0], held[1][0])
                yield pa.RecordBatch.from_arrays([pa.array(held[2])] * 2, ["a", "b"])
                held = tuple(x[:0] for x in held)
        if len(held[2]):
            yield closed(*held)

    return run


def _wild_masks(distance: int) -> list[int]:
    """Masks with any ``distance`` bits cleared; fingerprints within the distance agree under one of them."""
    from itertools import combinations

    full = (1 << 64) - 1
    return [_signed(full & ~sum(1 << b for b in bits)) for bits in combinations(range(64), distance)]


def links(fps: DataFrame, distance: int = 2, group: int = GROUP) -> DataFrame:
    """``(src, dst)`` between distinct fingerprints: the same connected classes as all pairs within ``distance``.

    ``fps`` holds distinct values in column fp. Groups of up to ``group`` equal variants are
    compared within; no task ever holds more than that of one group. Members of larger groups
    go through variants with ``distance`` wildcards: each such group has at most 2**distance
    members, all within the distance, and is linked to its smallest member.
    """
    spread = fps.repartition(fps.sparkSession.sparkContext.defaultParallelism)  # 64 rows are made of each, so in more tasks than its few files give
    sorted_ = variants(spread, distance).repartition("slot", "part").sortWithinPartitions("slot", "part")
    found = materialize(map_arrow(sorted_, _match(distance, group), "a long, b long"), "simhash-links")
    crowded = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    masks = F.array(*[F.lit(m) for m in _wild_masks(distance)]) if distance <= 2 else _masks3()
    spread = crowded.select("fp", F.posexplode(masks).alias("slot", "mask")).select("fp", "slot", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
    stars = spread.select(F.min("fp").over(Window.partitionBy("slot", "part")).alias("src"), F.col("fp").alias("dst")).where("src <> dst").distinct()
    return found.where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst")).union(stars)


def _masks3():
    """All masks with three cleared bits, made by Spark itself (41 664 of them would bloat the plan)."""
    return F.expr(
        "flatten(transform(sequence(0, 61), a -> flatten(transform(sequence(a + 1, 62), b -> transform(sequence(b + 1, 63), c -> "
        "~(shiftleft(1L, a) | shiftleft(1L, b) | shiftleft(1L, c)))))))"
    )


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, group: int = GROUP) -> DataFrame:
    """``(doc_id, fp, component_id, class_fp)`` for each row of ``docs``.

    class_fp names the class by its smallest fingerprint; component_id is the smallest doc_id reachable through fingerprints that differ in at most
    ``distance`` bits. Texts without words share fingerprint zero and link like any other; a null
    text counts as empty. Rows that repeat a doc_id are one node and come back once each; a null
    doc_id takes part with component null unless its class has an id. An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, width), "simhash-fp")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    pairs = materialize(links(nodes.select("fp"), distance, group), "simhash-pairs")
    found = connected_components(pairs)
    linked = nodes.join(found.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = nodes.join(linked.join(least, "component").select("fp", "component", "component_id"), "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("component", "fp").alias("class_fp"))
    classes = materialize(classes, "simhash-named")
    release(pairs, nodes)
    # fingerprints of many copies meet their rows by broadcast, the others by exchange. Those above one row in
    # ten thousand are fewer than ten thousand, however large the table
    often = max(marked.count() // 10_000, 500)
    many, few = classes.where(F.col("n") > often).drop("n"), classes.where(F.col("n") <= often).drop("n")
    copied = marked.join(F.broadcast(many), "fp")
    single = marked.join(F.broadcast(many.select("fp")), "fp", "left_anti").join(few, "fp")
    return copied.unionByName(single).select("doc_id", "fp", "component_id", "class_fp")


def keep_one(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the document with the smallest id stays.

    Of rows that repeat that id one stays. A class without any id keeps one of its rows. The text
    moves once, to meet the ids that stay.
    """
    table = Numbered(docs)
    docs = table.shielded("doc_id", "text")
    found = materialize(near_duplicates(docs, width, distance), "simhash-classes")
    stay = found.where("component_id is not null").select(F.col("component_id").alias("doc_id")).distinct()
    kept = docs.join(stay, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    nameless = found.where("component_id is null").select(F.col("fp").alias("__nameless"), F.col("class_fp").alias("__class")).distinct()
    if not nameless.limit(1).count():
        return kept.toDF(*table.names)
    lost = docs.where("doc_id is null")
    marked = attach(lost, lambda: lambda part: [pa.array(simhashes(part, width).view(np.int64))], "__fp long")
    return kept.unionByName(marked.join(nameless, F.col("__fp") == F.col("__nameless")).dropDuplicates(["__class"]).select(*docs.columns)).toDF(*table.names)
