"""Document fingerprints: one-permutation MinHash with packed low-order bits.

Every shingle is hashed once; its top bits choose one of ``BINS`` bins and each bin keeps the
smallest hash. Empty bins borrow from a non-empty one by optimal densification (a fixed
sequence of pseudo-random bins for each bin, the same for all documents, until a filled one
is met). ``BITS`` low bits of each bin are packed. Of two sketches with Jaccard similarity J a
share J + (1 - J) / 2**BITS of bins agrees by expectation, which :func:`likeness` inverts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import SLICE_BYTES, Numbered, map_arrow
from lattix.llm.text import Words, mix

BINS, BITS, SHINGLE = 256, 4, 5
_SHIFT = np.uint64(64 - (BINS - 1).bit_length())
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_PROBES = 4096
_LEAST = -(1 << 63)


def _probe(attempt: int) -> np.ndarray:
    """The bin that each bin tries at this attempt."""
    return (mix(np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> _SHIFT).astype(np.int64)


_probes: dict[int, np.ndarray] = {}


def sketches(texts: list[str]) -> np.ndarray:
    """A row of BINS low-bit values (uint8) for each text; texts without words get a row of 255."""
    w = Words(pa.array(texts, pa.large_string()), "space", lower=False)
    owner, hashes = w.shingles(SHINGLE)
    hashes = mix(hashes)
    least = np.full((len(texts), BINS), _EMPTY, np.uint64)
    np.minimum.at(least.reshape(-1), owner * BINS + (hashes >> _SHIFT).astype(np.int64), hashes)
    filled = least != _EMPTY
    void = ~filled.any(axis=1)
    row, col = np.nonzero(~filled & ~void[:, None])
    for attempt in range(_PROBES):
        if not len(row):
            break
        if attempt not in _probes:
            _probes[attempt] = _probe(attempt)
        source = _probes[attempt][col]
        good = filled[row, source]
        least[row[good], col[good]] = least[row[good], source[good]]
        row, col = row[~good], col[~good]
    for r, c in zip(row.tolist(), col.tolist(), strict=True):  # so unlikely a miss is filled from the next bin around
        least[r, c] = least[r, (c + np.argmax(np.roll(filled[r], -c))) % BINS]
    out = (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    out[void] = 255
    return out


def packed(sketch: np.ndarray) -> str:
    """Hex digits: ``01`` and the packed bits, or ``00`` alone for a text without words."""
    return "00" if sketch[0] == 255 else "01" + (sketch[0::2] << 4 | sketch[1::2]).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bias-corrected similarity of rows, within 0 and 1. Two texts without words are alike, one is unlike all others."""
    chance = 1 / (1 << BITS)
    est = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where((a[:, 0] == 255) != (b[:, 0] == 255), 0.0, np.where(a[:, 0] == 255, 1.0, est))


def _heads(rows: DataFrame, rows_per_range: int, most_ranges: int) -> list[tuple[int, int]]:
    """Ascending (id, hash of the text), each that of the first row of a range.

    Cuts are at about even shares of the ids, and within an id of more rows than a range at even steps of the
    hash; then the exact least row of every range is found. There are at most some ``2 * most_ranges``.
    """
    count = rows.count()
    if not count:
        return []
    per = max(rows_per_range, count // most_ranges)
    parts = max(1, count // per)
    near = rows.stat.approxQuantile("id", [k / parts for k in range(parts)], 0.2 / parts if parts > 1 else 0.0)
    cuts = {(min(max(int(c), _LEAST), (1 << 63) - 1), _LEAST) for c in near} | {(_LEAST, _LEAST)}
    for r in rows.groupBy("id").count().where(F.col("count") > 2 * per).collect():
        own = r["count"] // per
        cuts |= {(r.id, _LEAST + (k << 64) // own) for k in range(own)}
    found = rows.groupBy(_rank(sorted(cuts)).alias("range")).agg(F.min(F.struct("id", "th")).alias("m")).collect()
    return sorted((r.m.id, r.m.th) for r in found)


def successors(docs: DataFrame, rows_per_range: int = 2048, most_ranges: int = 20_000) -> tuple[DataFrame, int]:
    """Rows ``(range, wrap, doc_id, text, guest)`` such that each range, in order, holds its documents and the next one.

    One exchange by range of (doc_id, hash of the text). The first document of a range also goes, as a guest, to the
    range before it; the very first goes to the last range, behind all others.
    """
    table = Numbered(docs)
    rows = table.df.select(table["doc_id"].cast("long").alias("doc_id"), F.coalesce(table["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"id": F.coalesce("doc_id", F.lit(_LEAST)), "th": F.xxhash64("text")})
    heads = _heads(rows.select("id", "th"), rows_per_range, most_ranges)
    last = max(len(heads) - 1, 0)
    home = F.col("home")
    own = F.struct(home.alias("range"), F.lit(0).alias("wrap"), F.lit(False).alias("guest"))
    guests = []
    if heads:
        ids, hashes = _longs([h[0] for h in heads]), _longs([h[1] for h in heads])
        is_head = (F.get(ids, home) == F.col("id")) & (F.get(hashes, home) == F.col("th"))
        guests.append(F.when(is_head & (home > 0), F.struct((home - 1).alias("range"), F.lit(0).alias("wrap"), F.lit(True).alias("guest"))))
        guests.append(F.when(is_head & (home == 0), F.struct(F.lit(last).alias("range"), F.lit(1).alias("wrap"), F.lit(True).alias("guest"))))
    placed = rows.withColumn("home", F.greatest(F.lit(0), _rank(heads) - 1))
    spread = placed.withColumn("x", F.explode(F.filter(F.array(own, *guests), lambda x: x.isNotNull()))).select("x.range", "x.wrap", "doc_id", "text", "x.guest", "id", "th")
    # of equal rows at a head each is a guest; the first completes the range and the others are passed over
    ordered = spread.repartition(last + 1, "range").sortWithinPartitions("range", "wrap", "id", "th", "guest", F.asc_nulls_first("doc_id"), "text")
    return ordered.select("range", "wrap", "doc_id", "text", "guest"), last


def _longs(values: list[int]) -> Column:
    """A constant array, one literal of the plan however many values it has."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _rank(bounds: list[tuple[int, int]]) -> Column:
    """How many of the ascending (id, hash) pairs are at most the row's own, by binary search."""
    n = len(bounds)
    ids, hashes = _longs([b[0] for b in bounds]), _longs([b[1] for b in bounds])
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))])

    def below(at: Column) -> Column:
        return (F.get(ids, at) < F.col("id")) | ((F.get(ids, at) == F.col("id")) & (F.get(hashes, at) <= F.col("th")))

    return F.aggregate(strides, F.lit(0), lambda found, step: F.when((found + step <= n) & below(found + step - 1), found + step).otherwise(found))


def fingerprint(docs: DataFrame, rows_per_range: int = 2048) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of each row.

    The next document is the one with the next higher doc_id; after the last comes the first.
    The edited text has the last n_chars // 4 code points replaced by as many first ones of the
    next document (or all). A null text is an empty one. Null ids come before all others; rows
    that repeat an id follow each other in the order of a hash of their texts (XXH64, signed). A single row is its own
    next. Equal texts have equal fingerprints. An empty table gives no rows.
    """
    placed, _ = successors(docs, rows_per_range)

    def batch_of(rows: list[tuple[int | None, str]], following: list[str]) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        cut = [len(t) // 4 for t in texts]
        edited = [t[: len(t) - q] + f[:q] if q else t for t, q, f in zip(texts, cut, following, strict=True)]
        where, more = {id(t): k for k, t in enumerate(texts)}, []  # most next texts are rows themselves
        for f in following:
            if id(f) not in where:
                where[id(f)] = len(texts) + len(more)
                more.append(f)
        own, other = sketches([*texts, *more]), sketches(edited)
        follows = np.array([where[id(f)] for f in following])
        mine = own[: len(texts)]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array([packed(s) for s in mine]), pa.array([packed(s) for s in other]), pa.array(likeness(mine, other)), pa.array(likeness(mine, own[follows]))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: tuple[int, int | None, str] | None = None
        rows: list[tuple[int | None, str]] = []
        following: list[str] = []
        held = 0
        for batch in batches:
            for place, doc_id, text, guest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), strict=True):
                text = text.as_py()
                if pending is not None and pending[0] == place:
                    rows.append(pending[1:])
                    following.append(text)
                    held += len(text)
                    pending = None
                    if held > SLICE_BYTES or len(rows) >= 1024:
                        yield batch_of(rows, following)
                        rows, following, held = [], [], 0
                pending = None if guest else (place, doc_id, text)
        if rows:
            yield batch_of(rows, following)

    return map_arrow(placed, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
