"""Benchmark decontamination: a prefix-filtered set join of item windows with document shingles.

An item's words are cut into windows of ``width`` consecutive words (an item of fewer words is one
window), and a window is the set of its shingles of ``SHINGLE`` words. It occurs in a document only if
all its shingles do, so a prefix of one is enough once shingles are ordered by rarity: the rarest is joined.

The documents are read once. A filter of all window shingles (of bounded size) finds their runs of
consecutive known shingles; a run shorter than the shortest window is out by the length bound. Equal runs, of
copies, go on as one. Their shingles are counted over all documents, each window takes its rarest
as prefix, and the prefixes are joined by exchange. The position of the shared shingle places the whole window,
which must lie inside the run (positional bound), and then the words themselves must agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import Numbered, attach, map_arrow, meet, slices
from lattix.llm.text import Words
from lattix.plans.storage import materialize, release

WIDTH, SHINGLE = 13, 5
#: Most bits of the shingle filter (32 MB). A benchmark of more than 20 million distinct shingles makes it less
#: selective, so more runs are exchanged; what is found stays the same.
FILTER_BITS = 1 << 28
#: Shingles of one piece of a run. Longer runs go on in pieces that overlap by a window.
PIECE = 4096


def item_windows(items: DataFrame, width: int, shingle: int) -> DataFrame:
    """``(win, item_id, text, gram, tokens)``: each distinct window of an item, its words, shingle size and shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(1)):
                w, out = Words(part, "alnum"), []
                runs = w.runs()
                for k in range(w.n):
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    if a == b:
                        continue
                    size = min(width, b - a)
                    gram = min(shingle, size)
                    hashes = Words.window(runs, np.arange(a, b - gram + 1), gram).view(np.int64)
                    seen = set()
                    for s in range(a, b - size + 1):
                        text = w.text(s, s + size)
                        if (win := xxhash.xxh3_128_hexdigest(text)) not in seen:
                            seen.add(win)
                            out.append((win, batch.column(0)[at + k].as_py(), text.decode("utf-8", "replace"), gram, hashes[s - a : s - a + size - gram + 1]))
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["win", "item_id", "text", "gram", "tokens"])

    named = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(named, run, "win string, item_id string, text string, gram int, tokens array<long>")


class Filter:
    """A Bloom filter of two probes over 64-bit hashes; its size is a power of two."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    @classmethod
    def of(cls, tokens: DataFrame, count: int, most: int = FILTER_BITS) -> Filter:
        """Built by a grouped bit-or, so that the driver sees words of the filter only."""
        bits = 1 << 12
        while bits < min(16 * count, most):
            bits *= 2
        slots = tokens.select(F.explode(F.array(F.col("token").bitwiseAND(bits - 1), F.shiftrightunsigned("token", 36).bitwiseAND(bits - 1))).alias("s"))
        got = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
        return cls(words)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """True for every hash in the filter and few others."""
        out = self._test(hashes & self.mask)
        some = np.flatnonzero(out)
        out[some] = self._test((hashes[some] >> np.uint64(36)) & self.mask)
        return out

    def _test(self, slot: np.ndarray) -> np.ndarray:
        return ((self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


_RUNS = "n_words long, text_key string, runs array<struct<piece:string,start:long,text:string,gram:int,tokens:array<long>>>"


def _finder(known: Filter, grams: dict[int, tuple[int, int]]):
    """Kernel: the runs of known shingles of each text. ``grams``: shingle size -> fewest and most shingles of a window."""
    kind = pa.list_(pa.struct([("piece", pa.string()), ("start", pa.int64()), ("text", pa.string()), ("gram", pa.int32()), ("tokens", pa.list_(pa.int64()))]))

    def kernel(part: pa.Array) -> list[pa.Array]:
        w = Words(part, "alnum")
        found: list[list | None] = [None] * w.n
        total, sums = len(w.hash), w.runs() if grams else None
        for gram, (least, most) in grams.items():
            if total < gram:
                continue
            at = np.arange(total - gram + 1)
            inside = at + gram <= w.first[w.doc[at] + 1]
            tokens = Words.window(sums, at, gram)
            hit = np.append(known(tokens) & inside, False)
            fresh = np.append(True, w.doc[at[1:]] != w.doc[at[:-1]])
            begins = np.flatnonzero(hit[:-1] & (fresh | ~np.append(False, hit[:-2])))
            ends = np.flatnonzero(hit[:-1] & (np.append(fresh[1:], True) | ~hit[1:])) + 1
            long = ends - begins >= least
            for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
                d = int(w.doc[a])
                found[d] = found[d] or []
                for s in range(a, max(b - most + 1, a + 1), PIECE):
                    e = min(s + PIECE + most - 1, b)
                    text = w.text(s, e + gram - 1)
                    found[d].append({"piece": xxhash.xxh3_128_hexdigest(text, gram), "start": s - int(w.first[d]), "text": text.decode("utf-8", "replace"), "gram": gram, "tokens": tokens[s:e].view(np.int64)})
        keys = [xxhash.xxh3_128_hexdigest(part[d].as_buffer()) if runs else None for d, runs in enumerate(found)]
        return [pa.array(w.counts().astype(np.int64)), pa.array(keys, pa.string()), pa.array(found, kind)]

    return kernel


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Disjoint spans in order, and the longest window, in place of all spans of a text."""
    for batch in batches:
        spans, longest = [], []
        for row in batch.column(1).to_pylist():
            pairs = np.array(sorted((x["a"], x["b"]) for x in row), np.int64).reshape(-1, 2)
            upto = np.maximum.accumulate(pairs[:, 1])
            head = np.append(True, pairs[1:, 0] > upto[:-1])
            at = np.flatnonzero(head)
            spans.append([{"start": s, "end": e} for s, e in zip(pairs[at, 0].tolist(), upto[np.append(at[1:] - 1, len(pairs) - 1)].tolist(), strict=True)])
            longest.append(int((pairs[:, 1] - pairs[:, 0]).max()))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(longest, pa.int64())], ["text_key", "hit_spans", "longest_window"])


def window_hits(pieces: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """``(piece, a, b, win)``: the verified places of windows in pieces of runs.

    ``pieces`` has piece, text, gram, tokens and times (how many documents hold it); ``windows`` has
    win, text, gram and tokens.
    """
    placed = F.transform(
        F.sequence(F.lit(0), F.size("tokens") - 1),
        lambda p: F.struct(p.alias("pos"), F.get("tokens", p).alias("token"), F.slice("words", F.greatest(p - width, F.lit(0)) + 1, F.least(p, F.lit(width)) + width).alias("near")),
    )
    tokens = pieces.withColumn("words", F.split("text", " ")).select("piece", "gram", "times", F.size("tokens").alias("n"), F.explode(placed).alias("x")).select("piece", "gram", "times", "n", "x.*")
    counts = tokens.groupBy("token").agg(F.sum("times").alias("times"))
    # a window with a shingle that no document holds can't occur; the others take the rarest, the first of equals
    seen = windows.select("win", F.posexplode("tokens").alias("off", "token")).join(counts, "token").groupBy("win").agg(F.count("*").alias("all"), F.min(F.struct("times", "off", "token")).alias("prefix"))
    prefix = windows.join(seen, "win").where(F.col("all") == F.size("tokens")).select("win", F.col("text").alias("wanted"), F.col("gram").alias("g"), F.size("tokens").alias("size"), "prefix.off", "prefix.token")
    near = tokens.join(prefix, "token").where("gram = g and pos >= off and pos - off + size <= n")
    words = F.col("size") + F.col("g") - 1
    same = F.array_join(F.slice("near", F.least("pos", F.lit(width)) - F.col("off") + 1, words), " ") == F.col("wanted")
    a = (F.col("pos") - F.col("off")).cast("long")
    return near.where(same).select("piece", a.alias("a"), (a + words).alias("b"), "win").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``n_words``, ``hit_spans``, ``item_ids`` and ``longest_window`` of each whole text.

    ``items`` has item_id and text. Words are runs of ASCII letters, digits and all characters
    above U+007F, with A-Z lower-cased. hit_spans are disjoint word ranges ``[start, end)`` inside
    an occurrence of some window; item_ids are the items with occurring windows, as sorted strings;
    longest_window counts the words of the longest window that occurs (0 if none does).
    A null or empty document has no words, no spans and no items; an item with a null id, a null
    text or no words has no window; rows that repeat an item count once. Without items every
    document is clean. Columns of docs with the names of results, in any case, are replaced.
    """
    table = Numbered(docs)
    every = materialize(item_windows(items, width, shingle), "decontam-items")
    windows = materialize(every.groupBy("win").agg(*[F.first(c).alias(c) for c in ("text", "gram", "tokens")]), "decontam-windows")
    tokens = windows.select("gram", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    sizes = tokens.groupBy("gram").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.approx_count_distinct("token").alias("distinct")).collect()
    grams = {r.gram: (r.least, r.most) for r in sizes}
    known = Filter.of(tokens, sum(r.distinct for r in sizes))

    results = ("n_words", "hit_spans", "item_ids", "longest_window")
    held, plain, names = table.plain(results, keep)
    source = table.df.select(*held, table["text"].alias("source_text"))
    marked = materialize(attach(source, lambda: _finder(known, grams), _RUNS, plain, text="source_text"), "decontam-marked")
    loud = marked.where("text_key is not null")
    runs = materialize(loud.groupBy("text_key").agg(F.count("*").alias("times"), F.first("runs").alias("runs")).select("text_key", "times", F.inline("runs")), "decontam-runs")
    pieces = materialize(runs.groupBy("piece").agg(*[F.first(c).alias(c) for c in ("text", "gram", "tokens")], F.sum("times").alias("times"), F.count("*").alias("places")), "decontam-pieces")
    hits = window_hits(pieces, windows, width).groupBy("piece").agg(F.collect_list(F.struct("a", "b", "win")).alias("hits"))
    hits = materialize(hits.join(pieces.select("piece", "places"), "piece"), "decontam-places")  # read more than once by the meeting
    met = meet(runs.select("text_key", "piece", "start"), hits, ["piece"], "places")
    placed = materialize(met.select("text_key", "start", F.inline("hits")).select("text_key", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"), "win"), "decontam-hits")
    spans = map_arrow(placed.groupBy("text_key").agg(F.collect_set(F.struct("a", "b")).alias("spans")), _merged, "text_key string, hit_spans array<struct<start:long,end:long>>, longest_window long")
    owned = placed.select("text_key", "win").distinct().join(every.select("win", "item_id").distinct(), "win").select("text_key", "item_id").distinct()
    listed = owned.groupBy("text_key").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    copies = runs.select("text_key", "times").distinct()
    found = materialize(spans.join(listed, "text_key").join(copies, "text_key"), "decontam-found")
    release(every, windows, runs, pieces, hits, placed)

    no_spans, no_items = F.array().cast("array<struct<start:long,end:long>>"), F.array().cast("array<string>")
    quiet = marked.where("text_key is null").select(*plain, "n_words", no_spans.alias("hit_spans"), no_items.alias("item_ids"), F.lit(0).cast("long").alias("longest_window"))
    rest = meet(loud.drop("runs"), found, ["text_key"], "times", "left")
    rest = rest.select(*plain, "n_words", F.coalesce("hit_spans", no_spans).alias("hit_spans"), F.coalesce("item_ids", no_items).alias("item_ids"), F.coalesce("longest_window", F.lit(0)).alias("longest_window"))
    return quiet.unionByName(rest).toDF(*names, *results)


def digest(found: DataFrame, share: int = 20) -> DataFrame:
    """``found`` with ``n_hit, n_items, items_sha256, contaminated`` (at least one word in ``share`` is hit) in place of columns so named in any case."""
    results = ("n_hit", "n_items", "items_sha256", "contaminated")
    out = found.drop(*[c for c in found.columns if c.lower() in results])
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.withColumns({"n_hit": hit, "n_items": F.size("item_ids").cast("long"), "items_sha256": F.sha2(F.array_join("item_ids", ","), 256)}).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
