"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each slot holds a bitmask over languages, and
the AND of an n-gram's slots has a bit for every language whose filter contains it, found by
one lookup whatever the number of languages. Popcounts per language over a text are corrected
for the filter's false positives, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.llm.common import Numbered, attach, held_out, map_arrow, slices
from lattix.plans.storage import materialize, release

SIZES = (3, 4)
#: Parameters of the model: rows fitted on (in all, shared out by language), most n-grams kept for a
#: language and the share of its sampled texts that each is in, slots of the filter, probes of each n-gram.
FIT_ROWS, GRAMS, GRAM_SHARE, SLOT_BITS, PROBES = 8_000, 20_000, 0.004, 19, 3
#: A language keeps an n-gram whose share of its texts is at least this much of the highest share in any language.
RELATIVE = 0.25
_SPREAD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))

_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once in each process."""
    if not _table:
        _table.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _table[0]


def grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """``(owning text, hash)`` of the n-grams for each size, and the letters of each text.

    Texts are lower-cased; every run of other characters, and each end of a text, is one blank.
    """
    lowered = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of blanks the first stays
    keep[starts] = True
    kept = np.add.reduceat(keep, starts, dtype=np.int64) if len(starts) else sizes
    letters = np.add.reduceat(letter, starts, dtype=np.int64) if len(starts) else sizes
    codes = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), kept)
    last = np.repeat(np.cumsum(kept), kept)
    at, out, h = np.arange(len(codes)), [], None
    for n in range(1, max(SIZES) + 1):
        part = codes[n - 1 :] * _SPREAD[n - 1]
        h = part if h is None else h[: len(part)] + part
        if n in SIZES:
            whole = at[: len(h)] + n <= last[: len(h)]
            mixed = (h[whole] ^ (h[whole] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            out.append((owner[: len(h)][whole], mixed))
    return out, letters


class Model:
    """Languages, their bit-sliced filter (a byte of each slot for every eight) and its false-positive rates."""

    def __init__(self, sets: dict[str, np.ndarray], prior: dict[str, int]):
        self.langs = sorted(sets)
        self.table = np.zeros((max(1, -(-len(self.langs) // 8)), 1 << SLOT_BITS), np.uint8)
        rate = []
        for k, lang in enumerate(self.langs):
            row, bit = self.table[k // 8], np.uint8(1 << k % 8)
            for slot in self.slots(sets[lang]):
                row[slot] |= bit
            rate.append(float(((row & bit) != 0).mean()) ** PROBES)
        self.false = np.array(rate)
        total = max(sum(prior.values()), 1)
        self.tie = np.array([1e-6 * prior.get(x, 0) / total for x in self.langs])
        self.common = max(self.langs, key=lambda x: (prior.get(x, 0), x)) if self.langs else "und"

    @staticmethod
    def slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(PROBES):
            yield (hashes >> np.uint64(64 - SLOT_BITS * (k + 1))) & np.uint64((1 << SLOT_BITS) - 1) if k else hashes >> np.uint64(64 - SLOT_BITS)

    def popcounts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of n-grams contained per language, n-grams of each text, letters of each text."""
        found, letters = grams(texts)
        n, counts = np.zeros(len(texts), np.int64), np.zeros((len(texts), 8 * len(self.table)), np.int64)
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        for owner, hashes in found:
            n += np.bincount(owner, minlength=len(texts))
            slots = list(self.slots(hashes))
            for k, row in enumerate(self.table):
                mask = row[slots[0]]
                for slot in slots[1:]:
                    mask &= row[slot]
                cells = np.bincount((owner.astype(np.int64) << 8) | mask, minlength=256 * len(texts))
                counts[:, 8 * k : 8 * k + 8] += cells.reshape(len(texts), 256) @ bits
        return counts[:, : len(self.langs)], n, letters

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        hits, n, letters = self.popcounts(texts)
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        true = np.clip((hits - n[:, None] * self.false) / (1 - self.false), 0, None)
        best = (true + self.tie).argmax(axis=1)
        top = true.max(axis=1)
        score = 1 / np.exp(np.clip(true - top[:, None], -50, 0)).sum(axis=1)
        lang = ["und" if not k else self.langs[b] if t > 0 else self.common for k, b, t in zip(letters, best, top, strict=True)]
        return lang, np.where((letters > 0) & (top > 0), score, 0.0).tolist()


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn from rows that have an id, a text and a lang and are not held out.

    At most about ``rows`` of them in all, an equal share for each language, chosen by a hash of
    the id. The n-grams in most documents of the sample make up a language's filter, ``GRAMS`` at most; of those
    in as many documents as the last one, a hash chooses. Two documents must share an n-gram, unless
    the language has three or fewer.
    """
    table = Numbered(docs)
    known = table.df.select(table["doc_id"].alias("doc_id"), table["lang"].cast("string").alias("lang"), table["text"].cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    prior = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(prior)
    if not langs:
        return Model({}, {})
    part = rows / len(langs)
    spark = docs.sparkSession
    shares = spark.createDataFrame([(x, k, part / prior[x]) for k, x in enumerate(langs)], "lang string, number int, share double")
    pick = (F.col("share") >= 1) | (F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < F.floor(F.col("share") * (1 << 30)))
    chosen = known.join(F.broadcast(shares), "lang").where(pick).select("number", "text")
    number = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, piece in slices(batch.column(1), 1 << 20):
                found, _ = grams(piece.to_pylist())
                owner, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((hashes, owner))
                owner, hashes = owner[order], hashes[order]
                first = np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])) if len(owner) else np.zeros(0, bool)
                lang, gram = own[at + owner[first]], hashes[first]
                for k in np.unique(lang).tolist():
                    value, n = np.unique(gram[lang == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k, np.int32)), pa.array(value.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = map_arrow(chosen, run, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # texts quote other languages: an n-gram belongs to those where it is nearly as common as where it is most common
    sizes = {k: float(min(part, prior[x])) for k, x in enumerate(langs)}
    size = F.broadcast(spark.createDataFrame(list(sizes.items()), "lang int, size double"))
    rate = F.col("n") / F.col("size")
    common = counts.join(size, "lang").withColumn("most", F.max(rate).over(Window.partitionBy("gram"))).where(rate >= RELATIVE * F.col("most"))
    counts = materialize(common.select("lang", "gram", "n"), "language-grams")
    above: dict[int, list[tuple[int, int]]] = {}
    for r in counts.groupBy("lang", "n").count().collect():
        above.setdefault(r.lang, []).append((r.n, r["count"]))
    bounds = []  # language, least count kept whole, and the share kept of the count below that
    for k, rows_of in above.items():
        floor = max(2 if sizes[k] > 3 else 1, round(GRAM_SHARE * sizes[k]))
        held, least, share = 0, floor, 0.0
        for n, c in sorted(rows_of, reverse=True):
            if n < floor:
                break
            if held + c > GRAMS:
                least, share = n + 1, (GRAMS - held) / c
                break
            held += c
        bounds.append((k, least, share))
    wanted = counts.join(F.broadcast(spark.createDataFrame([(k, n, float(s)) for k, n, s in bounds], "lang int, least long, share double")), "lang")
    tie = (F.col("n") == F.col("least") - 1) & (F.pmod(F.xxhash64("gram"), F.lit(1 << 30)) < F.floor(F.col("share") * (1 << 30)))
    got = wanted.where((F.col("n") >= F.col("least")) | tie).select("lang", "gram").toArrow()
    release(counts)
    lang, gram = got.column("lang").to_numpy(), got.column("gram").to_numpy().view(np.uint64)
    return Model({x: gram[lang == number[x]] for x in langs}, prior)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score``.

    The score is the winner's share when each corrected n-gram counts one nat: 1 for long texts of
    one language, less the more languages contain nearly as much of the text.

    A null text or one without letters gives ``und`` and 0; letters that no filter knows give the
    commonest learnt language and 0. Ties go to the language with more learnt rows, then to the first in order. A model without
    languages always answers ``und``. Rows are independent, so repeated ones get equal answers.
    """

    def make():
        def kernel(part: pa.Array) -> list[pa.Array]:
            lang, score = model.predict(part.to_pylist())
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

        return kernel

    return attach(docs, make, "lang_pred string, score double", keep)
