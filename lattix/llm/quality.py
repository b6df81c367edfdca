"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Each feature i has a weight w_i and a vector v_i of ``RANK`` numbers; a text scores
w_0 + sum w_i x_i + sum over pairs of <v_i, v_j> x_i x_j. The pair term is computed in linear time
as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), over all words of a slice of texts at
once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import Numbered, attach, labelled_sample, map_arrow, sampled, slices
from lattix.llm.text import Words
from lattix.plans.storage import materialize, release

THRESHOLD = 0.7
#: Parameters of the model: expected labelled rows fitted on, hashed word features, rank, passes.
FIT_ROWS, WORD_BITS, RANK, EPOCHS, BATCH, RATE = 6_000, 15, 8, 8, 64, 0.06
#: Most feature values (in expectation) that the sample brings to the driver, 8 bytes each: long texts make a smaller sample.
FIT_VALUES = 10_000_000
STATS = (
    "length", "words", "word length", "upper", "digits", "punctuation", "blanks", "line breaks", "above ASCII",
    "distinct words", "distinct neighbours", "top word", "longest word", "distinct lines", "letters",
)
#: Upper bounds of a statistic's one-hot steps, for those that are shares and for those that are logarithms.
STEPS = 12


def statistics(w: Words, texts: pa.Array) -> np.ndarray:
    """A row of structure statistics, each within 0 and 1, for each text."""
    raw, n = w.raw, w.n
    size, words = np.diff(w.bounds), w.counts()

    def share(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask)])
        return (run[w.bounds[1:]] - run[w.bounds[:-1]]) / np.maximum(size, 1)

    def distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((value, owner))
        o, v = owner[order], value[order]
        first = np.append(True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])) if len(o) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        runs = np.diff(np.append(at, len(o)))
        top = np.zeros(n, np.int64)
        np.maximum.at(top, o[at], runs)
        return np.bincount(o[at], minlength=n), top

    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    digit, blank, high = (raw >= 48) & (raw <= 57), (raw == 32) | ((raw >= 9) & (raw <= 13)), raw >= 128
    punct = ~(upper | lower | digit | blank | high)
    kinds, top = distinct(w.doc, w.hash)
    inner = w.doc[1:] == w.doc[:-1]
    pairs, _ = distinct(w.doc[1:][inner], w.hash[1:][inner] * np.uint64(3) + w.hash[:-1][inner])
    lengths = w.end - w.start
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.doc, lengths)
    total = np.bincount(w.doc, weights=lengths, minlength=n)
    breaks = raw == 10
    line_of = np.concatenate([[0], np.cumsum(breaks)])[w.start] + w.doc  # lines never span texts
    run = w.runs()
    if len(w.hash):
        heads = np.flatnonzero(np.append(True, (line_of[1:] != line_of[:-1]) | (w.doc[1:] != w.doc[:-1])))
        line_hash = Words.window(run, heads, np.diff(np.append(heads, len(w.hash))))
        lines = np.bincount(w.doc[heads], minlength=n)
        line_kinds, _ = distinct(w.doc[heads], line_hash)
    else:
        lines = line_kinds = np.zeros(n, np.int64)
    one = np.maximum(words, 1)
    return np.stack(
        [
            np.log1p(size) / 16, np.log1p(words) / 14, np.minimum(total / one / 20, 1), share(upper), share(digit), share(punct), share(blank), np.minimum(share(breaks) * 10, 1), share(high),
            kinds / one, pairs / np.maximum(words - 1, 1), top / one, np.log1p(longest) / 12, line_kinds / np.maximum(lines, 1), share(upper | lower | high),
        ],
        axis=1,
    )


def features(texts: pa.Array, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owning text, feature, value)``, each text's features once and the word part of length one.

    Words are hashed with their case; a statistic or metadata value gives its step (one-hot)
    and, for statistics, its value as well.
    """
    w = Words(texts, "space", lower=False)
    word = (w.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key = np.sort((w.doc << WORD_BITS) | word)
    first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(key)))
    owner, feature, value = key[at] >> WORD_BITS, key[at] & ((1 << WORD_BITS) - 1), np.log1p(times)
    norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=w.n))
    value = value / np.maximum(norm[owner], 1e-12)
    dense = statistics(w, texts)
    extra = [np.minimum(np.log1p(np.maximum(m, 0)) / 16, 1) for m in meta]
    columns = np.column_stack([dense, *extra]) if extra else dense
    base, k = 1 << WORD_BITS, columns.shape[1]
    rows = np.repeat(np.arange(w.n), k)
    step = np.minimum((columns * STEPS).astype(np.int64), STEPS - 1) + np.arange(k) * STEPS + base
    level = np.tile(np.arange(k) + base + k * STEPS, w.n)
    owner = np.concatenate([owner, rows, rows])
    feature = np.concatenate([feature, step.reshape(-1), level])
    value = np.concatenate([value, np.full(w.n * k, 0.5), columns.reshape(-1)])
    order = np.argsort(owner, kind="stable")
    return owner[order], feature[order], value[order]


class Machine:
    """The factorisation machine."""

    def __init__(self, size: int, seed: int = 1):
        self.bias, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, RANK))

    def raw(self, owner: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and sum_i v_i x_i of each text; rows are sorted by owner."""
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        out, sums = np.full(n, self.bias), np.zeros((n, RANK))
        if len(owner):
            rows = owner[starts]
            vx = self.v[feature] * value[:, None]
            sums[rows] = np.add.reduceat(vx, starts)
            out[rows] += np.add.reduceat(self.w[feature] * value, starts) + 0.5 * ((sums[rows] ** 2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
        return out, sums

    def score(self, texts: pa.Array, meta: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(texts, meta), len(texts))[0], -30, 30)))

    def train(self, owner: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, seed: int = 2, shrink: float = 2e-4) -> None:
        """Adagrad on the logistic loss, in small batches of texts in a seeded order."""
        rng, first = np.random.default_rng(seed), np.searchsorted(owner, np.arange(len(y) + 1))
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        gw, gv, gb = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                docs = order[at : at + BATCH]
                count = first[docs + 1] - first[docs]
                rows = np.repeat(first[docs] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                own, f, x = np.repeat(np.arange(len(docs)), count), feature[rows], value[rows]
                z, sums = self.raw(own, f, x, len(docs))
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]
                g = error[own] * x
                grad_v = g[:, None] * (sums[own] - self.v[f] * x[:, None])
                used, inverse = np.unique(f, return_inverse=True)
                sort = np.argsort(inverse, kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(inverse[sort]) > 0))
                dw = np.add.reduceat(g[sort], heads) / len(docs) + shrink * self.w[used]
                dv = np.add.reduceat(grad_v[sort], heads) / len(docs) + shrink * self.v[used]
                db = error.mean()
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += db * db
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
                self.bias -= RATE * db / np.sqrt(gb)


def _meta(table: Numbered, names: tuple[str, ...]) -> dict[str, Column]:
    """The metadata as m0, m1, ...; a column that is missing, null or no number counts as 0."""
    return {f"m{k}": F.coalesce(table[c].try_cast("double"), F.lit(0.0)) if table.at(c) else F.lit(0.0) for k, c in enumerate(names)}


METADATA = ("n_chars",)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, metadata: tuple[str, ...] = METADATA) -> Machine:
    """Train on at most about ``rows`` labelled rows that are not held out, and as many of them as ``FIT_VALUES`` allows.

    The sample's features alone are brought to the driver. Without labelled rows all texts
    score one half.
    """
    table = Numbered(docs)
    meta = _meta(table, metadata)
    held = list(meta)
    packed = table.df.select(table["doc_id"].alias("doc_id"), F.struct(table["text"].cast("string").alias("t"), *[c.alias(m) for m, c in meta.items()]).alias("text"))
    sample = labelled_sample(packed, labels, "quality", rows).select(F.coalesce("text.t", F.lit("")).alias("t"), *[f"text.{m}" for m in held], "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(0)):
                meta = [batch.column(1 + k).slice(at, len(part)).to_numpy(zero_copy_only=False) for k in range(len(held))]
                owner, feature, value = features(part, meta)
                bounds = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
                # texts in the order of a hash, so training does not hang on how rows are dealt out
                order = np.add.reduceat(np.append(feature * 7919 + (value * 1e6).astype(np.int64), 0), bounds[:-1]) if len(part) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*lists, batch.column(1 + len(held)).slice(at, len(part)), pa.array(order.astype(np.int64))], ["f", "x", "y", "o"])

    made = materialize(map_arrow(sample, run, "f array<int>, x array<float>, y int, o long"), "quality-fit")
    values = made.agg(F.coalesce(F.sum(F.size("f")), F.lit(0)).alias("n")).first().n
    got = made.where(sampled(F.col("o"), FIT_VALUES / max(values, 1))).toArrow()
    release(made)
    width = (1 << WORD_BITS) + (len(STATS) + len(metadata)) * (STEPS + 1)
    machine = Machine(width)
    if got.num_rows:
        got = got.sort_by([("o", "ascending"), ("y", "ascending")]).combine_chunks()
        f, x = got.column("f").combine_chunks(), got.column("x").combine_chunks()
        sizes = np.diff(f.offsets.to_numpy())
        machine.train(np.repeat(np.arange(got.num_rows), sizes), f.flatten().to_numpy().astype(np.int64), x.flatten().to_numpy().astype(np.float64), got.column("y").to_numpy().astype(float))
    return machine


def score(docs: DataFrame, machine: Machine, keep: list[str] | None = None, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """Columns ``keep`` with ``score`` (0 to 1) and ``predicted``.

    A null text is an empty one: it has no words, but its statistics score it. Null or missing
    metadata count as 0. Rows are independent, so repeated ones get equal answers. An empty
    table gives no rows.
    """

    def make():
        def kernel(part: pa.Array, *meta: pa.Array) -> list[pa.Array]:
            s = machine.score(part, [m.to_numpy(zero_copy_only=False) for m in meta])
            return [pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))]

        return kernel

    return attach(docs, make, "score double, predicted int", keep, extra=_meta(Numbered(docs), metadata))
