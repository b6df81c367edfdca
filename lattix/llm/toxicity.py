"""Toxicity: misspelt lexicon terms by automaton, weighed by their context.

The lexicon is learnt from labelled rows: words far likelier in toxic texts. A trie of the terms
is intersected with the Levenshtein automata of all text words at once: a state is the set of
(trie node, edits) pairs still alive, made when first met and kept, so a word costs one
lookup for each character and most words die after two or three. A hit counts by its term's
weight and the window around it: inside quotation marks or beside a reporting word it is
quotation rather than abuse. A logistic curve over the weighed hits gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import FIT_ROWS, attach, labelled_sample, map_arrow, slices
from lattix.plans.storage import materialize, release

THRESHOLD = 0.3
#: Tokens on each side that make up a hit's window.
WINDOW = 12
#: A term needs this log-likelihood ratio and must be in this many texts. Its evidence (the negative log of
#: a tail probability) must exceed the log of the number of words tried, so chance adds hardly a term.
LEAST_RATIO, LEAST_TEXTS = 1.5, 4
#: States that an automaton holds at most between two words (some 100 MB).
MOST_STATES = 100_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…–—¡¿"
_QUOTES = set('"“”„«»')
#: Words that report what others say, and words that address someone.
REPORTING = frozenset(
    "said says wrote writes quote quoted quotes quoting called calls word words term terms phrase slur reported report sagte schrieb zitat wort dit écrit mot cite citation dijo escribió palabra cita".split()
)
ADDRESS = frozenset("you your you're u ur du dich dein ihr euch tu te toi vous votre tú usted vosotros".split())


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """Lazy product of a lexicon trie and the Levenshtein automata of its terms.

    Once more than ``most`` states have been made, all are forgotten and made anew as they are met.
    """

    def __init__(self, terms: list[str], most: int = MOST_STATES):
        self.terms, self.most = terms, most
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.reach: list[int] = [0]  # the most edits that any term below a node allows
        for number, term in enumerate(terms):
            node, allowed = 0, edits_allowed(len(term))
            self.reach[0] = max(self.reach[0], allowed)
            for ch in term:
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                    self.reach.append(0)
                node = self.child[node][ch]
                self.reach[node] = max(self.reach[node], allowed)
            self.ends[node] = number
        self.alphabet = frozenset(ch for c in self.child for ch in c)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[tuple, int] = {(): 0}
        self.states: list[tuple] = [()]
        self.steps: list[dict[str, int]] = [{}]
        self.start = self._state({0: 0})

    def _state(self, alive: dict[int, int]) -> int:
        """Close under missing characters (moving down the trie without reading) and number the state."""
        stack = list(alive.items())
        while stack:
            node, e = stack.pop()
            for nxt in self.child[node].values():
                if e + 1 <= self.reach[nxt] and e + 1 < alive.get(nxt, 99):
                    alive[nxt] = e + 1
                    stack.append((nxt, e + 1))
        key = tuple(sorted(alive.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.number[key]

    def _step(self, state: int, ch: str) -> int:
        alive: dict[int, int] = {}
        for node, e in self.states[state]:
            if e + 1 <= self.reach[node] and e + 1 < alive.get(node, 99):  # a character too many
                alive[node] = e + 1
            for own, nxt in self.child[node].items():
                cost = e + (own != ch)
                if cost <= self.reach[nxt] and cost < alive.get(nxt, 99):
                    alive[nxt] = cost
        out = self.steps[state][ch] = self._state(alive)
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """``(term, edits)`` of the closest term, the first of equals, or None."""
        state, steps, known = self.start, self.steps, self.alphabet
        for ch in word:
            if ch not in known:
                ch = "\0"  # all characters outside the lexicon behave alike
            state = steps[state].get(ch, -1)
            if state < 0:
                return self._slow(word)
            if not state:
                return None
        return self._accept(state)

    def _slow(self, word: str) -> tuple[int, int] | None:
        if len(self.states) > self.most:
            self._forget()
        state = self.start
        for ch in word:
            ch = ch if ch in self.alphabet else "\0"
            nxt = self.steps[state].get(ch)
            state = self._step(state, ch) if nxt is None else nxt
            if not state:
                return None
        return self._accept(state)

    def _accept(self, state: int) -> tuple[int, int] | None:
        best = min(((e, self.ends[n]) for n, e in self.states[state] if self.ends[n] >= 0 and e <= edits_allowed(len(self.terms[self.ends[n]]))), default=None)
        return None if best is None else (best[1], best[0])


class Finder(dict):
    """Text token -> hit or None, remembered up to a bound."""

    MOST = 200_000

    def __init__(self, terms: list[str]):
        super().__init__()
        self.automaton = Automaton(terms)

    def __missing__(self, token: str):
        if len(self) > self.MOST:
            self.clear()
        word = token.strip(_EDGE).lower()
        hit = self.automaton.match(word) if word else None
        if len(token) < 64:
            self[token] = hit
        return hit


def context(tokens: list[str], at: int) -> float:
    """1 for abuse, less for what looks like quotation."""
    before, after = tokens[max(0, at - WINDOW) : at], tokens[at : at + WINDOW + 1]
    opened = sum(c in _QUOTES for t in before for c in t) + (tokens[at][0] in _QUOTES)
    closed = any(c in _QUOTES for t in after for c in t[1:] or t)
    quoted = opened % 2 == 1 and closed
    around = {t.strip(_EDGE).lower() for t in (*before, *after)}
    reported, addressed = bool(around & REPORTING), bool({t.strip(_EDGE).lower() for t in tokens[max(0, at - 4) : at + 5]} & ADDRESS)
    weight = (0.3 if reported else 0.5) if quoted else 0.8 if reported else 1.0
    return min(1.0, weight * (1.2 if addressed and not quoted else 1.0))


def hits(text: str, find: Finder) -> tuple[list[tuple[int, int, int, float]], int]:
    """``(token position, term, edits, context weight)`` of each hit, and the number of tokens."""
    tokens = text.split()
    found = [(k, h) for k, h in enumerate([find[t] for t in tokens]) if h is not None]
    return [(k, term, edits, context(tokens, k)) for k, (term, edits) in found], len(tokens)


class Model:
    """Terms, their weights when spelt right and when misspelt, and the logistic curve."""

    def __init__(self, terms: list[str], exact: np.ndarray, fuzzy: np.ndarray, curve: np.ndarray):
        self.terms, self.exact, self.fuzzy, self.curve = terms, exact, fuzzy, curve

    def features(self, found: list[tuple[int, int, int, float]], tokens: int) -> list[float]:
        best: dict[int, float] = {}
        for _, term, edits, weight in found:
            value = weight * (self.fuzzy if edits else self.exact)[term]
            best[term] = max(best.get(term, 0.0), value)
        total = sum(best.values())
        return [1.0, math.log1p(total), max(best.values(), default=0.0), min(sum(h[3] for h in found) / max(tokens, 1) * 10, 3.0) if total else 0.0]

    def score(self, found: list[tuple[int, int, int, float]], tokens: int) -> float:
        x = float(np.dot(self.curve, self.features(found, tokens)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton's method for ridge logistic regression; the first column is the constant and not shrunk."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn terms, weights and curve from at most about ``rows`` labelled texts that are not held out.

    Equal texts with equal labels count once. Without usable labels, or without any of one kind,
    the lexicon is empty and every text scores the share of toxic labels.
    """
    sample = materialize(labelled_sample(docs, labels, "toxic", rows).where("text is not null").withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "y"]).select("text", "y"), "toxicity-fit")
    size = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = batch.column(1).to_pylist()
            for at, part in slices(batch.column(0)):
                seen: dict[str, list[int]] = {}
                for k, text in enumerate(part.to_pylist()):
                    for w in {t.strip(_EDGE).lower() for t in set(text.split())}:
                        if w:
                            seen.setdefault(w, [0, 0])[ys[at + k]] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], ["w", "p", "n"])

    terms, exact, counts = [], np.zeros(0), np.zeros((0, 2))
    if pos and neg:
        rate = pos / (pos + neg)
        n, k = F.col("p") + F.col("n"), F.col("p")
        tail = k * F.log(k / n / rate) + F.when(n > k, (n - k) * F.log((n - k) / n / (1 - rate))).otherwise(0.0)
        ratio = F.log((k + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
        tried = materialize(map_arrow(sample, words, "w string, p long, n long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where(n >= LEAST_TEXTS), "toxicity-words")
        least = math.log(max(tried.count(), 1)) + 0.5
        kept = tried.where("p > 0").where((k / n > rate) & (tail >= least) & (ratio >= LEAST_RATIO)).select("w", "p", "n", ratio.alias("ratio")).collect()
        release(tried)
        kept.sort(key=lambda r: r.w)
        terms, exact, counts = [r.w for r in kept], np.array([r.ratio for r in kept]), np.array([(r.p, r.n) for r in kept], float).reshape(-1, 2)
    found = []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(terms)
        for batch in batches:
            ys = batch.column(1).to_pylist()
            for at, part in slices(batch.column(0)):
                out = []
                for k, text in enumerate(part.to_pylist()):
                    got, n = hits(text, find)
                    best: dict[tuple[int, int], tuple[float, int]] = {}
                    for _, term, edits, weight in got:
                        key = (term, int(edits > 0))
                        old = best.get(key, (0.0, 0))
                        best[key] = (max(old[0], weight), old[1] + 1)
                    out.append((ys[at + k], n, [{"term": t, "fuzzy": e, "weight": w, "times": c} for (t, e), (w, c) in sorted(best.items())]))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.struct([("term", pa.int32()), ("fuzzy", pa.int32()), ("weight", pa.float64()), ("times", pa.int32())])))], ["y", "n", "hits"])

    if terms:
        found = map_arrow(sample, scan, "y int, n long, hits array<struct<term:int,fuzzy:int,weight:double,times:int>>").toArrow().to_pylist()
        found.sort(key=lambda r: (r["y"], r["n"], [tuple(h.values()) for h in r["hits"]]))  # sums don't hang on how rows are dealt out
    seen = np.zeros((len(terms), 2))
    for r in found:
        own = {h["term"] for h in r["hits"] if not h["fuzzy"]}
        for h in r["hits"]:
            if h["fuzzy"] and h["term"] not in own:
                seen[h["term"], r["y"]] += 1
    # misspellings are held to be as telling as their terms (with a twentieth of the terms' counts) until texts show otherwise
    shown = seen + np.column_stack([0.05 * (counts[:, 1] + 0.5), 0.05 * (counts[:, 0] + 0.5)]) if terms else seen
    fuzzy = np.clip(np.log(shown[:, 1] / (pos + 1)) - np.log(shown[:, 0] / (neg + 1)), 0, 0.9 * exact) if terms else exact
    release(sample)
    model = Model(terms, exact, fuzzy, np.zeros(4))
    if found:
        x = np.array([model.features([(0, h["term"], h["fuzzy"], h["weight"]) for h in r["hits"] for _ in range(h["times"])], r["n"]) for r in found])
        model.curve = logistic(x, np.array([r["y"] for r in found], float))
    else:
        model.curve = np.array([math.log((pos + 0.5) / (neg + 0.5)) if pos + neg else -3.0, 0, 0, 0])
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with ``score`` (0 to 1), ``predicted`` and ``hits`` (position, term, edits, context weight).

    Null and empty texts have no hits and get the score of a text without hits. Rows are
    independent, so repeated ones get equal answers. An empty table gives no rows.
    """

    def make():
        find = Finder(model.terms)

        def kernel(part: pa.Array) -> list[pa.Array]:
            scores, rows = [], []
            for text in part.to_pylist():
                got, n = hits(text, find)
                scores.append(model.score(got, n))
                rows.append([{"position": k, "term": model.terms[t], "edits": e, "weight": w} for k, t, e, w in got])
            kind = pa.list_(pa.struct([("position", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("weight", pa.float64())]))
            return [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(rows, kind)]

        return kernel

    return attach(docs, make, "score double, predicted int, hits array<struct<position:long,term:string,edits:int,weight:double>>", keep)
