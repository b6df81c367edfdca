"""The three scorers against plain Python that shares no code with them but the fitted numbers."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from test_fingerprint import word_hash
from test_scores import distance

from lattix.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"
U = (1 << 64) - 1


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def some(docs):
    short = [r.text for r in docs.where("length(text) < 900").orderBy("doc_id").limit(150).collect()]
    return [*short, "", "you idi0t", '"what an idiot" he said', "12 !!", "Ä" * 50, "one\n\ntwo two\none\n", " x", 'He called: "you idiots" — twice', "İstanbul ǅ ẞ"]


# --- toxicity


def slow_context(tokens, at):
    quotes = '"“”„«»'
    near = lambda k: {t.strip(toxicity._EDGE).lower() for t in tokens[max(0, at - k) : at + k + 1]}
    opened = sum(t.count(q) for t in tokens[max(0, at - 12) : at] for q in quotes) + (tokens[at][0] in quotes)
    behind = tokens[at : at + 13]
    closed = any(q in (t[1:] if len(t) > 1 else t) for t in behind for q in quotes)
    quoted = opened % 2 == 1 and closed
    reported, addressed = bool(near(12) & toxicity.REPORTING), bool(near(4) & toxicity.ADDRESS)
    if quoted:
        return 0.3 if reported else 0.5
    return min(1.0, (0.8 if reported else 1.0) * (1.2 if addressed else 1.0))


def slow_toxicity(model, text):
    tokens, best, weights = text.split(), {}, 0.0
    for at, token in enumerate(tokens):
        word = token.strip(toxicity._EDGE).lower()
        near = [(distance(word, t), k) for k, t in enumerate(model.terms) if word and abs(len(word) - len(t)) <= 2]
        near = [(d, k) for d, k in near if d <= (0 if len(model.terms[k]) < 5 else 1 if len(model.terms[k]) < 9 else 2)]
        if near:
            d, k = min(near)
            w = slow_context(tokens, at)
            weights += w
            best[k] = max(best.get(k, 0.0), w * (model.fuzzy if d else model.exact)[k])
    total = sum(best.values())
    x = model.curve @ [1.0, math.log(1 + total), max(best.values(), default=0.0), min(10 * weights / max(len(tokens), 1), 3.0) if total else 0.0]
    return 1 / (1 + math.exp(-x))


def test_toxicity(docs, labels, some):
    model = toxicity.fit(docs, labels)
    assert model.terms
    find, tight = toxicity.Finder(model.terms), toxicity.Finder(model.terms)
    tight.automaton = toxicity.Automaton(model.terms, most=5)  # forgets its states again and again
    texts = [*some, *(f"well {t} and {t[:-1]}x or x{t}" for t in model.terms)]
    for text in texts:
        assert model.score(*toxicity.hits(text, find)) == pytest.approx(slow_toxicity(model, text), abs=1e-9), text
        assert toxicity.hits(text, tight) == toxicity.hits(text, find)


# --- language


def slow_language(model, text):
    body = re.sub(r"[^a]", lambda m: m.group() if m.group().isalpha() else " ", f" {text.lower()} ")
    body = re.sub(r" +", " ", body)
    counts, n = [0] * len(model.langs), 0
    spread = [int(x) for x in langid._SPREAD]
    for size in (3, 4):
        for k in range(len(body) - size + 1):
            h = sum(ord(c) * spread[i] for i, c in enumerate(body[k : k + size])) & U
            h = ((h ^ h >> 29) * (0xBF58476D1CE4E5B9 + 2 * size)) & U
            slots = [h >> 45, h >> 26 & (1 << 19) - 1, h >> 7 & (1 << 19) - 1]
            n += 1
            for j in range(len(model.langs)):
                counts[j] += all(int(model.table[j // 8][s]) >> j % 8 & 1 for s in slots)
    if not any(c.isalpha() for c in text.lower()):
        return "und", 0.0
    true = [max(0.0, (c - n * f) / (1 - f)) for c, f in zip(counts, model.false, strict=True)]
    best = max(range(len(true)), key=lambda j: (true[j] + model.tie[j], -j))
    if not max(true) > 0:
        return model.common, 0.0
    return model.langs[best], 1 / sum(math.exp(max(-50.0, t - max(true))) for t in true)


def test_language(docs, some):
    model = langid.fit(docs)
    langs, scores = model.predict(some)
    for text, lang, score in zip(some, langs, scores, strict=True):
        slow = slow_language(model, text)
        assert lang == slow[0] and score == pytest.approx(slow[1], abs=1e-9), text


# --- quality


def slow_statistics(text):
    raw = text.encode()
    spaces = b" \t\n\r\x0b\x0c"
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, one = len(words), max(len(words), 1)
    share = lambda f: sum(map(f, raw)) / max(len(raw), 1)
    upper, lower, digit = (lambda lo, hi: lambda b: lo <= b <= hi)(65, 90), lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57
    letter = lambda b: upper(b) or lower(b) or b >= 128
    lines = [tuple(x) for x in (re.findall(rb"[^\x20\x09-\x0D]+", line) for line in raw.split(b"\n")) if x]
    return [
        math.log1p(len(raw)) / 16, math.log1p(n) / 14, min(sum(map(len, words)) / one / 20, 1), share(upper), share(digit), share(lambda b: not letter(b) and not digit(b) and b not in spaces), share(lambda b: b in spaces),
        min(share(lambda b: b == 10) * 10, 1), share(lambda b: b >= 128), len(set(words)) / one, len(set(zip(words, words[1:]))) / max(n - 1, 1), max((words.count(w) for w in set(words)), default=0) / one,
        math.log1p(max(map(len, words), default=0)) / 12, len(set(lines)) / max(len(lines), 1), share(letter),
    ]


def slow_quality(machine, text, n_chars):
    x = {}
    for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        x[word_hash(w) >> 49] = x.get(word_hash(w) >> 49, 0) + 1
    x = {k: math.log1p(v) for k, v in x.items()}
    norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
    x = {k: v / norm for k, v in x.items()}
    base = 1 << 15
    columns = [*slow_statistics(text), min(math.log1p(n_chars) / 16, 1)]
    for k, v in enumerate(columns):
        x[base + 12 * k + min(int(v * 12), 11)] = 0.5
        x[base + 12 * len(columns) + k] = v
    keys = sorted(x)
    out = machine.bias + sum(machine.w[k] * x[k] for k in keys)
    v = machine.v[keys] * np.array([x[k] for k in keys])[:, None]
    gram = v @ v.T  # all pairs
    return 1 / (1 + math.exp(-(out + (gram.sum() - np.trace(gram)) / 2)))


def test_quality(docs, labels, some):
    machine = quality.fit(docs, labels)
    sizes = np.array([float(len(t)) for t in some])
    got = machine.score(pa.array(some, pa.large_string()), [sizes])
    for text, n, score in zip(some, sizes, got, strict=True):
        assert score == pytest.approx(slow_quality(machine, text, n), abs=1e-9), text


def test_long_texts_make_a_smaller_sample(docs, labels, monkeypatch):
    monkeypatch.setattr(quality, "FIT_VALUES", 3000)
    machine = quality.fit(docs, labels)
    assert machine.bias != 0.0 and np.isfinite(machine.w).all()
