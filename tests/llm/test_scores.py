import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattix.llm import langid, quality, toxicity
from lattix.llm.common import held_out

BIG = "/root/testdata/sf0.1"
EDGES = [(1, None, None), (2, "", "en"), (3, "12 !!", "en"), (4, "word " * 60_000, "de"), (5, "x" * 200_000, None), (5, "idiot", "en"), (5, "idiot", "en"), (None, "Das ist gut", "fr"), (6, "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "es")]


def auc(p, n):
    p, n = np.asarray(p), np.asarray(n)
    return (p[:, None] > n[None, :]).mean() + 0.5 * (p[:, None] == n[None, :]).mean()


@pytest.fixture(scope="module")
def big(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    return docs, labels


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, lang, "s", 1, 0.5, 3) for i, t, lang in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int")


def test_toxicity_held_out(big):
    docs, labels = big
    found = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).where(held_out(F.col("doc_id"))).join(labels, "doc_id").toPandas()
    toxic, fine = found[found.toxic == 1], found[found.toxic == 0]
    assert auc(toxic.score, fine.score) > 0.93
    assert toxic.predicted.mean() > 0.85 and fine.predicted.mean() < 0.03


def test_language_held_out(big):
    docs, _ = big
    found = langid.identify(docs, langid.fit(docs), ["doc_id", "lang"]).where(held_out(F.col("doc_id"))).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.995
    assert found.score.between(0, 1).all()


def test_quality_held_out(big):
    docs, labels = big
    found = quality.score(docs, quality.fit(docs, labels), ["doc_id"]).where(held_out(F.col("doc_id"))).join(labels, "doc_id").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert auc(good.score, bad.score) > 0.98
    assert good.predicted.mean() > 0.97 and bad.predicted.mean() < 0.08


def test_edges(spark, edges):
    some = spark.createDataFrame([(5, 1, 1), (5, 0, 0), (None, 1, 1), (4, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (some, some.limit(0)):
        t = toxicity.score(edges, toxicity.fit(edges, labels))
        q = quality.score(edges, quality.fit(edges, labels))
        for out in (t, q):
            rows = out.collect()
            assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
            assert sorted(out.columns) == sorted(set(out.columns))
    model = langid.fit(edges)
    rows = {r.doc_id: r for r in langid.identify(edges, model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[1].score == 0
    assert rows[6].lang_pred == "und"
    assert rows[5].lang_pred in model.langs
    none = langid.fit(edges.limit(0))
    assert {r.lang_pred for r in langid.identify(edges, none).collect()} == {"und"}
    assert toxicity.score(edges.limit(0), toxicity.fit(edges.limit(0), some)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_brute_force():
    rng = np.random.default_rng(3)
    terms = sorted({"".join(rng.choice(list("abcd"), int(rng.integers(3, 12)))) for _ in range(40)})
    machine = toxicity.Automaton(terms)
    words = ["".join(rng.choice(list("abcdx"), int(rng.integers(1, 14)))) for _ in range(1500)]
    for t in terms:  # words near the terms
        for _ in range(25):
            w = list(t)
            for _ in range(int(rng.integers(0, 4))):
                k = int(rng.integers(0, len(w) + 1))
                kind = int(rng.integers(0, 3))
                w[k : k + (kind > 0)] = [] if kind == 1 else [str(rng.choice(list("abcdy")))]
            words.append("".join(w))
    for w in words:
        near = [(distance(w, t), k) for k, t in enumerate(terms)]
        best = min(((d, k) for d, k in near if d <= toxicity.edits_allowed(len(terms[k]))), default=None)
        assert machine.match(w) == (None if best is None else (best[1], best[0])), w


def test_context_separates_quotation_from_abuse():
    find = toxicity.Finder(["idiot", "worthless"])
    (abuse,), _ = toxicity.hits("you are such an idi0t", find)
    (quoted,), _ = toxicity.hits('the report said "what an idiot" was shouted', find)
    (plain,), _ = toxicity.hits("there goes the idiot over the hill", find)
    assert abuse[2] == 1 and abuse[3] == plain[3] == 1.0 and quoted[3] < 0.5


def test_misspelt_terms_reach_the_threshold(big):
    docs, labels = big
    model = toxicity.fit(docs, labels)
    find = toxicity.Finder(model.terms)

    def score(text):
        return model.score(*toxicity.hits(text, find))

    assert score("what an idi0t, utterly worthles and pathetc") >= toxicity.THRESHOLD
    assert score("the thing and the other thing") < toxicity.THRESHOLD


def test_sum_of_squares_identity():
    texts = pa.array(["One two two, three!", "", "a b c d\na b c d\n" * 3, "Ä " * 50], pa.large_string())
    owner, feature, value = quality.features(texts, [np.array([1.0, 0, 5, 7])])
    m = quality.Machine((1 << quality.WORD_BITS) + 16 * (quality.STEPS + 1), seed=5)
    m.w = np.random.default_rng(6).normal(size=len(m.w))
    got, _ = m.raw(owner, feature, value, 4)
    for d in range(4):
        f, x = feature[owner == d], value[owner == d]
        slow = m.bias + m.w[f] @ x + sum(m.v[f[i]] @ m.v[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i + 1, len(f)))
        assert got[d] == pytest.approx(slow, abs=1e-9)


def test_bloom_filter_has_no_false_negatives_and_known_false_positives():
    rng = np.random.default_rng(8)
    sets = {f"l{k:02d}": rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2) for k in range(11)}
    model = langid.Model(sets, {})
    for k, (_, own) in enumerate(sorted(sets.items())):
        fresh = rng.integers(0, 2**63, 200_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for hashes, rate in ((own, 1.0), (fresh, model.false[k])):
            mask = np.full(len(hashes), 255, np.uint8)
            for slot in model.slots(hashes):
                mask &= model.table[k // 8][slot]
            share = ((mask >> (k % 8)) & 1).mean()
            assert share == 1.0 if rate == 1.0 else abs(share - rate) < 0.002


def test_grams_by_hand():
    found, letters = langid.grams(["Ab, c", "", "9"])
    assert letters.tolist() == [3, 0, 0]
    sizes = [np.bincount(owner, minlength=3).tolist() for owner, _ in found]
    text = " ab c "
    assert sizes == [[len(text) - 2, 0, 0], [len(text) - 3, 0, 0]]
    again, _ = langid.grams(["x", "aB c"])
    assert all((a[1][a[0] == 0] == b[1][b[0] == 1]).all() for a, b in zip(found, again, strict=True))


def test_statistics_by_hand():
    from lattix.llm.text import Words

    texts = pa.array(["Aa bb\nAa bb\n", "x"], pa.large_string())
    rows = pd.DataFrame(quality.statistics(Words(texts, "space", lower=False), texts), columns=quality.STATS)
    assert rows["distinct words"].tolist() == [0.5, 1.0] and rows["distinct lines"].tolist() == [0.5, 1.0]
    assert rows["upper"][0] == pytest.approx(2 / 12) and rows["top word"].tolist() == [0.5, 1.0]
    assert re.sub(r"\s", "", "a b") == "ab"
