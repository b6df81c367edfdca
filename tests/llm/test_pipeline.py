import pytest
from pyspark.sql import functions as F
from test_decontam import brute as slow_contamination
from test_decontam import words as slow_words
from test_mixing import WORD, fill
from test_sharding import verify
from test_simhash import slow_classes, slow_fingerprint

import corpus_pipeline
from lattix.llm import mixing, simhash

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of documents and of each stage's result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        out.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    return out


def test_toxic_go_and_clean_stay(spark, stages):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    gone = {r.doc_id for r in stages[0]} - kept
    assert sum(toxic.get(d, 0) for d in gone) >= 0.55 * sum(toxic.values())
    assert sum(toxic.get(d) == 0 for d in gone) <= 0.02 * len(stages[0])
    terms = ("idiot", "moron", "stupid")
    assert not [r for r in stages[1] if all(t in r.text.lower().split() for t in terms)]


def test_one_of_each_class_stays(stages):
    fps = {r.doc_id: slow_fingerprint(r.text) for r in stages[1]}
    assert sorted(r.doc_id for r in stages[2]) == sorted(set(slow_classes(fps, 2).values()))


def test_contaminated_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    whole = {tuple(w[s : s + 13]) for w in (slow_words(t) for _, t in items) for s in range(len(w) - 12)}

    def leaks(text):
        w = slow_words(text)
        return any(tuple(w[s : s + 13]) in whole for s in range(len(w) - 12))

    marked = slow_contamination([(r.doc_id, r.text) for r in stages[2]], items)
    text = {r.doc_id: r.text for r in stages[2]}
    clean = [r[0] for r in marked if not r[5] and not leaks(text[r[0]])]
    assert sorted(r.doc_id for r in stages[3]) == sorted(clean)
    assert len(clean) < sum(not r[5] for r in marked)


def test_passages_in_long_documents_go_and_clean_ones_stay(spark, tmp_path):
    item = "the quick brown fox jumps over the lazy dog while seven wizards box with quiet vexed nymphs"
    items = [(1, item), (2, "short one"), (3, "What is it?")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words, filler = item.split(), [f"w{k}" for k in range(5000)]
    rows = [(1, " ".join([*filler, *words, *filler])), (2, " ".join([*filler, *words[2:15], *filler])), (3, " ".join([*words[:13], *filler])), (4, " ".join([*filler, *words[-13:]]))]
    rows += [(5, " ".join([*filler, *words[:12], *filler, *words[5:]])), (6, " ".join([*filler, "what is it", "short one"])), (7, " ".join(filler)), (8, None), (9, "")]
    rows += [(10, "what is it " + " ".join(filler[:10])), (11, " ".join(reversed(words)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, 6, 7, 8, 9, 11]


def test_mixture(stages):
    import hashlib

    weights, size, leaf = mixing.CORPUS_WEIGHTS, {}, {}
    for r in stages[3]:
        leaf[r.doc_id] = (f"domain{int(''.join(c for c in r.source if c.isdigit()) or 0) % 3}", r.lang, r.source)
        size[leaf[r.doc_id]] = size.get(leaf[r.doc_id], 0) + len(WORD.findall(r.text))

    def under(path):
        return {k[len(path)] for k in size if k[: len(path)] == path}

    def cap(path):
        return 2 * sum(v for k, v in size.items() if k[: len(path)] == path)

    given = {(): sum(size.values())}
    for depth, level in enumerate(("domain", "lang", "source")):
        for path in [p for p in given if len(p) == depth]:
            for n, v in fill({n: (weights.get(level, {}).get(n, 1), cap((*path, n))) for n in under(path)}, given[path]).items():
                given[(*path, n)] = v
    expected = []
    for own, n in size.items():
        epochs, rest = divmod(given[own], n)
        rows = [r for r in stages[3] if leaf[r.doc_id] == own]
        key = {r.doc_id: hashlib.md5(f"7:{epochs}:{r.doc_id}".encode()).hexdigest() for r in rows}
        upto = 0
        for r in sorted(rows, key=lambda r: key[r.doc_id]):
            upto += len(WORD.findall(r.text))
            expected += [r.doc_id] * (epochs + (rest > 0 and upto <= rest))
    assert sorted(r.doc_id for r in stages[4]) == sorted(expected)


def test_shards(stages):
    assert sorted(r.doc_id for r in stages[5]) == sorted(r.doc_id for r in stages[4])
    verify(stages[5], 8, 0.01)


def test_keep_one_with_repeated_and_null_ids(spark):
    data = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d"), (None, "lonely text here now"), (None, "Lonely text here now"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in data], "doc_id long, text string, fp string")
    rows = simhash.keep_one(docs).collect()
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in rows), key=str) == sorted([(1, "a b c d"), (None, "lonely text here now"), (7, "")], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_stages_survive_odd_tables(spark, tmp_path):
    rows = [(1, None, None, None, None, 1), (2, "", "en", "", 0, 2), (2, "", "en", "", 0, 2), (None, "word", "xx", "s1", 4, 3), (5, "w " * 60_000, "en", "src0", None, 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int"
    spark.createDataFrame([(5, 1, None), (5, None, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "word"), (3, "nothing like it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        assert docs.count() <= 2 * len(rows)
        assert docs.where(F.col("slot") < 0).count() == 0
