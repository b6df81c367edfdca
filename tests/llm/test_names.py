"""Extra columns whose names clash with results, inputs or helpers, in any case: kept or replaced, never a crash."""

import pytest

import corpus_pipeline
from lattix.llm import chat, decontam, fingerprint, langid, linededup, mixing, quality, sharding, simhash, toxicity

NAMES = (
    "TEXT", "Doc_ID", "Score", "PREDICTED", "Hits", "Lang_pred", "N_words", "HIT_spans", "item_IDS", "Longest_window", "N_hit", "Contaminated", "N_lines", "N_removed", "Epoch", "N_tokens", "LEAF",
    "Shard", "SLOT", "h", "id", "z", "size", "cell", "cut", "row", "body", "own", "node", "times", "epochs", "bound", "d", "th", "covered", "lines", "k0", "h0", "c0", "a0", "r0", "__part", "__s", "__d", "__h", "__epochs",
    "text_key", "runs", "piece", "m0", "fp", "__fp", "__class", "component_id", "with `tick`", "a.b",
)


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "you idiot\na b c\nx\ny", "en", "src1", 5), (2, None, None, None, None), (3, "", "de", "s2", 0), (4, "you idiot\na b c\nx\ny", "en", "src1", 5), (None, "one two three four five six seven eight nine ten eleven twelve thirteen", "en", "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *[f"kept {n}" for n in NAMES]) for r in rows], schema)


def check(out, results, n=5):
    low = [c.lower() for c in results]
    wanted = [n for n in ("doc_id", "text", "lang", "source", "n_chars", *NAMES) if n.lower() not in low or n in ("doc_id", "text") and n in results]
    assert [c for c in out.columns if c not in results] == [c for c in wanted if c not in results]
    rows = out.toDF(*[f"x{i}" for i in range(len(out.columns))]).collect()
    assert n is None or len(rows) == n
    for r in rows:
        for c, v in zip(out.columns, r, strict=True):
            if c in NAMES and c not in results:
                assert v == f"kept {c}"


def test_operators(spark, clashing):
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    check(toxicity.score(clashing, toxicity.fit(clashing, labels)), ["score", "predicted", "hits"])
    check(quality.score(clashing, quality.fit(clashing, labels)), ["score", "predicted"])
    check(langid.identify(clashing, langid.fit(clashing)), ["lang_pred", "score"])
    found = decontam.digest(decontam.decontaminate(clashing, items))
    check(found, ["n_words", "hit_spans", "item_ids", "longest_window", "n_hit", "n_items", "items_sha256", "contaminated"])
    check(linededup.dedup_lines(clashing), ["text", "n_lines", "n_removed"])
    check(mixing.mix(clashing, mixing.corpus_levels(), {}, (1, 1), 1), ["n_tokens", "epoch", "leaf"], None)
    check(sharding.shard(clashing, 2), ["shard", "slot"])
    assert simhash.near_duplicates(clashing).count() == fingerprint.fingerprint(clashing).count() == 5
    assert simhash.keep_one(clashing).columns == clashing.columns
    turns = clashing.toDF("conv_id", "text", "role", "x", "turn", *NAMES)
    assert chat.perspectives(turns).count() == 5


def test_stages(spark, clashing, tmp_path):
    spark.createDataFrame([(1, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "not in there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns == clashing.columns
        check(out, [], None)
    check(corpus_pipeline.shard(spark, clashing, str(tmp_path)), ["shard", "slot"])
