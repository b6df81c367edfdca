import hashlib
import re

import pytest

from lattix.llm.decontam import decontaminate, digest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width=13):
    windows = {}
    for item, text in items:
        if item is None:
            continue
        ws = words(text)
        for s in range(max(len(ws) - width, 0) + 1) if ws else ():
            windows.setdefault(tuple(ws[s : s + width]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for n in lengths:
            for s in range(len(ws) - n + 1):
                if (own := windows.get(tuple(ws[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= own
        digest_ = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(ws), len(hit), len(found), digest_, len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def rows(df):
    return sorted((tuple(r) for r in digest(df).select(*COLUMNS).collect()), key=str)


def test_test_tables(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = rows(decontaminate(docs, items, keep=["doc_id"]))
    assert found == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert any(r[5] for r in found)


HAND_ITEMS = [(1, "a b c"), (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (3, "..."), (4, None), (None, "ghost"), (5, "Ärger ÄRGER"), (10, "a b c")]
HAND_DOCS = [
    (1, "A-b, C! and a b a b c"), (2, "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen x one two"),
    (3, None), (4, ""), (5, "ghost"), (6, "Ärger Ärger"), (7, "Ärger ÄRGER"), (7, "Ärger ÄRGER"), (None, "a b c"), (8, "a b"), (9, "c" + " a b c" * 3000), (10, "two three four five six seven eight nine ten eleven twelve thirteen"),
]


@pytest.mark.parametrize("shingle", [5, 2, 1])
def test_edges(spark, shingle):
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in HAND_DOCS], "doc_id long, text string, n_words int, `odd.name` string")
    items = spark.createDataFrame(HAND_ITEMS, "item_id long, text string")
    found = decontaminate(docs, items, shingle=shingle)
    assert rows(found) == brute(HAND_DOCS, HAND_ITEMS)
    assert "odd.name" in found.columns and found.columns.count("n_words") == 1


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(HAND_DOCS, "doc_id long, text string"), spark.createDataFrame(HAND_ITEMS, "item_id long, text string")
    assert rows(decontaminate(docs.limit(0), items)) == []
    assert all(r[2] == 0 and not r[5] for r in rows(decontaminate(docs, items.limit(0))))
