from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lattix.llm.sharding import shard, splitters


def size(text):
    return len((text or "").encode()) + 1


def verify(rows, shards, slack):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert all(0 <= s < shards for s in by)
    total, most = sum(size(r.text) for r in rows), max(size(r.text) for r in rows)
    for s in range(shards):
        assert abs(sum(size(r.text) for r in by[s]) - total / shards) <= slack * total / shards + 2 * most


@pytest.mark.parametrize(("shards", "cell"), [(8, 20_000), (3, 10), (1, 50)])
def test_test_tables(spark, sf, shards, cell):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = shard(docs, shards, cell_rows=cell).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    verify(rows, shards, 0.01)
    again = {r.doc_id: (r.shard, r.slot) for r in shard(docs.repartition(5), shards, cell_rows=cell).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_larger_table_is_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sizes = [r.b for r in shard(docs).groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.012 * sum(sizes) / 8


def test_equal_texts_stay_together_unless_they_outweigh_a_shard(spark):
    rows = [(i, f"text number {i % 50}", 7) for i in range(2000)]
    placed = shard(spark.createDataFrame(rows, "doc_id long, text string, slot int"), 4, tolerance=0.2).collect()
    where = defaultdict(set)
    for r in placed:
        where[r.text].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    hot = [(i, "copy" if i % 3 else f"own {i}") for i in range(3000)]
    placed = shard(spark.createDataFrame(hot, "doc_id long, text string"), 8, cell_rows=100).collect()
    verify(placed, 8, 0.02)


def test_edges(spark):
    data = [(1, None), (1, ""), (None, "x"), (None, None), (2, "same"), (2, "same"), (2, "same"), (3, "y" * 100_000)]
    docs = spark.createDataFrame([(i, t, 0, "k", 1, 2, 3) for i, t in data], "doc_id long, text string, shard int, `a.b` string, offset int, h int, cell int")
    out = shard(docs, 4)
    assert sorted(out.columns) == sorted(["doc_id", "text", "a.b", "offset", "h", "cell", "shard", "slot"])
    rows = out.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(data, key=str)
    verify(rows, 4, 0.01)
    assert shard(docs.limit(0)).count() == 0
    one = shard(spark.createDataFrame([(5, None)], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].slot == 0
    verify(shard(spark.createDataFrame([(9, "dup")] * 40, "doc_id long, text string"), 4, cell_rows=5).collect(), 1 + 3, 9)


def test_many_hot_texts(spark):
    rows = [(8 * k + c, f"hot text {k}") for k in range(3000) for c in range(8)]
    placed = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 8, cell_rows=2).collect()
    assert sorted(r.doc_id for r in placed) == list(range(24_000))
    verify(placed, 8, 0.01)


def test_splitters_equal_a_sort(spark):
    """Exact bytes below each splitter, from all rows in order: within tolerance, or at the edge of a row nearest the target."""
    rows = [((k * 2654435761 % 997 - 500) << 54, k, 1 + k * k % 900) for k in range(2000)] + [(77, k, 40) for k in range(3000)]
    found = splitters(spark.createDataFrame(rows, "h long, id long, size long").repartition(7), 6, 0.002)
    ordered, total = sorted(rows), sum(r[2] for r in rows)
    edges = [0]
    for r in ordered:
        edges.append(edges[-1] + r[2])
    for k, (h, i) in enumerate(found, 1):
        below = sum(r[2] for r in ordered if (r[0], r[1]) < (h, i))
        target = total * k / 6
        assert below in edges
        assert abs(below - target) <= 0.002 * total / 6 or abs(below - target) == min(abs(e - target) for e in edges)
    assert found == sorted(found)
