import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lattix.llm import simhash as S
from lattix.llm import xxh64 as X

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def slow_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(fps, distance):
    """fps: doc_id -> fingerprint."""
    values = sorted(set(fps.values()))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    arr = np.array(values, np.uint64)
    for k, v in enumerate(values):
        for other in arr[k + 1 :][np.bitwise_count(arr[k + 1 :] ^ np.uint64(v)) <= distance].tolist():
            parent[root(other)] = root(v)
    least = {}
    for d, v in fps.items():
        least[root(v)] = min(d, least.get(root(v), d))
    return {d: least[root(v)] for d, v in fps.items()}


def test_test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    found = S.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in found} == fps
    assert {r.doc_id: r.component_id for r in found} == slow_classes(fps, 2)


def test_python_hash_is_sparks(spark):
    text = "a few words, and Übermut"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize(("distance", "group"), [(2, 48), (2, 3), (3, 48), (3, 5), (5, 48)])
def test_links_join_the_same_classes_as_all_pairs(spark, distance, group):
    rng = np.random.default_rng(distance)
    fps = set()
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        cloud = [base]
        for _ in range(40):
            bits = rng.choice(64, int(rng.integers(1, 3)), replace=False)
            cloud.append(int(rng.choice(np.array(cloud, np.uint64))) ^ sum(1 << int(b) for b in bits))
        fps.update(cloud)
    fps |= {0, 1, 3, (1 << 64) - 1, 1 << 63}
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    found = S.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance, group).collect()
    mask = (1 << 64) - 1
    assert all(bin((r.src ^ r.dst) & mask).count("1") <= distance for r in found)
    parent = {v: v for v in fps}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in found:
        parent[root(r.src & mask)] = root(r.dst & mask)
    expected = slow_classes({v: v for v in fps}, distance)
    groups = {}
    for v in fps:
        groups.setdefault(root(v), set()).add(v)
    slow = {}
    for v in fps:
        slow.setdefault(expected[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_edges(spark):
    data = [(5, None), (3, ""), (9, " \n"), (1, "One two"), (2, "one  TWO"), (2, "one  TWO"), (None, "other words here now"), (7, "x " * 60_000), (8, "Ä b c"), (4, "ä b c")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in data], "doc_id long, text string, component_id string")
    found = S.near_duplicates(docs).collect()
    assert len(found) == len(data)
    got = {(r.doc_id, r.component_id) for r in found}
    assert {(5, 3), (3, 3), (9, 3), (1, 1), (2, 1), (7, 7), (8, 8), (4, 4), (None, None)} == got
    assert S.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [0, 42, 2**64 - 1])
def test_many_ranges_hash_as_one_by_one(seed):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3 * X.SPAN, dtype=np.uint8)
    start = np.sort(rng.integers(0, len(data) - X.SPAN, 20_000))
    end = start + np.where(np.arange(len(start)) % 3, rng.integers(0, 40, len(start)), rng.integers(0, X.LONGEST + 40, len(start)))
    end[7], end[-1] = start[7] + X.SPAN, len(data)
    assert X.xxh64(data, start, end, seed).tolist() == [xxhash.xxh64_intdigest(data[a:b], seed) for a, b in zip(start, end, strict=True)]
    assert len(X.xxh64(data, start[:0], end[:0], seed)) == 0


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_slices_of_odd_texts(width):
    odd = ["", " \n", "a", "a b", "A  B\tc", "x " * 70_000, "Ä b c", "\x85 \x1c a", "y" * 100_000 + " z " + "q" * 3000, " lead", "trail ", "　 wide gap"] * 2
    for texts in (odd, odd[::-1], [""], []):
        part = pa.array(["cut off", *texts], pa.large_string()).slice(1)
        assert S.simhashes(part, width).tolist() == [slow_fingerprint(t, width) for t in texts]
