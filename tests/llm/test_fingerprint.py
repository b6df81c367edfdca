import hashlib
import re

import numpy as np
import xxhash

from lattix.llm.fingerprint import fingerprint, likeness, sketches

U = (1 << 64) - 1


def mixed(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & U
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & U
    return h ^ h >> 31


BYTE = [int(x) | 1 for x in np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)]


def word_hash(word):
    return mixed(sum(BYTE[b] * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(word)) & U)


def slow_fingerprint(text):
    """Bins, densification and packing one value at a time, with Python's own integers."""
    words = [word_hash(w) for w in re.split(rb"[\x20\x09-\x0D]+", text.encode()) if w]
    if not words:
        return "00"

    def shingle(ws):
        return mixed(sum(w * pow(0xC2B2AE3D27D4EB4F, k, 1 << 64) for k, w in enumerate(ws)) & U)

    if len(words) < 5:
        hashes = [mixed(shingle(words) ^ 0x5851F42D4C957F2D)]
    else:
        hashes = [mixed(shingle(words[k : k + 5])) for k in range(len(words) - 4)]
    bins = {}
    for h in hashes:
        bins[h >> 56] = min(bins.get(h >> 56, U), h)
    out = []
    for b in range(256):
        attempt, at = 0, b
        while at not in bins:
            at = mixed(b * 0x9E3779B97F4A7C15 + attempt * 0x632BE59BD9B4E019 & U) >> 56
            attempt += 1
        out.append(mixed(bins[at]) & 15)
    return "01" + bytes(a << 4 | b for a, b in zip(out[::2], out[1::2], strict=True)).hex()


def slow_likeness(a, b):
    if "00" in (a, b):
        return float(a == b)
    agree = sum(x == y for x, y in zip(a[2:], b[2:], strict=True)) / 256
    return min(1.0, max(0.0, (agree - 1 / 16) / (15 / 16)))


def by_hand(docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda r: (-(1 << 63) if r[0] is None else r[0], np.int64(np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)))))
    out = []
    for k, (i, t) in enumerate(docs):
        q, following = len(t) // 4, docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - q] + following[:q]
        mine, other, nxt = slow_fingerprint(t), slow_fingerprint(edited), slow_fingerprint(following)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), mine, other, round(slow_likeness(mine, other), 9), round(slow_likeness(mine, nxt), 9)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


def test_test_tables_and_range_bounds(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 6000")
    expected = by_hand([tuple(r) for r in docs.collect()])
    for size in (8192, 7):
        assert rows(fingerprint(docs, size)) == expected


def test_edges(spark):
    data = [(3, "a b c d e f g"), (None, "first"), (None, None), (1, ""), (2, None), (2, None), (7, "ü" * 9), (5, "w " * 3000), (6, "x y"), (6, "x y z"), (-4, " \n ")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in data], "doc_id long, text string, fingerprint double")
    for size in (8192, 2):
        assert rows(fingerprint(docs, size)) == by_hand(data)
    assert rows(fingerprint(docs.limit(0))) == []
    one = spark.createDataFrame([(9, "a b c d e f g h")], "doc_id long, text string")
    assert rows(fingerprint(one)) == by_hand([(9, "a b c d e f g h")])


def test_rows_that_share_an_id_and_ids_beyond_doubles(spark):
    rng = np.random.default_rng(3)
    data = [(None, f"null {k}") for k in range(40)] + [(9, f"same {k % 30}") for k in range(60)] + [((1 << 60) + 3 * k, f"far {k}") for k in range(50)] + [(int(x), "z") for x in rng.integers(-(1 << 62), 1 << 62, 50)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    for size in (4096, 5):
        assert rows(fingerprint(docs, size)) == by_hand(data)


def test_equal_texts_have_equal_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for r in fingerprint(docs).collect():
        assert seen.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint


def shingles(text):
    w = re.split(r"[\x20\x09-\x0D]+", text.strip(" \t\n\r\x0b\x0c"))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}


def test_estimate_is_near_the_truth_and_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        words = [str(x) for x in rng.integers(0, 10**6, 600)]
        cut = int(rng.integers(50, 550))
        a, b = " ".join(words), " ".join(words[:cut] + [str(x) for x in rng.integers(0, 10**6, 600 - cut)])
        sa, sb = shingles(a), shingles(b)
        errors.append(float(likeness(sketches([a]), sketches([b]))[0]) - len(sa & sb) / len(sa | sb))
    assert abs(np.mean(errors)) < 0.015 and np.max(np.abs(errors)) < 0.13
