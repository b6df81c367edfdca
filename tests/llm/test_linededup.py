import numpy as np

from lattix.llm.linededup import dedup_lines


def brute(docs, width=3):
    seen, repeats = set(), {}
    for k, (i, text) in enumerate(docs):  # docs are in order
        lines = text.split("\n") if text is not None else []
        for s in range(len(lines) - width + 1):
            win = tuple(lines[s : s + width])
            if win in seen:
                repeats.setdefault(k, set()).update(range(s, s + width))
            seen.add(win)
    out = []
    for k, (i, text) in enumerate(docs):
        lines, cut = (text.split("\n") if text is not None else []), repeats.get(k, set())
        out.append((i, len(lines), len(cut), None if text is None else "\n".join(x for p, x in enumerate(lines) if p not in cut)))
    return out


def rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in df.collect()), key=str)


def test_random_lines(spark):
    rng = np.random.default_rng(4)
    docs = [(i, "\n".join(rng.choice(list("abcde"), int(rng.integers(1, 30))))) for i in range(60)]
    assert rows(dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == sorted(brute(docs), key=str)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a\nb\nc"), (4, "a\nb"), (5, "x\na\nb\nc\ny"), (6, "l\n" * 5000), (7, "a\nb\nc"), (8, "\n\n\n")]
    table = spark.createDataFrame([(i, t, 9, "z") for i, t in docs], "doc_id long, text string, n_lines int, `lines` string")
    out = dedup_lines(table)
    assert sorted(out.columns) == ["doc_id", "lines", "n_lines", "n_removed", "text"]
    assert rows(out) == sorted(brute(docs), key=str)
    assert dedup_lines(table.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = [(None, "a\nb\nc"), (1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "p\nq\nr"), (2, "p\nq\nr")]
    got = rows(dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == sorted([(None, 3, 0, "a\nb\nc"), (1, 4, 3, "d"), (1, 4, 3, "d"), (2, 3, 0, "p\nq\nr"), (2, 3, 0, "p\nq\nr")], key=str)
