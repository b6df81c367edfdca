import hashlib
import re
from collections import defaultdict
from fractions import Fraction

from lattix.llm.mixing import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(children, given):
    """children: name -> (weight, cap)."""
    open_, got, left = {n: wc for n, wc in children.items() if wc[0] > 0}, dict.fromkeys(children, 0), given
    while open_:
        heavy = sum(w for w, _ in open_.values())
        full = {n for n, (w, c) in open_.items() if Fraction(w * left, heavy) >= c}
        if not full:
            for n, (w, _) in open_.items():
                got[n] = w * left // heavy
            break
        first = min(full, key=lambda n: Fraction(open_[n][1], open_[n][0]))  # one at a time, the smallest first
        got[first] = open_[first][1]
        left -= open_.pop(first)[1]
    return got


def brute(docs, weights, share, most, seed):
    tokens = {k: len(WORD.findall(t or "")) for k, (_, t, _, _) in enumerate(docs)}
    leaf = {k: tuple("unknown" if x is None else x for x in (a, b)) for k, (_, _, a, b) in enumerate(docs)}
    size = defaultdict(int)
    for k in leaf:
        size[leaf[k]] += tokens[k]
    total = sum(size.values())
    given = min(total * share[0] // share[1], total * most)
    tops = {a for a, _ in size}
    upper = fill({a: (weights.get("top", {}).get(a, 1), sum(v for (x, _), v in size.items() if x == a) * most) for a in tops}, given)
    budget = {}
    for a in tops:
        for b, v in fill({b: (weights.get("low", {}).get(b, 1), v * most) for (x, b), v in size.items() if x == a}, upper[a]).items():
            budget[a, b] = v
    out = []
    for own, n in size.items():
        epochs, rest = divmod(budget[own], n) if n else (0, 0)
        rows = [k for k in leaf if leaf[k] == own]
        key = {k: hashlib.md5(f"{seed}:{epochs}:{'' if docs[k][0] is None else docs[k][0]}".encode()).hexdigest() for k in rows}
        for k in rows:
            upto = sum(tokens[j] for j in rows if key[j] <= key[k])
            out += [(docs[k][0], e) for e in range(epochs + (rest > 0 and upto <= rest))]
    return sorted(out, key=str), budget


def run(spark, docs, weights, share, most, seed=3):
    table = spark.createDataFrame([(*d, 5, 1, "x", 2) for d in docs], "doc_id long, text string, a string, b string, epoch int, epochs int, bound string, leaf int")
    out = mix(table, {"top": lambda t: t["a"], "low": lambda t: t["b"]}, weights, share, most, seed)
    return sorted(((r.doc_id, r.epoch) for r in out.collect()), key=str)


def test_shortage_goes_to_siblings_first(spark):
    docs = [(i, "w " * (1 + i % 7), "x" if i % 4 else "y", f"s{i % 3}") for i in range(400)]
    docs += [(1000 + i, "w w", "x", "tiny") for i in range(3)]
    for weights, share, most in (({}, (1, 2), 2), ({"top": {"y": 9}, "low": {"tiny": 50}}, (1, 2), 1), ({"top": {"x": 0}}, (9, 10), 3), ({"low": {"s0": 4}}, (5, 1), 2)):
        expected, budget = brute(docs, weights, share, most, 3)
        assert run(spark, docs, weights, share, most) == expected
        assert sum(budget.values()) <= share[0] * sum(len(WORD.findall(t)) for _, t, _, _ in docs) // share[1]


def test_edges(spark):
    docs = [(1, None, None, "s"), (2, "", "x", None), (3, "a b", None, None), (3, "a b", None, None), (None, "c " * 50_000, "x", "s"), (4, "one", "x", "s"), (5, "", "lone", "lone")]
    for share in ((1, 2), (1, 1), (7, 1), (0, 1)):
        assert run(spark, docs, {}, share, 2) == brute(docs, {}, share, 2, 3)[0]
    assert run(spark, [], {}, (1, 2), 2) == []
