from collections import defaultdict

from lattix.llm.chat import END, perspectives


def brute(turns):
    said = defaultdict(list)
    for k, (conv, turn, role, text) in enumerate(turns):
        own = ("alone", k) if conv is None else conv
        said[own].append((turn is not None, turn or 0, "unknown" if role is None else role, text or ""))
    out = []
    for conv, rows in said.items():
        for who in {r for *_, r, _ in rows if r != "system"}:
            text, mask = "", []
            for *_, role, said_ in sorted(rows):
                text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user name={role.replace('<|', '< |')}|>\n"
                start = len(text)
                text += said_.replace("<|", "< |") + END
                if role == who:
                    mask.append((start, len(text)))
            out.append((None if isinstance(conv, tuple) else conv, who, len(rows), text, mask))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.conv_id, r.perspective, r.n_turns, r.text, [tuple(m) for m in r["mask"]]) for r in df.collect()), key=str)


def test_test_tables(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    assert rows(perspectives(turns)) == brute([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


def test_dialogues_are_whole_whatever_numbers_their_turns(spark):
    data = [(1, 1000 + k, f"p{k % 2}", f"a {k}") for k in range(40)]  # across any round number
    data += [(2, 1_700_000_000_000 + 977 * k, f"p{k % 3}", f"b {k}") for k in range(50)]  # times
    data += [(3, k, "xy"[k % 2], "c") for k in range(3000)]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = rows(perspectives(turns))
    assert got == brute(data)
    assert {(r[0], r[2]) for r in got} == {(1, 40), (2, 50), (3, 3000)}


def test_many_speakers_and_edges(spark):
    data = [(1, k, f"p{k % 5}", f"ü {k}") for k in range(30)]
    data += [(2, 0, "system", "only")] + [(3, None, None, None), (3, None, "b", "later"), (3, 0, "a<|b", "x<|end|>y"), (3, 0, "a<|b", "x<|end|>y"), (3, 0, "system", "s"), (3, -9, "z", "")]
    data += [(None, 1, "u", "z" * 90_000), (None, 2, "v", "w"), (None, 2, "v", "w"), (None, None, "system", "w"), (4, 1, "k", "y" * 5_000_000), (4, 2, "l", "z")]
    turns = spark.createDataFrame([(*r, "k", 7) for r in data], "conv_id long, turn long, role string, text string, mask string, turns int")
    assert rows(perspectives(turns)) == brute(data)
    assert rows(perspectives(turns.withColumnRenamed("mask", "said").toDF("CONV_ID", "turn", "Role", "text", "x", "y"))) == brute(data)
    assert perspectives(turns.limit(0)).count() == 0
