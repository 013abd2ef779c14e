"""Collapse of prefixes against brute force."""

import random

from pyspark.sql import functions as F

from cohortsmith.llm import chat_prefix as C


def slow(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((t is None, t or 0, (r, x)))
    seq = {c: [y for *_, y in sorted(v, key=lambda z: z[:2])] for c, v in convs.items()}
    out = []
    done = set()
    for c in sorted(seq, key=lambda c: (c is not None, c or 0)):
        s = seq[c]
        if tuple(s) in done or any(len(o) > len(s) and o[:len(s)] == s for o in seq.values()):
            continue
        done.add(tuple(s))
        copies = sum(o == s for o in seq.values())
        out += [(c, k, len(s), copies, f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n") for k, (r, x) in enumerate(s, 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in C.collapse_and_render(df).collect()), key=str)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(df) == slow([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_snapshots_copies_and_edges(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4)
    rng = random.Random(2)
    rows, base = [], [("user" if k % 2 == 0 else "assistant", f"t{rng.randrange(3)}") for k in range(30)]
    for c in range(40):
        n = rng.randrange(1, 31)
        own = base[:n] if c % 3 else [(r, x + rng.choice(["", "!"])) for r, x in base[:n]]
        step = rng.choice([1, 3])
        rows += [(c, k * step, r, x) for k, (r, x) in enumerate(own)]
    rows += [(100, 0, None, "a"), (101, 0, "", "a"), (102, 0, None, None), (None, 0, "user", "z"), (None, None, "user", "y"), (103, 5, "user", "z"),
             (104, 0, "user", "é" * 200000)] + [(105, 1, "user", "again")] * 30
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("x")).withColumn("conv", F.lit(1))
    assert got(df) == slow(rows)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == []
