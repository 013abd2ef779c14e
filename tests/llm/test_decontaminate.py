"""Benchmark items in documents against plain dynamic programming."""

import random

import pytest
from pyspark.sql import functions as F

from cohortsmith.llm import decontaminate as D


def slow(item, text):
    """Least edits of the folded item anywhere in the folded text."""
    a, b = D.fold(item), D.fold(text)
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice("abcdefgh")
        elif kind == 1:
            s.insert(at, rng.choice("abcdefgh"))
        else:
            del s[at]
    return "".join(s)


def test_edited_items_against_dynamic_programming():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randrange(1, 5)))
    some = lambda n: " ".join(word() for _ in range(n))
    items = [(k, some(rng.randrange(2, 45))) for k in range(30)] + [(30, "ab"), (31, " "), (32, None), (33, "abcdefgh")]
    index = D.Index(items, D.RATE)
    seen, texts, wants = 0, [], []
    for _ in range(60):
        parts = [some(rng.randrange(0, 30))]
        for k in rng.sample(range(30), 2):
            parts += [edited(rng, items[k][1], rng.randrange(0, 2 + len(items[k][1]) // 8)), some(rng.randrange(1, 20))]
        text = rng.choice([" ", "\n", "  "]).join(parts)
        want = {}
        for k, t in items:
            if D.fold(t):
                e = slow(t, text)
                if e <= (D.edit_budget(len(D.fold(t)))):
                    want[k] = e
        texts += [text.upper() if rng.random() < 0.3 else text, None]
        wants.append(want)
        seen += sum(e > 0 for e in want.values())
    got = {}
    for n, k, _, e in D.find(index, texts):
        got.setdefault(n, {})[k] = e
    assert got == {2 * i: w for i, w in enumerate(wants) if w}
    assert seen > 20


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.edits for r in D.matches(docs, bench).collect()}
    for d in docs.collect():
        for i in bench.collect():
            if D.fold(i.text) in D.fold(d.text):
                assert got.pop((d.doc_id, i.item_id)) == 0
    for (d, i), e in got.items():  # the rest: with edits
        text, item = (t.where(c).first().text for t, c in ((docs, F.col("doc_id") == d), (bench, F.col("item_id") == i)))
        assert slow(item, text) == e <= D.edit_budget(len(D.fold(item)))


@pytest.mark.parametrize("block", [10, D.BLOCK])
def test_edges(spark, block):
    passage = "a passage of the benchmark that is long enough to be found with edits"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 30000 + passage.upper() + " and " + passage), (None, passage),
                                  (5, "clean"), (5, "clean"), (6, passage), (6, passage)], "doc_id long, text string").withColumn("edits", F.lit("x"))
    bench = spark.createDataFrame([(1, passage), (2, None), (3, " "), (None, passage)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted((tuple(r) for r in D.matches(docs, bench, block=block).collect()), key=str)
    assert got == sorted([(d, i, n, 0) for d, n in ((3, 2), (None, 1), (6, 1), (6, 1)) for i in (1, None)], key=str)
    left = D.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5, 5]
    assert D.matches(docs, bench.limit(0)).count() == 0 and D.matches(docs.limit(0), bench).count() == 0
