"""Quality rules against brute force."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortsmith.llm import line_frequency as L

W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    c = Counter(wins)
    cover = {j for i, x in enumerate(wins) if c[x] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(cover)


def norm(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()


def slow(rows, min_docs=L.MIN_DOCS, share=L.SHARE):
    texts = {}
    for _, t, h in rows:
        texts.setdefault(h, set()).add(t or "")
    gone = {}
    for h, own in texts.items():
        c = Counter(x for t in own for x in {norm(x) for x in t.split("\n")} - {""})
        gone[h] = {x for x, n in c.items() if n > min_docs and n > share * len(own)}
    out, cleaned = [], []
    for d, t, h in rows:
        m = base(t)
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        lines = (t or "").split("\n")
        lost = sum(len(W.findall(x)) for x in lines if norm(x) in gone[h])
        hit = any(norm(x) in gone[h] for x in lines)
        kept = not failed and not (hit and (m[0] - lost < 10 or m[0] - lost < 0.3 * m[0]))
        out.append((d, *m, failed, kept))
        if kept:
            cleaned.append((d, t if not hit else "\n".join(x for x in lines if norm(x) not in gone[h])))
    return sorted(out, key=str), sorted(cleaned, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit("x")).withColumn("t1", F.lit(0)).withColumn("gone", F.lit(1))


EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n\t\n", None), (None, "é $ " * 12, None), (5, "w " * 30000, "a"), (6, " ".join(f"w{i}" for i in range(30000)), "a"),
         (7, "one two three four five six\none two three four five seven eight\nnine", "a"), (7, "a\x85b c\x0bd\x1ce f g h i j k l m", "a"),
         (8, "x\ny\nx\nx \n\n\n", "b"), (9, "a b c d e a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y z", "b")]


@pytest.mark.parametrize("min_docs, share", [(L.MIN_DOCS, L.SHARE), (1, 0.01), (0, 0.0)])
def test_documents_against_brute_force(spark, min_docs, share):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + EDGES + EDGES[-2:]
    rows += [(5000 + i, f"Site  NAME\nstory {i} of some length with more words than ten\n all rights reserved " + "x" * (i % 4), "s") for i in range(80)]
    df = frame(spark, rows)
    want, cleaned = slow(rows, min_docs, share)
    assert sorted((tuple(r) for r in L.judge(df, "source", min_docs, share).collect()), key=str) == want
    out = L.clean(df, "source", min_docs, share)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == cleaned


def test_empty_table(spark):
    df = frame(spark, EDGES).limit(0)
    assert L.judge(df).count() == 0 and L.clean(df).count() == 0


def test_clean_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", "a", 1, 2, 3, 4, 5, 6)],
                                 "doc_id long, text string, source string, kept int, lost_host int, lost_t1 int, gone int, t1 int, _gone int")
    got = L.clean(docs).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in docs.collect()]
