"""SimHash by anchor points against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortsmith.llm import simhash as S


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, bits=2):
    fp = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= bits:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], f"{fp[i]:016x}", min(ids) if ids else None) for i in g]
    return sorted(out, key=str)


def test_codes_cover_as_stated():
    rng = np.random.default_rng(1)
    for code in ((S.GOLAY,), (S.HAMMING15,)):
        near = S._near(code[0], 0)
        assert all(len(p) == 1 for p, _ in near)  # perfect: one codeword within the radius
    tables = [S._near(b, 2) for b in S.CODE]
    for _ in range(300):
        x = int(rng.integers(0, 2**63))
        y = x
        for b in rng.integers(0, 64, 2):
            y ^= 1 << int(b)
        home, _ = S.anchors(x, tables, 2)
        assert home in set(S.anchors(y, tables, 2)[1].tolist())


def test_links_meet_every_close_pair(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-2**62, 2**62, 40)]
    fps = set(base)
    for x in base:
        for _ in range(6):
            y = x
            for b in rng.integers(0, 63, int(rng.integers(1, 5))):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    got = {(min(a, b), max(a, b)) for a, b in S.links(df).collect()}
    assert got == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)]
    got = dict(S.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 130)}}


def test_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(900001, None), (900002, ""), (900003, " \n"), (900004, "one"), (900005, "Two words"), (None, "two words"),
             (7, rows[3][1]), rows[5], (900006, "w " * 5000), (900007, "a\x85b a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = sorted((tuple(r) for r in S.simhash_components(df).collect()), key=str)
    assert got == slow_components(rows)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp string, root int")
    assert S.simhash_components(df).count() == 0
    assert S.deduplicate(df).columns == df.columns


def test_deduplicate_keeps_one_row_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(400))
    other, third = "other words here " * 9, "and a third text of some words"
    df = spark.createDataFrame([(5, long, "a"), (3, long, "b"), (3, long, "b"), (9, other, "c"), (None, long, "d"), (9, third, "e"),
                                (None, "null one two three", "f"), (None, "null one two three", "f"), (None, "null four five six seven", "g")],
                               "doc_id long, text string, source string")
    got = sorted(map(tuple, S.deduplicate(df).select("doc_id", "source").collect()), key=str)
    assert got == sorted([(3, "b"), (9, "c"), (9, "e"), (None, "f"), (None, "g")], key=str)


@pytest.mark.parametrize("text", ["", "x", "a b", "a b c", "A b C d " * 70000])
def test_fingerprint(text):
    want = slow_fingerprint(text) if len(text) < 1000 else slow_fingerprint("a b c d " * 70000)
    assert S.fingerprint(text) == want
