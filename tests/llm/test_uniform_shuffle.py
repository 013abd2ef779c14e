"""The shuffle's exact sizes, its slots, and the law of its draws."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from cohortsmith.llm import uniform_shuffle as U


def check(rows, n, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == n and set(by) <= set(range(shards))
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for bucket in (U.BUCKET, 7):
        got = U.shuffle(U.sizes(docs), 16, bucket=bucket).collect()
        check(got, docs.count(), 16)
        want = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
        assert {r.doc_id: (r.size, r.text_crc32) for r in got} == want


def test_edges(spark):
    rows = [(1, None, 5), (None, "", 5), (3, "é" * 100000, 5)] + [(7, "again", 5)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = U.shuffle(df, 16)
    assert got.columns == ["doc_id", "text", "slot", "shard", "_slot"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((a, b) for a, b, _ in rows)
    check(U.shuffle(U.sizes(df), 16).collect(), 43, 16)
    check(U.shuffle(U.sizes(df.limit(2)), 16).collect(), 2, 16)
    assert U.shuffle(U.sizes(df.limit(0)), 16).count() == 0


def test_hypergeometric_law():
    rng = random.Random(1)
    got = Counter(U.hypergeometric(rng, 6, 9, 5) for _ in range(40000))
    from math import comb
    for k in range(6):
        p = comb(6, k) * comb(9, 5 - k) / comb(15, 5)
        assert abs(got[k] / 40000 - p) < 5 * (p / 40000) ** 0.5 + 1e-4
    x = [U.hypergeometric(rng, 10**10, 15 * 10**10, 10**6) for _ in range(200)]  # beyond 32 bits
    assert abs(sum(x) / 200 - 62500) < 100


def test_matrix_sums():
    for counts in ([], [0, 5], [100, 3, 0, 57], [1] * 20):
        m = U.communication_matrix(counts, 16, 3)
        assert [sum(r) for r in m] == counts
        columns = [sum(c) for c in zip(*m)] or [0]
        assert max(columns) - min(columns) <= 1


def test_uniform_places(spark):
    """Over many seeds, every row lands in every shard about equally often."""
    rng = random.Random(0)
    hits = Counter()
    for _ in range(3000):
        m = U.communication_matrix([30, 2, 8], 4, rng.randrange(10**9))
        hits.update({(p, s): k for p, row in enumerate(m) for s, k in enumerate(row)})
    for p, n in enumerate([30, 2, 8]):
        for s in range(4):
            assert abs(hits[p, s] / 3000 - n / 4) < 0.15 * n / 4 + 0.05


def test_slots_depend_on_seed(spark):
    df = U.sizes(spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    a, b = ({r.doc_id: (r.shard, r.slot) for r in U.shuffle(df, 4, seed=s).collect()} for s in (1, 2))
    assert sum(a[k] == b[k] for k in a) < 30
