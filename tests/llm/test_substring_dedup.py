"""Repeated windows against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortsmith.llm import substring_dedup as D


def slow(rows):
    first = {}
    words = [(t or "").encode().split() for _, t in rows]
    key = [(-(2**63) if d is None else d) for d, _ in rows]
    for i in range(len(rows)):
        for p in range(len(words[i]) - 19):
            w = tuple(words[i][p:p + 20])
            first[w] = min(first.get(w, (key[i], p)), (key[i], p))
    out = []
    for i, (d, _) in enumerate(rows):
        gone = set()
        for p in range(len(words[i]) - 19):
            if first[tuple(words[i][p:p + 20])] < (key[i], p):
                gone.update(range(p, p + 20))
        kept = b" ".join(w for j, w in enumerate(words[i]) if j not in gone)
        out.append((d, len(words[i]), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in D.digest(D.remove_repeats(df, **kw)).collect()), key=str)


EDGES = [(800001, None), (800002, ""), (800003, " \t\n"), (800004, "few words here"), (800005, "a b " * 200),
         (800006, "same " * 25), (800007, "same " * 25), (None, "same " * 30), (800008, " ".join(f"x{i}" for i in range(20))),
         (800009, " ".join(f"x{i}" for i in range(20))), (800009, " ".join(f"y{i}" for i in range(30))),
         (800011, "z é\x85z " * 9000)]


@pytest.mark.parametrize("bits", [None, 16])  # 16: a sketch so full that most windows pass it
def test_documents_against_brute_force(spark, bits):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += EDGES + [rows[10], (900000, rows[10][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("h1", F.lit("x")).repartition(5)
    assert got(df, bits=bits) == slow(rows)


def test_small_held_windows(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(60 + i % 5))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(df) == slow(rows)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_deltas_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 3000):
        cells = np.unique(rng.integers(0, 1 << 16, n))
        assert D._unpack_deltas(D._pack_deltas(cells)).tolist() == cells.tolist()
    assert D._unpack_deltas(D._pack_deltas(np.array([0, 255, 510, 65535]))).tolist() == [0, 255, 510, 65535]


def test_every_repeated_window_is_counted_twice():
    rng = np.random.default_rng(4)
    w = rng.integers(0, 2**63, 200).astype(np.uint64)
    both = np.concatenate([w[50:100], rng.integers(0, 2**63, 30).astype(np.uint64), w])
    h = D._Hasher(1)
    eight, twenty = h.runs(both)
    keys = D._keys(eight)
    assert len(twenty) == len(keys) == len(both) - 19
    counted = D._counted(eight, keys, np.ones(len(keys), bool)).tolist()
    for i in range(31):
        assert keys[i] == keys[80 + 50 + i] and twenty[i] == twenty[130 + i] and counted.count(keys[i]) >= 2
    assert set(keys.tolist()) == set(counted) and len(set(twenty.tolist())) == len(twenty) - 31


def test_words_hash_by_content_alone():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["", "ab  cd\n", None, "cd", "x", "ab\tab é"])})
    got = [(at + int(r), bytes(part[s:e])) for at, part, start, end, row in D._chunks(batch) for s, e, r in zip(start, end, row)]
    assert got == [(1, b"ab"), (1, b"cd"), (3, b"cd"), (4, b"x"), (5, b"ab"), (5, b"ab"), (5, "é".encode())]
    (_, part, start, end, _), = D._chunks(batch)
    h = D._Hasher(1).words(part, start, end).tolist()
    assert h[0] == h[4] == h[5] and h[1] == h[2] and len(set(h)) == 4
