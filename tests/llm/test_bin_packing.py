"""Packing: exact round trip of ids, gapless sequences, and few of them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortsmith.llm import bin_packing as B
from cohortsmith.llm import vocabulary


def reference_ids(texts):
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, texts, capacity=2048):
    """rows: of pack(); texts: by doc_id."""
    ids = dict(zip(texts, reference_ids(list(texts.values()))))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
        assert sum(r.length for r in parts) == len(ids[d])
        assert all(r.length == capacity for r in parts[1:])
        assert len(parts) == 1 or len(ids[d]) > capacity
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start:r.start + r.length], "<u4").tobytes())
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0] + [r.length for r in s])[:-1].tolist()
        assert sum(r.length for r in s) <= capacity
    return len(by_seq), sum(map(len, ids.values()))


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    n, tokens = check(B.pack(docs).collect(), texts)
    assert n <= -(-tokens // 2048) + 2
    n2, _ = check(B.pack(docs, group=100).collect(), texts)  # many groups, several levels
    assert n2 <= 1.02 * n + 2


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 60000), (4, "<|endoftext|> é  \x85 \U0001f600  x\t\n"), (5, "a" * 5000), (None, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("x")).withColumn("group", F.lit(1))
    check(B.pack(df).collect(), dict(rows))
    assert B.pack(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "same text")] * 3, "doc_id long, text string")
    got = B.pack(twice).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3


def test_same_ids_as_the_tokenizer(spark):
    random.seed(5)
    alphabet = "ab e'sS  \n\t\r\x0b\x85\xa0éßñ中文🙂٣½।’​<|>_-–"
    texts = ["".join(random.choices(alphabet, k=random.randrange(1, 80))) for _ in range(3000)]
    encode = vocabulary.byte_encoder()
    assert [[*encode(t), 0] for t in texts] == reference_ids(texts)


def test_local_search_empties_bins():
    rng = np.random.default_rng(0)
    lengths = rng.integers(200, 900, 3000)
    start, now = [], []
    for i, n in enumerate(lengths):  # next fit: every bin is underfull
        if lengths[now].sum() + n > 2048:
            start.append(now)
            now = []
        now.append(i)
    start.append(now)
    bins = B.local_search([list(b) for b in start], lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and all(lengths[b].sum() <= 2048 for b in bins)
    squares = [sum(int(lengths[b].sum()) ** 2 for b in x) for x in (start, bins)]
    assert squares[1] > squares[0] and len(bins) < 0.9 * len(start) and len(bins) <= 1.02 * len(B.best_fit(lengths, 2048))


def test_very_long_runs(spark):
    """A million blanks, line feeds or letters in one text."""
    texts = {i: "x" + c * 1_000_000 + "y" for i, c in enumerate(" \nz")}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(B.pack(docs).collect(), texts)
