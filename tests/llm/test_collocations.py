"""Collocations against a count in Python; the filters against dictionaries."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortsmith.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, min_count, longest, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    kept = {g: a for g, a in f.items() if a >= min_count and len(g[1]) > 1}
    out = []
    for (lang, g), a in kept.items():
        if any(len(h) > len(g) and m == lang and b >= a and any(h[i:i + len(g)] == g for i in range(len(h))) for (m, h), b in kept.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(g), a, left, right, n[lang], score))
    result = []
    for lang in n:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        result += [(lang, i + 1, *x[1:]) for i, x in enumerate(best)]
    return sorted(result)


def run(spark, rows, **kw):
    df = C.collocations(spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted(map(tuple, df.collect()))


def corpus(n=400, seed=3):
    rng = np.random.default_rng(seed)
    names = ["a", "B", "the", "of", "é", "ß", "x1", "new", "york", " ", "rare"]
    weight = np.array([9, 8, 7, 6, 3, 3, 2, 2, 2, 1, .2])
    rows = []
    for i in range(n):
        words = list(rng.choice(names, rng.integers(0, 40), p=weight / weight.sum()))
        words = [w + rng.choice(["", "", "", "", ",", ".", "\n", "\t", ";"]) for w in words]
        rows.append((i, " ".join(words) + " New York City" * int(rng.integers(0, 2)), [None, "en", "de", "und", ""][i % 5]))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "held": 50, "merge": 40}])
def test_against_brute_force(spark, sizes):
    rows = corpus()
    want = brute(rows, 4, 5, 50)
    assert len(want) > 60
    assert run(spark, rows, min_count=4, top=50, **sizes) == want


def test_edges(spark):
    rows = [(1, None, "en"), (None, "", None), (3, "a a a a a", "en"), (3, "a a a a a", "en"), (4, " \t ", "en"), (5, "b. b. b", "fr")]
    assert run(spark, rows, min_count=2) == brute(rows, 2, 5, 2000)
    assert run(spark, [], min_count=2) == []
    assert run(spark, [(1, "one two", "en")]) == []


def test_long_text_and_clashing_columns(spark):
    text = "lorem ipsum dolor " * 3000
    rows = [(1, text, "en")]
    want = brute(rows, 100, 5, 2000)
    assert run(spark, rows, block=64, held=500) == want
    wide = spark.createDataFrame([(1, text, "en", 1, 2, 3, "x", 4)], SCHEMA + ", a long, n long, block long, word string, gid long")
    assert sorted(map(tuple, C.collocations(wide).collect())) == want


def test_chunks_of_a_text(monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 7)
    text = "Alpha beta,gamma  averyveryverylongword delta\tÉpsilon."
    got = [w for ws in C._tokens(text) for w in ws]
    assert got == [b"alpha", b"beta", b"\xff", b"gamma", b"averyveryverylongword", b"delta", "Épsilon".encode(), b"\xff", b"\xff"]


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 5), st.integers(1, 62), st.data())
def test_filters_lose_nothing(n, bits, data):
    """permute, pack, encode and decode give the same n-grams and counts, for any width."""
    words = data.draw(st.lists(st.tuples(*[st.integers(0, (1 << bits) - 1)] * n), min_size=1, max_size=40))
    block_bits = min(data.draw(st.integers(0, 6)), n * bits)
    columns = [np.array(c, np.uint64) for c in zip(*words)]
    limbs, counts = C._added(C.pack(C.permute(columns, bits), bits), None)
    counts = counts * data.draw(st.sampled_from([1, 254, 255, 10**12]))
    of = (limbs[0] >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(counts), np.int64)
    got = Counter()
    for b in set(of.tolist()):
        own = of == b
        q, runs, rests, counters = C.encode([x[own] for x in limbs], counts[own], n * bits, block_bits)
        back, c = C.decode(b, q, runs, rests, counters, int(own.sum()), n * bits, block_bits)
        for gram, k in zip(zip(*(x.tolist() for x in C.permute(C.unpack(back, n, bits), bits, back=True))), c.tolist()):
            got[gram] += k
    assert got == {g: k * (counts.sum() // len(words)) for g, k in Counter(words).items()}


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "PAIR_LEAST", 4)
    monkeypatch.setattr(C, "PAIR_BITS", 4)
    rows = corpus(150, 5)
    assert run(spark, rows, min_count=3, top=80) == brute(rows, 3, 5, 80)
