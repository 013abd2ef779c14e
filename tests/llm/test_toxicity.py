"""Toxicity: segments against all segments of a text, held-out accuracy, and edges."""

import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortsmith.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def brute_segments(scores):
    """The best segment, then the same left and right of it (each shortest, leftmost first)."""
    def inside(lo, hi):
        spans = [(-(sum(scores[i:j])), j - i, i, j) for i, j in itertools.combinations(range(lo, hi + 1), 2)]
        if not spans or min(spans)[0] >= 0:
            return []
        total, _, i, j = min(spans)
        return inside(lo, i) + [(i, j, -total)] + inside(j, hi)

    return inside(0, len(scores))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-8, -4, -3, -2, -1, 0.5, 1, 2, 3, 5, 7]), max_size=14))
def test_segments(scores):
    got = X.maximal_segments(np.array(scores, float))
    assert sorted(s for _, _, s in got) == pytest.approx(sorted(s for _, _, s in brute_segments(scores)))
    assert all(sum(scores[i:j]) == pytest.approx(s) for i, j, s in got)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_many_words_in_linear_time():
    rng = np.random.default_rng(1)
    assert X.maximal_segments(rng.normal(-0.01, 1, 300_000))
    assert len(X.maximal_segments(np.tile([1.0, -2.0], 200_000))) == 200_000
    assert len(X.maximal_segments(np.tile([2.0, -1.0], 200_000))) == 1


def toxic_words(n=240):
    """Clean words, insults, and forms of a stem that never stand twice."""
    rng = np.random.default_rng(7)
    plain = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "am") for b in ("em", "um", "or", "et", "ia", "us")]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, rng.integers(5, 60)))
        toxic = int(i % 4 == 0)
        if toxic:
            words.insert(int(rng.integers(0, len(words))), "Nasty" if i % 8 else f"grumbl{''.join(rng.choice(list('aeioustr'), 5))}")
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_words_and_unseen_forms(spark):
    rows, labels = toxic_words()
    got = X.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows}
    assert all(r.predicted == truth[r.doc_id] for r in got if r.held_out)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    texts = dict(rows)
    for r in got:  # the passages are where the insults stand
        if truth[r.doc_id]:
            words = X.words_of(texts[r.doc_id])
            assert any(w == "nasty" or w.startswith("grumbl") for p in r.passages for w in words[p.start:p.end])


def test_held_out_accuracy_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = X.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in got if r.toxic == 1]
    clean = [1 - r.predicted for r in got if r.toxic == 0]
    assert len(caught) >= 5 and np.mean(caught) > 0.6 and np.mean(clean) > 0.97


def test_copies_count_once(spark):
    """500 copies of one toxic document make none of its plain words toxic."""
    rows, labels = toxic_words(80)
    odd = "lorem ipsum unusual nasty"
    rows += [(1000 + i, odd) for i in range(500)]
    labels += [(1000 + i, 1) for i in range(500)]
    model = X.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.word("unusual") < 1 and model.word("nasty") > 1


def test_edges(spark):
    rows, labels = toxic_words(60)
    rows += [(None, "nasty nasty"), (500, None), (501, ""), (502, "12 34"), (0, "a second row of one id"), (503, "dolor " * 50_000 + "nasty")]
    labels += [(0, 1), (None, 1), (501, None), (501, 0), (0, None), (999, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, toxic int, cells string, size int")
    got = X.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    least = min(r.score for r in got)
    assert all(r.score == least and not r.passages for r in got if r.doc_id in (500, 501, 502))
    assert next(r for r in got if r.doc_id is None).held_out is True

    def scores(own):
        return [r.score for r in X.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(own, "doc_id long, toxic int")).collect()]

    assert set(scores([])) == {0.0} and set(scores([(i, 1) for i in range(20)])) == {1.0}
    assert X.score(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() == []


def test_few_labels_do_not_move_the_texts(spark, monkeypatch):
    """Labels are broadcast up to their limit, beyond it joined; either way the same rows."""
    from cohortsmith.llm import toxicity

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200, 3)], "doc_id long, toxic int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = toxicity.labelled(docs, labels)
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(toxicity, "BROADCAST", 1)
        many = toxicity.labelled(docs, labels)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(few.collect()) == sorted(many.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
