"""The pipeline's stages against their operators' brute-force versions, one after the other."""

import corpus_pipeline as P
from cohortsmith.llm import decontaminate

from test_bin_packing import check
from test_line_frequency import slow as slow_quality
from test_pii_boost import slow as slow_spans
from test_simhash import slow_components


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    now = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        assert len(got) == docs.count() and all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "quality rules":
            want = dict(slow_quality(now)[1])
        elif name == "near duplicates":
            want = {d: t for d, t, _ in now if any(c == d for x, _, c in slow_components([(d, t) for d, t, _ in now]) if x == d)}
        elif name == "decontamination":
            exact = {d for d, t, _ in now if any(decontaminate.fold(b) in decontaminate.fold(t) for b in bench)}
            # what goes shares a stretch of an item: 10 % edits leave nine characters in a row
            stretches = {f[i:i + 9] for f in map(decontaminate.fold, bench) for i in range(len(f) - 8)}
            gone = [decontaminate.fold(t) for d, t, _ in now if d not in got]
            assert not exact & set(got) and all(any(f[i:i + 9] in stretches for i in range(len(f))) for f in gone)
            assert len(gone) < 0.3 * len(now)
            want = {d: t for d, t, _ in now if d in got}
        else:
            for d, t, _ in now:
                if not slow_spans(t):
                    assert got[d] == t
                for s, _, e in slow_spans(t):
                    assert t[s:e] not in got[d]
            want = got
        assert got == want
        source = {d: s for d, _, s in now}
        now = [(d, t, source[d]) for d, t in got.items()]
    check(P.STAGES[-1][1](spark, docs, sf).collect(), {d: t for d, t, _ in now})


def test_run_and_empty_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    assert P.run(spark, sf).count() > 100
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
