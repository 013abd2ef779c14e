"""JOB-01 end to end, sinks, strict scan and the streaming run mode."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from cohortsmith.operators import guardrail
from cohortsmith.params import GuardrailParams
from cohortsmith.plans import jobs
from cohortsmith.sinks.writers import write_csv, write_jsonl
from cohortsmith.sources.jsonl import read_patients
from cohortsmith.streaming import guardrail_stream as ST


def test_generate_job(spark):
    out = tempfile.mkdtemp(prefix="cohortsmith-job-")
    res = jobs.generate(spark, spark.range(300), "id", out,
                        eval_ids=spark.range(60).withColumnRenamed("id", "eval_idx"), job_id="t1")
    s = res.summary
    assert s["patients_generated"] == 300 and s["evals_generated"] == 60
    assert s["completed_batches"] == 1 and "guardrail_report" in s["output_files"]
    assert spark.read.json(f"{out}/clinical_notes").count() == 300
    assert spark.read.json(f"{out}/chunks").select("chunk_id").first()[0].startswith("chunk_P")
    report = json.loads("".join(r.value for r in spark.read.text(f"{out}/guardrail_report").collect()))
    assert report["summary"]["total_checked"] == 300 and report["job_id"] == "t1"
    assert set(report["checks"]) == {"pii_scan", "name_safety", "content_policy", "plausibility", "distribution",
                                     "uniqueness"}
    summary = json.loads("".join(r.value for r in spark.read.text(f"{out}/summary").collect()))
    assert summary["patients_generated"] == 300
    # explicit nulls are kept in the JSON lines
    line = spark.read.text(f"{out}/patients").first().value
    assert '"reaction_type":null' in line or '"reaction_type":' in line
    scan = read_patients(spark, f"{out}/patients")
    assert scan.records.count() == 300 and scan.rejects.count() == 0


def test_files_in_name_order_are_in_id_order(spark):
    out = tempfile.mkdtemp(prefix="cohortsmith-sorted-")
    n = write_jsonl(spark.range(5000).repartition(8).select(F.format_string("P%06d", "id").alias("patient_id")), out, "patient_id")
    parts = sorted(x for x in os.listdir(out) if x.startswith("part-"))
    ids = [json.loads(line)["patient_id"] for x in parts for line in open(os.path.join(out, x))]
    assert n == 5000 and ids == [f"P{i:06d}" for i in range(5000)]


def test_csv_sink(spark):
    out = tempfile.mkdtemp(prefix="cohortsmith-csv-")
    df = spark.createDataFrame([("P1", ["a", "b"], {"k": "v"})], "id string, arr array<string>, m map<string,string>")
    write_csv(df, out)
    row = spark.read.option("header", "true").csv(out).first()
    assert row.arr == "a|b" and row.m == '{"k":"v"}'


def test_strict_scan_drops_bad_lines(spark):
    path = tempfile.mkdtemp(prefix="cohortsmith-jsonl-")
    good = ('{"patient_id":"P1","name":{"first_name":"A","last_name":"B"},"age":40,"gender":"Female",'
            '"region":"West","comorbidities":[],"medications":[],"allergic_reaction":false,"clinical_notes":'
            '[{"note_id":"note_P1_0","patient_id":"P1","note_type":"primary_care","text":"t"}],'
            '"metadata":{"seed":42,"batch_id":0}}')
    missing = good.replace('"age":40,', "")
    bad_enum = good.replace('"Female"', '"Other"')
    others = [good.replace(*x) for x in (
        ('"note_type":"primary_care",', ""), ('"note_id":"note_P1_0","patient_id":"P1",', '"note_id":"note_P1_0",'),
        ('"age":40', '"age":300'), ('"comorbidities":[]', '"comorbidities":[null]'), ('"seed":42', '"seed":-1'),
        ('"last_name":"B"', '"last_name":"B","middle_initial":"ABC"'), ('"clinical_notes":[', '"clinical_notes":[null,'))]
    no_notes = good.replace(good[good.index("[{"):good.index("}],") + 2], "[]")
    initial = good.replace('"last_name":"B"', '"last_name":"B","middle_initial":"C"')
    lines = [good, no_notes, initial, missing, bad_enum, "{broken", "", *others]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
    scan = read_patients(spark, path)
    assert scan.records.count() == 3
    assert scan.rejects.count() == 3 + len(others)


def _records(d):
    return d.select(F.col("doc_id").cast("string").alias("record_id"), "record_ord", "batch_id", F.array("text").alias("texts"))


def _stream_rows(spark, rows, files, base):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "record_ord long, doc_id long, batch_id long, text string")
    return ST.split_source(df, "batch_id", f"{base}/src", files), df


def test_stream_per_batch_uniqueness(spark):
    base = tempfile.mkdtemp(prefix="cohortsmith-stream-")
    rows = [(i % 5, i // 10, f"text {i}") for i in range(20)]  # ids repeat inside every batch
    src, df = _stream_rows(spark, rows, 2, base)
    res = ST.run_guardrail(spark, src, df.schema, _records, f"{base}/out")
    # duplicates are counted within each batch: rows - distinct ids, summed over batches
    assert res.violations.where(F.col("check") == "uniqueness").count() == 20 - 5 * 2
    got = {(r.section, r.key): r.n for r in res.report_rows.collect()}
    assert got["summary", "total_checked"] == 20 and got["summary", "rejected"] == got["uniqueness", "triggered"] == 10


def test_running_report_is_the_batch_report_and_survives_a_retry(spark):
    base = tempfile.mkdtemp(prefix="cohortsmith-stream-")
    rows = [(i % 7, i // 25, f"mail a{i}@example.com, 123-45-6789" if i % 3 else "clean") for i in range(200)]
    src, df = _stream_rows(spark, rows, 4, base)
    p = GuardrailParams(scope="batch", max_examples=9, checked_at="2024-01-01")
    res = ST.run_guardrail(spark, src, df.schema, _records, f"{base}/out", p)
    exp = guardrail.run(_records(df), p)
    assert sorted(map(str, res.report_rows.collect())) == sorted(map(str, exp.report_rows.collect()))
    docs = [guardrail.report_json(r, "job", 7, "now").first()[0] for r in (res, exp)]
    assert docs[0] == docs[1]
    # epoch 3 judged again from the same rows: nothing is counted twice
    last = spark.read.parquet(f"{base}/out/violations").where("epoch = 3").select("batch_id").distinct()
    ST.judge_epoch(_records(df.join(last, "batch_id", "left_semi")), 3, f"{base}/out", p)
    again = ST.read_report(spark, f"{base}/out")
    assert sorted(map(str, again.report_rows.collect())) == sorted(map(str, exp.report_rows.collect()))
    assert again.violations.count() == exp.violations.count()
    # a second run takes only new files
    more, _ = _stream_rows(spark, rows, 4, f"{base}/more")
    spark.read.parquet(more).write.mode("append").parquet(src)
    total = ST.run_guardrail(spark, src, df.schema, _records, f"{base}/out", p).report_rows
    assert total.where("section = 'summary' and key = 'total_checked'").first().n == 400


def test_duplicates_across_micro_batches(spark):
    base = tempfile.mkdtemp(prefix="cohortsmith-stream-")
    rows = [("2024-01-01 01:00", 1), ("2024-01-01 09:00", 1), ("2024-01-01 23:00", 1), ("2024-01-02 00:30", 1),
            ("2024-01-02 01:00", 2), ("2024-01-02 08:00", None), ("2024-01-02 09:00", None), ("2024-01-02 23:59", 2)]
    df = spark.createDataFrame(rows, "ts string, k long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    src = ST.split_source_in_time_order(df, "ts", f"{base}/src", 4)
    dup = ST.window_duplicates(ST.run_event_windows(spark, src, df.schema, "ts", "k", f"{base}/out"))
    assert sorted((str(r.window_start), r.duplicate_id, r.n_extra) for r in dup.collect()) == [
        ("2024-01-01 00:00:00", "1", 2), ("2024-01-02 00:00:00", "2", 1)]


def test_event_windows_ignore_session_time_zone(spark):
    import duckdb

    from cohortsmith.plans import io_queries

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted((str(r.window_start), r.category, r.n) for r in
                     io_queries.stream_event_windows(spark, "/root/testdata/sf0.001").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    exp = sorted((str(a), b, c) for a, b, c in duckdb.sql(
        "SELECT date_trunc('day', ts), event_type, count(*) FROM '/root/testdata/sf0.001/events.parquet' "
        "GROUP BY ALL").fetchall())
    assert got == exp


SF = "/root/testdata/sf0.001"


def test_cohorts_are_generated_by_many_tasks(spark):
    """The key tables are a single row group each; generation from them is not one task's work."""
    from cohortsmith.plans import cohort_queries, faults
    from cohortsmith.sources import tables

    for p in (cohort_queries.patients(spark, SF), cohort_queries.order_patients(spark, SF),
              tables.supplier_keys(spark, SF), tables.customer_keys(spark, SF)):
        sizes = [n for n in p.select(p.columns[0]).rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
        assert len(sizes) > 1 and max(sizes) < sum(sizes) / 2
    assert "RoundRobinPartitioning" in faults.fault_patients(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_streamed_documents_lie_in_small_files_of_whole_batches(spark, monkeypatch):
    """Four micro-batches whatever the number of files; no file is a quarter of the table."""
    from cohortsmith.plans import io_queries

    seen = {}

    def run_guardrail(spark, src, schema, records, out, files_per_trigger=1, **checks):
        seen.update(src=src, per=files_per_trigger, schema=schema)

    monkeypatch.setattr(io_queries.ST, "run_guardrail", run_guardrail)
    io_queries._streamed_documents(spark, "/root/testdata/sf0.01")
    docs = spark.read.schema(seen["schema"]).parquet(seen["src"])
    per_file = docs.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("batch_id").alias("b")).collect()
    assert max(r.n for r in per_file) < sum(r.n for r in per_file) / 4 + 1 and len(per_file) > 4
    assert -(-len(docs.inputFiles()) // seen["per"]) <= 4
    assert sum(len(r.b) for r in per_file) == len({b for r in per_file for b in r.b})
