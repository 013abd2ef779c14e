"""Guardrail integration (GRD-19), cohort determinism / partition independence / rates."""

import json
import math

from pyspark.sql import functions as F

from cohortsmith import constants as K
from cohortsmith.functions.names import name_struct
from cohortsmith.operators import distribution, guardrail, rules
from cohortsmith.operators.cohort import generate_cohort
from cohortsmith.params import CohortParams, GuardrailParams


def _record(spark):
    rows = [
        ("P001", 0, 0, 45, "Female", ["diabetes"], ["Metformin"], "Patient note one."),
        ("P002", 1, 0, 30, "Female", [], [], "Call 555-123-4567"),
        ("P003", 2, 0, 25, "Female", ["diabetes", "hypertension", "asthma", "copd", "obesity"], [], "Note three."),
    ]
    df = spark.createDataFrame(rows, "record_id string, record_ord long, batch_id long, age int, gender string, "
                                     "comorbidities array<string>, medications array<string>, text string")
    return df.withColumn("texts", F.array("text")).withColumn(
        "name", name_struct(F.lit("Test"), F.lit("Patient")))


def test_guardrail_integration(spark):
    res = guardrail.run(_record(spark), row_rules=rules.patient_rules(),
                        drift=lambda d, g: distribution.condition_drift(d, group_cols=g))
    rows = {(r.section, r.key): r.n for r in res.report_rows.collect()}
    assert rows[("uniqueness", "triggered")] == 0
    assert rows[("pii_scan", "triggered")] > 0
    assert rows[("plausibility.violations_by_type", "too_many_comorbidities")] == 1
    assert rows[("summary", "total_checked")] == 3
    assert rows[("summary", "rejected")] == 0
    report = guardrail.report_json(res).first().report
    assert '"pii_scan"' in report and '"P002: PHONE"' in report


def test_fail_on_error_rejects_pii_records(spark):
    from cohortsmith.params import GuardrailParams

    res = guardrail.run(_record(spark), GuardrailParams(fail_on_error=True), row_rules=rules.patient_rules())
    assert sorted(r.record_id for r in res.passed.collect()) == ["P001", "P003"]


def _cohort(spark, n, parts, **kw):
    return generate_cohort(spark.range(0, n, 1, parts), "id", CohortParams(**kw), with_notes=True)


def test_partition_independent(spark):
    cols = ["patient_id", "age", "gender", "region", "comorbidities", "medications", "reaction_severity",
            "clinical_notes"]
    a = {tuple(map(str, r)) for r in _cohort(spark, 2000, 1).select(*cols).collect()}
    b = {tuple(map(str, r)) for r in _cohort(spark, 2000, 17).select(*cols).collect()}
    assert a == b and len(a) == 2000


def test_batch_size_does_not_change_draws(spark):
    a = _cohort(spark, 500, 4, batch_size=10).select("patient_id", "comorbidities").collect()
    b = _cohort(spark, 500, 4, batch_size=1000).select("patient_id", "comorbidities").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_rates_within_five_standard_errors(spark):
    n = 20000
    df = _cohort(spark, n, 8)
    aggs = [F.avg(F.array_contains("comorbidities", c).cast("double")).alias(c) for c in K.CONDITIONS]
    aggs += [F.avg(F.array_contains("medications", "Aspirin").cast("double")).alias("aspirin"),
             F.avg((F.col("gender") == "Female").cast("double")).alias("female")]
    got = df.agg(*aggs).first().asDict()
    expected = dict(K.CONDITION_RATES, female=K.FEMALE_PROBABILITY)
    for k, p in expected.items():
        assert abs(got[k] - p) < 5 * math.sqrt(p * (1 - p) / n), k
    assert 0.18 < got["aspirin"] < 0.30  # mixture of .18, .3276 (age > 55) and 1 (CAD)


def test_xxhash_mode_runs(spark):
    df = _cohort(spark, 1000, 4, hash="xxhash64")
    assert df.count() == 1000


def test_each_copy_is_judged_by_its_own_text(spark):
    """Ids 1, 1, 2, 3, 3, a number in both rows of 1 and in one of 3: three are rejected, 2 and the
    clean copy of 3 pass, and the summary agrees with the output."""
    ssn = "SSN 123-45-6789"
    rows = spark.createDataFrame([(1, ssn), (1, ssn), (2, "fine"), (3, ssn), (3, "fine too")], "id long, text string")
    for copies in (rows, rows.withColumn("id", F.concat(F.lit("r"), F.col("id").cast("string")))):
        res = guardrail.run(guardrail.text_records(copies, "id", ["text"]), GuardrailParams(fail_on_error=True, checked_at="2024-05-06 07:08:09"))
        summary = {r.key: r.n for r in res.report_rows.where("section = 'summary'").collect()}
        assert sorted(r.record_id.lstrip("r") for r in res.passed.collect()) == ["2", "3"]
        assert (summary["total_checked"], summary["passed"], summary["rejected"]) == (5, 2, 3)
        assert res.violations.count() == 0


def test_report_document_is_structured(spark):
    rows = spark.createDataFrame([(1, "SSN 123-45-6789"), (2, "history of alcohol abuse | and more"), (2, "x")], "id long, text string")
    res = guardrail.run(guardrail.text_records(rows, "id", ["text"]), GuardrailParams(checked_at="2024-05-06 07:08:09"),
                        drift=lambda d, g: distribution.categorical_drift(d, "id", {1: 0.9, 2: 0.66}, group_cols=g))
    assert {str(r.timestamp) for r in res.violations.collect()} == {"2024-05-06 07:08:09"}
    doc = json.loads(guardrail.report_json(res, "j", 300, "now").first().report)
    assert doc["timestamp"] == "now" and doc["performance_metrics"] == {"total_check_time_ms": 300, "avg_time_per_record_ms": 100.0}
    example = doc["checks"]["content_policy"]["examples"][0]
    assert example["patient_id"] == "2" and set(example) == {"patient_id", "category", "term", "context"} and "|" in example["context"]
    deviation = doc["checks"]["distribution"]["deviations"]
    assert deviation == [{"metric": "1_rate", "expected": 0.9, "actual": 1 / 3, "deviation": abs(1 / 3 - 0.9), "within_tolerance": False}]
    assert doc["checks"]["uniqueness"] == {"enabled": True, "triggered": 1, "duplicate_ids": ["2"]}
    empty = guardrail.run(guardrail.text_records(rows.where("false"), "id", ["text"]), GuardrailParams(fail_on_error=True))
    assert json.loads(guardrail.report_json(empty).first().report)["checks"]["content_policy"] == {
        "enabled": True, "triggered": 0, "violations_by_category": {}, "examples": []}
