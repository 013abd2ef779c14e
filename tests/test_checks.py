"""GRD-01…14 on hand-made rows (cases restated in FIXTURES.md part A)."""

from pyspark.sql import functions as F

from cohortsmith.operators import content, distribution, pii, rules, uniqueness


def _texts(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


def test_pii_redaction_and_counts(spark):
    df = _texts(spark, [("a", "Patient SSN is 123-45-6789"), ("b", "Email: user@example.com"),
                        ("c", "Patient has diabetes and hypertension"),
                        ("d", "SSN: 123-45-6789, Phone: 555-123-4567"), ("e", "Call 555-123-4567")])
    red = {r.id: r.red for r in pii.redact_column(df, "text", "red").collect()}
    assert red["a"] == "Patient SSN is [REDACTED_SSN]"
    assert red["b"] == "Email: [REDACTED_EMAIL]"
    assert red["c"] == "Patient has diabetes and hypertension"
    assert "[REDACTED_SSN]" in red["d"] and "[REDACTED_PHONE]" in red["d"]
    hits = pii.scan(df, "id", "text").groupBy("record_id").count().collect()
    n = {r.record_id: r["count"] for r in hits}
    assert n == {"a": 1, "b": 1, "d": 2, "e": 1}
    flags = {r.id: r.c for r in df.select("id", pii.contains_pii(F.col("text")).alias("c")).collect()}
    assert flags == {"a": True, "b": True, "c": False, "d": True, "e": True}


def test_pii_byte_positions_after_masking(spark):
    df = _texts(spark, [("x", "SSN: 123-45-6789, é 987-65-4321")])
    pos = [r.position for r in pii.scan(df, "id", "text").orderBy("seq").collect()]
    assert pos == [5, 21]


def test_content_policy(spark):
    df = _texts(spark, [("a", "Patient reports suicidal ideation"), ("b", "Patient has diabetes and hypertension"),
                        ("c", "Patient reports suicidal ideation and domestic violence"),
                        ("d", "History of alcohol abuse")])
    hits = content.check(df, "id", "text").collect()
    by = {}
    for h in hits:
        by.setdefault(h.record_id, []).append(h)
    assert "b" not in by
    assert len(by["c"]) >= 2
    assert any("suicidal ideation" in h.context for h in by["a"])
    assert sorted(h.term for h in by["d"]) == ["abuse", "alcohol abuse"]


def _patients(spark, rows):
    return spark.createDataFrame(rows, "id string, age int, gender string, comorbidities array<string>, "
                                       "medications array<string>")


def test_plausibility_rules(spark):
    df = _patients(spark, [
        ("p1", 25, "Female", ["diabetes", "hypertension", "asthma", "copd", "obesity", "ckd"], []),
        ("p2", 50, "Male", ["ovarian_cancer"], []),
        ("p3", 45, "Female", ["hypertension"], ["Metformin"]),
        ("p4", 45, "Female", ["diabetes", "hypertension"], ["Metformin", "Lisinopril"]),
        ("p5", 16, "Female", [], ["Lisinopril"]),
    ])
    out = rules.check(df, "id", rules.patient_rules()).orderBy("record_id", "seq").collect()
    by = {}
    for r in out:
        by.setdefault(r.record_id, []).append(r)
    assert by["p1"][0].rule == "too_many_comorbidities"
    assert by["p1"][0].details == "Age 25 has 6 comorbidities (max: 4)"
    assert by["p2"][0].details == "Male patient has ovarian_cancer"
    assert by["p3"][0].rule == "medication_without_condition"
    assert "p4" not in by
    assert by["p5"][0].details == "Age 16 prescribed Lisinopril (adult medication)"


def _cohort(spark, n_diabetic):
    rows = [(i, ["diabetes"] if i < n_diabetic else []) for i in range(100)]
    return spark.createDataFrame(rows, "i int, comorbidities array<string>")


def test_distribution_drift(spark):
    v12 = {r.metric for r in distribution.condition_drift(_cohort(spark, 12)).collect()}
    assert "diabetes_rate" not in v12
    # zero prevalence of the common conditions fires; copd's deviation is exactly .05 (strict >)
    assert {"hypertension_rate", "obesity_rate", "asthma_rate", "coronary_artery_disease_rate"} <= v12
    assert "copd_rate" not in v12
    v25 = {r.metric for r in distribution.condition_drift(_cohort(spark, 25)).collect()}
    assert "diabetes_rate" in v25


def test_uniqueness(spark):
    def viol(ids):
        df = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, ord long")
        return sorted(r.duplicate_id for r in uniqueness.violations(df, "id", "ord").collect())

    assert viol(["P001", "P002", "P003"]) == []
    assert viol(["P001", "P002", "P001"]) == ["P001"]
    assert viol(["P001", "P002", "P001", "P002", "P003"]) == ["P001", "P002"]
    df = spark.createDataFrame([("P001", 0), ("P002", 1), ("P001", 2)], "id string, ord long")
    assert [r.id for r in uniqueness.reject_duplicates(df, "id").collect()] == ["P002"]


def test_one_pass_scan_equals_separate_operators(spark):
    from cohortsmith.operators import text_checks
    from cohortsmith.plans.guardrail_queries import DOC_TERMS
    from cohortsmith.sources.tables import read_table

    docs = read_table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    both = text_checks.scan(docs, "doc_id", "text", terms=DOC_TERMS)
    p1 = {(r.record_id, r.seq, r.pattern_type, r.position) for r in pii.scan(docs, "doc_id", "text").collect()}
    p2 = {(r.record_id, r.seq, r.pattern_type, r.position) for r in both.where("check = 'pii_scan'").collect()}
    c1 = {(r.record_id, r.term, r.context) for r in content.check(docs, "doc_id", "text", DOC_TERMS).collect()}
    c2 = {(r.record_id, r.term, r.context) for r in both.where("check = 'content_policy'").collect()}
    assert p1 == p2 and c1 == c2 and (p1 or c1)
