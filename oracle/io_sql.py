"""Oracle SQL (DuckDB) for the source/sink, dataset-job and streaming queries."""

from __future__ import annotations

from cohortsmith import constants as K
from cohortsmith.plans.guardrail_queries import DOC_TERMS, EVENT_TYPE_SHARES
from cohortsmith.plans.io_queries import STREAM_BATCH

from .cohort_sql import cohort_ctes, dbl, s, with_cohort
from .guardrail_sql import (_content_select, _cond_flags, _drift_select, _pii_ctes, _rules_select, _terms_values,
                            _viol_select, documents_report)


def _summary() -> str:
    parts = ["SELECT 'records' AS metric, '' AS key, count(*)::BIGINT AS value FROM cohort",
             "SELECT 'distinct_ids', '', count(DISTINCT patient_id)::BIGINT FROM cohort",
             "SELECT 'reactors', '', count_if(allergic_reaction)::BIGINT FROM cohort"]
    parts += [f"SELECT 'cond', {s(c)}, count_if(list_contains(comorbidities, {s(c)}))::BIGINT FROM cohort"
              for c in K.CONDITIONS]
    parts += [f"SELECT 'exposed', {s(d)}, count_if(list_contains(medications, {s(d)}))::BIGINT FROM cohort"
              for d in K.ALL_DRUGS]
    parts += [f"SELECT 'reactors', {s(d)}, count_if(reaction_medication = {s(d)})::BIGINT FROM cohort"
              for d in K.REACTION_DRUGS]
    parts += [f"SELECT 'nulls', {s(c)}, count_if({c} IS NULL)::BIGINT FROM cohort"
              for c in ("reaction_medication", "reaction_type", "reaction_severity")]
    return with_cohort(" UNION ALL ".join(parts))


def _validate() -> str:
    rec = ("crec AS (SELECT patient_id AS record_id, patient_key AS record_ord, batch_id, note_text, age, gender, "
           "comorbidities, medications FROM cohort_n)")
    cols = {"record_id": "record_id", "record_ord": "record_ord", "batch_id": "batch_id"}
    viol = " UNION ALL ".join([
        _viol_select("pii_scan", "c_pii_rows", dict(cols, seq="seq")),
        _viol_select("content_policy", "c_content", dict(cols, seq="seq")),
        _viol_select("plausibility", "c_rules", dict(cols, seq="seq")),
        _viol_select("distribution", "c_drift", {"record_id": "'aggregate'", "seq": "seq"}),
        _viol_select("uniqueness", "c_dups", dict(cols, duplicate_id="record_id")),
    ])
    ctes = ",\n".join([
        cohort_ctes()[1:], rec, _terms_values(K.CONTENT_TERMS),
        _pii_ctes("crec", "record_id", "note_text", "c_pii", ", record_ord, batch_id"),
        "c_content AS (" + _content_select("crec", "record_id", "note_text", ", record_ord, batch_id") + ")",
        "c_rules AS (" + _rules_select("crec", ", record_ord, batch_id") + ")",
        "c_drift AS (" + _drift_select("crec", _cond_flags(), None, True) + ")",
        "c_dups AS (SELECT * FROM (SELECT *, min(record_ord) OVER (PARTITION BY record_id) AS f FROM crec) "
        "WHERE record_ord > f)",
        f"viol AS ({viol})",
        "tot AS (SELECT count(*)::BIGINT AS total FROM crec)",
        "vs AS (SELECT count(*)::BIGINT AS flagged, count_if(chk = 'uniqueness')::BIGINT AS dup FROM viol)",
    ])
    trig = " UNION ALL ".join(
        f"SELECT 'triggered:{c}' AS metric, (SELECT count(*) FROM viol WHERE chk = {s(c)})::BIGINT AS value"
        for c in K.CHECKS)
    return f"""WITH {ctes}
SELECT 'records' AS metric, total AS value FROM tot
UNION ALL SELECT 'rejected_lines', 0::BIGINT
UNION ALL SELECT 'unresolved_notes', 0::BIGINT
UNION ALL SELECT 'summary:total_checked', total FROM tot
UNION ALL SELECT 'summary:passed', total - dup FROM tot, vs
UNION ALL SELECT 'summary:flagged', flagged FROM vs
UNION ALL SELECT 'summary:rejected', dup FROM vs
UNION ALL {trig}"""


def _stream_guardrail() -> str:
    return ("WITH " + _terms_values(DOC_TERMS) + ",\n" +
            _pii_ctes("documents", "CAST(doc_id AS VARCHAR)", "text") + ",\n" +
            "ct AS (" + _content_select("documents", "CAST(doc_id AS VARCHAR)", "text") + ")\n" +
            "SELECT 'pii_scan' AS \"check\", pattern_type AS detail, count(*)::BIGINT AS n FROM pz_rows GROUP BY 2 "
            "UNION ALL SELECT 'content_policy', term, count(*)::BIGINT FROM ct GROUP BY 2")


def _event_windows() -> str:
    exp = "CASE category " + " ".join(f"WHEN {s(k)} THEN {dbl(v)}" for k, v in EVENT_TYPE_SHARES.items()) + " END"
    return f"""WITH c AS (SELECT date_trunc('day', ts) AS window_start, event_type AS category, count(*)::BIGINT AS n
  FROM events GROUP BY ALL),
t AS (SELECT *, (sum(n) OVER (PARTITION BY window_start))::BIGINT AS total, {exp} AS expected FROM c)
SELECT window_start, category, n, total, expected, n::DOUBLE / total::DOUBLE AS actual,
  abs(n::DOUBLE / total::DOUBLE - expected) AS deviation,
  abs(n::DOUBLE / total::DOUBLE - expected) <= {dbl(K.DISTRIBUTION_TOLERANCE)} AS within_tolerance
FROM t"""


SQL = {
    "generate_job": " UNION ALL ".join(
        f"SELECT '{name}' AS output, count(*)::BIGINT AS n FROM customer"
        for name in ("patients", "clinical_notes", "chunks", "evals", "ragas_dataset")),
    "jsonl_roundtrip": with_cohort(
        "SELECT patient_id, age::BIGINT AS age, gender, region, comorbidities_str AS comorbidities, "
        "medications_str AS medications, reaction_medication, reaction_type, reaction_severity, note_text, batch_id "
        "FROM cohort_n"),
    "jsonl_rejects": "SELECT 'records' AS status, count(*)::BIGINT AS n FROM customer UNION ALL "
                     "SELECT 'rejected', count(*)::BIGINT FROM customer "
                     "WHERE c_mktsegment IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE')",
    "dataset_summary": _summary(),
    "dataset_validate": _validate(),
    "stream_guardrail": _stream_guardrail(),
    "stream_guardrail_report": documents_report("md5(coalesce(text, ''))", STREAM_BATCH, batch_scope=True),
    "stream_duplicates": "SELECT date_trunc('day', ts) AS window_start, CAST(user_id AS VARCHAR) AS duplicate_id, "
                         "count(*)::BIGINT - 1 AS n_extra FROM events WHERE user_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "stream_event_windows": _event_windows(),
}
