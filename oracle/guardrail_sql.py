"""Oracle SQL (DuckDB) for the guardrail queries."""

from __future__ import annotations

from cohortsmith import constants as K
from cohortsmith.plans.guardrail_queries import CONVERSATION_TERMS, DOC_TERMS, EVENT_TYPE_SHARES, LANG_SHARES, REPORT_TIME

from .cohort_sql import NOTE_SQL, cohort_ctes, dbl, s

PREFILTER = r"\d|@"
TOL = K.DISTRIBUTION_TOLERANCE


def _fault_ctes() -> str:
    """Cohort (customer keys) + faults by segment + records keyed on orders."""
    allc = "[" + ", ".join(s(c) for c in K.CONDITIONS) + "]"
    fault_note = ("printf(' Contact on file: SSN %s, phone %s. History of alcohol abuse.', "
                  "substr(digits, 1, 3) || '-' || substr(digits, 4, 2) || '-' || substr(digits, 6, 4), "
                  "'555-' || substr(digits, 4, 3) || '-' || substr(digits, 6, 4))")
    return cohort_ctes() + f""",
fp0 AS (SELECT c.*, cu.c_mktsegment AS seg FROM cohort c JOIN customer cu ON cu.c_custkey = c.patient_key),
fp1 AS (SELECT patient_key, patient_id, first_name, last_name, middle_initial, name_suffix, full_name, region,
    allergic_reaction, reaction_medication, reaction_type, reaction_severity, seg,
    CASE WHEN seg = 'BUILDING' THEN 'Male' ELSE gender END AS gender,
    CASE WHEN seg = 'MACHINERY' THEN 16 WHEN seg = 'HOUSEHOLD' THEN 25 ELSE age END AS age,
    CASE WHEN seg = 'BUILDING' THEN list_append(comorbidities, 'ovarian_cancer')
         WHEN seg = 'AUTOMOBILE' THEN list_filter(comorbidities, lambda x: x <> 'diabetes')
         WHEN seg = 'HOUSEHOLD' THEN {allc}
         ELSE comorbidities END AS comorbidities,
    CASE WHEN seg = 'AUTOMOBILE' AND NOT list_contains(medications, 'Metformin') THEN list_append(medications, 'Metformin')
         WHEN seg = 'MACHINERY' AND NOT list_contains(medications, 'Lisinopril') THEN list_append(medications, 'Lisinopril')
         ELSE medications END AS medications,
    printf('%09d', patient_key) AS digits
  FROM fp0),
fault_patients AS (SELECT *, {NOTE_SQL} || CASE WHEN seg = 'FURNITURE' THEN {fault_note} ELSE '' END AS note_text FROM fp1),
fault_records AS (SELECT fp.patient_id AS record_id, o.o_orderkey AS record_ord, (o.o_orderkey // 1000)::BIGINT AS batch_id,
    fp.note_text, fp.full_name, fp.age, fp.gender, fp.comorbidities, fp.medications
  FROM orders o JOIN fault_patients fp ON o.o_custkey = fp.patient_key)"""


def _pii_ctes(src: str, id_expr: str, text_expr: str, name: str = "pz", extra: str = "") -> str:
    """``{name}_rows``: (record_id, seq, pattern_type, position, redacted_to, match) + extras;
    ``{name}_6``: per candidate row, matches ``m0..m5`` and redacted ``t6``."""
    ctes = [f"{name}_0 AS (SELECT {id_expr} AS record_id{extra}, {text_expr} AS t0 FROM {src} "
            f"WHERE regexp_matches({text_expr}, '{PREFILTER}'))"]
    for i, (_, rx, tag) in enumerate(K.PII_PATTERNS):
        ctes.append(f"{name}_{i + 1} AS (SELECT *, regexp_extract_all(t{i}, {s(rx)}) AS m{i}, "
                    f"string_split_regex(t{i}, {s(rx)}) AS s{i}, "
                    f"regexp_replace(t{i}, {s(rx)}, {s(tag)}, 'g') AS t{i + 1} FROM {name}_{i})")
    n = len(K.PII_PATTERNS)
    extra_names = "".join(f", {c.split(' AS ')[-1].strip()}" for c in extra.split(",") if c.strip()) if extra else ""
    parts = []
    for i, (pname, _, tag) in enumerate(K.PII_PATTERNS):
        before = " + ".join([f"len(m{k})" for k in range(i)]) or "0"
        pos = (f"coalesce(list_sum(list_transform(s{i}[1:j], lambda x: strlen(x))), 0) + "
               f"coalesce(list_sum(list_transform(m{i}[1:j - 1], lambda x: strlen(x))), 0)")
        parts.append(
            f"SELECT record_id{extra_names}, (({before}) + h.j - 1)::BIGINT AS seq, {s(pname)} AS pattern_type, "
            f"h.pos::BIGINT AS position, {s(tag)} AS redacted_to, h.m AS match FROM "
            f"(SELECT *, unnest(list_transform(m{i}, lambda m, j: {{'m': m, 'j': j, 'pos': {pos}}})) AS h FROM {name}_{n})")
    ctes.append(f"{name}_rows AS ({' UNION ALL '.join(parts)})")
    return ",\n".join(ctes)


def _terms_values(terms: dict) -> str:
    rows, o = [], 0
    for cat, items in terms.items():
        for t in items:
            rows.append(f"({o}, {s(cat)}, {s(t)}, {s(t.lower())})")
            o += 1
    return "terms(ord, category, term, needle) AS (VALUES " + ", ".join(rows) + ")"


def _content_select(src: str, id_expr: str, text_expr: str, extra: str = "") -> str:
    p0 = f"(instr(lower({text_expr}), needle) - 1)"
    start0 = f"greatest({p0} - 20, 0)"
    end0 = f"least({p0} + length(needle) + 20, length({text_expr}))"
    return (f"SELECT {id_expr} AS record_id{extra}, ord::BIGINT AS seq, category, term, "
            f"substring({text_expr}, {start0} + 1, {end0} - {start0}) AS context "
            f"FROM {src} JOIN terms ON contains(lower({text_expr}), needle)")


def _has_ci(arr: str, v: str) -> str:
    return f"(len(list_filter({arr}, lambda x: lower(x) = {s(v.lower())})) > 0)"


def _rules_select(src: str, extra: str = "") -> str:
    mx = "CASE WHEN age < 30 THEN 4 WHEN age < 65 THEN 6 ELSE 10 END"
    rules = [("too_many_comorbidities", f"len(comorbidities) > {mx}",
              f"printf('Age %d has %d comorbidities (max: %d)', age, len(comorbidities), {mx})")]
    for c in K.MALE_INCOMPATIBLE:
        rules.append(("gender_condition_mismatch", f"gender = 'Male' AND {_has_ci('comorbidities', c)}",
                      s(f"Male patient has {c}")))
    for c in K.FEMALE_INCOMPATIBLE:
        rules.append(("gender_condition_mismatch", f"gender = 'Female' AND {_has_ci('comorbidities', c)}",
                      s(f"Female patient has {c}")))
    rules.append(("medication_without_condition",
                  f"{_has_ci('medications', 'metformin')} AND NOT {_has_ci('comorbidities', 'diabetes')}",
                  s("Metformin prescribed without diabetes diagnosis")))
    rules.append(("age_inappropriate_medication",
                  "age < 18 AND len(list_filter(medications, lambda x: contains(x, 'Lisinopril'))) > 0",
                  "printf('Age %d prescribed Lisinopril (adult medication)', age)"))
    return " UNION ALL ".join(
        f"SELECT record_id{extra}, {i}::BIGINT AS seq, {s(n)} AS rule, {d} AS details FROM {src} WHERE {p}"
        for i, (n, p, d) in enumerate(rules))


def _drift_select(src: str, flags, group: str | None, only_violations: bool) -> str:
    g = f"{group}, " if group else ""
    counts = ", ".join(f"count_if({p})::BIGINT AS c{i}" for i, (_, p, _) in enumerate(flags))
    grp = f" GROUP BY {group}" if group else ""
    parts = " UNION ALL ".join(
        f"SELECT {g}{i}::BIGINT AS seq, {s(m)} AS metric, {dbl(e)} AS expected, c{i} AS observed, total FROM dc"
        for i, (m, _, e) in enumerate(flags))
    where = f" WHERE NOT (abs(observed::DOUBLE / total::DOUBLE - expected) <= {dbl(TOL)})" if only_violations else ""
    return (f"WITH dc AS (SELECT {g}count(*)::BIGINT AS total, {counts} FROM {src}{grp}) "
            f"SELECT {g}seq, metric, expected, observed, total, observed::DOUBLE / total::DOUBLE AS actual, "
            f"abs(observed::DOUBLE / total::DOUBLE - expected) AS deviation, "
            f"abs(observed::DOUBLE / total::DOUBLE - expected) <= {dbl(TOL)} AS within_tolerance "
            f"FROM ({parts}) t{where}")


def _cond_flags():
    return [(f"{c}_rate", _has_ci("comorbidities", c), r) for c, r in K.CONDITION_RATES.items()]


def _cat_flags(col, shares):
    return [(f"{v}_rate", f"{col} = {s(v)}", e) for v, e in shares.items()]


def _drift_query(src_ctes: str, src: str, flags, group, only_violations=False) -> str:
    inner = _drift_select(src, flags, group, only_violations)
    head = f"WITH {src_ctes}\n" if src_ctes else ""
    g = f"{group}, " if group else ""
    return (f"{head}SELECT {g}metric, expected, observed, total, actual, deviation, within_tolerance "
            f"FROM ({inner}) q")


def _blocklist_ctes() -> str:
    return cohort_ctes("SELECT s_suppkey AS patient_key FROM supplier", prefix="sup_") + """,
blocklist AS (SELECT DISTINCT lower(trim(regexp_replace(full_name, '\\s+', ' ', 'g'))) AS norm FROM sup_cohort)"""


def _report_ctes(viol_ctes: str, records: str) -> str:
    checks = ", ".join(f"({i}, {s(c)})" for i, c in enumerate(K.CHECKS))
    return f"""WITH {viol_ctes},
checks(ord, chk) AS (VALUES {checks}),
tot AS (SELECT count(*)::BIGINT AS total FROM {records}),
vsum AS (SELECT count(*)::BIGINT AS flagged, count_if(chk = 'uniqueness')::BIGINT AS dup FROM viol),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chk ORDER BY batch_id ASC NULLS LAST, record_ord ASC NULLS LAST,
    seq ASC NULLS FIRST, position ASC NULLS FIRST, metric ASC NULLS FIRST) AS rk
  FROM viol WHERE chk IN ('pii_scan', 'name_safety', 'content_policy', 'distribution', 'uniqueness'))"""


def _report_json_sql(viol_ctes: str, records: str, job_id: str, time: str, ms: int) -> str:
    """The report document as one JSON string."""
    def n(chk):
        return f"'enabled': true, 'triggered': (SELECT count(*) FROM viol WHERE chk = {s(chk)})"

    def examples(chk, value, kind="VARCHAR"):
        return f"(SELECT coalesce(list({value} ORDER BY rk), []) FROM ranked WHERE chk = {s(chk)} AND rk <= 100)"

    def counter(chk, key):
        pairs = f"""string_agg('"' || {key} || '":' || n, ',' ORDER BY {key})"""
        return f"(SELECT CAST('{{' || coalesce({pairs}, '') || '}}' AS JSON) FROM (SELECT {key}, count(*) AS n FROM viol WHERE chk = {s(chk)} GROUP BY 1))"

    return _report_ctes(viol_ctes, records) + f"""
SELECT CAST(to_json({{'job_id': {s(job_id)}, 'timestamp': {s(time)},
  'summary': {{'total_checked': total, 'passed': total - dup, 'flagged': flagged, 'rejected': dup}},
  'checks': {{
    'pii_scan': {{{n('pii_scan')}, 'violations': {examples('pii_scan', "record_id || ': ' || pattern_type")}}},
    'name_safety': {{{n('name_safety')}, 'blocked_names_found': {examples('name_safety', 'blocked_name')}}},
    'content_policy': {{{n('content_policy')}, 'violations_by_category': {counter('content_policy', 'category')},
      'examples': {examples('content_policy', "{'patient_id': record_id, 'category': category, 'term': term, 'context': context}")}}},
    'plausibility': {{{n('plausibility')}, 'violations_by_type': {counter('plausibility', 'rule')}}},
    'distribution': {{{n('distribution')}, 'deviations': {examples('distribution', "{'metric': metric, 'expected': expected, 'actual': actual, 'deviation': deviation, 'within_tolerance': deviation <= " + dbl(TOL) + "}")}}},
    'uniqueness': {{{n('uniqueness')}, 'duplicate_ids': {examples('uniqueness', 'duplicate_id')}}}}},
  'performance_metrics': {{'total_check_time_ms': {ms}, 'avg_time_per_record_ms': {ms}::DOUBLE / total::DOUBLE}}}}) AS VARCHAR) AS report
FROM tot, vsum"""


def _report_sql(viol_ctes: str, records: str, enabled_pii: bool = True) -> str:
    """Long report table from a ``viol`` CTE (chk, record_id, record_ord, batch_id, seq, position, metric,
    pattern_type, category, term, context, rule, duplicate_id, blocked_name)."""
    ex_text = ("CASE chk WHEN 'pii_scan' THEN record_id || ': ' || pattern_type "
               "WHEN 'name_safety' THEN blocked_name "
               "WHEN 'content_policy' THEN concat_ws('|', record_id, category, term, context) "
               "WHEN 'distribution' THEN metric ELSE duplicate_id END")
    return _report_ctes(viol_ctes, records) + f"""
SELECT 'summary' AS section, 'total_checked' AS key, total AS n, NULL::VARCHAR AS text FROM tot
UNION ALL SELECT 'summary', 'passed', total - dup, NULL FROM tot, vsum
UNION ALL SELECT 'summary', 'flagged', flagged, NULL FROM vsum
UNION ALL SELECT 'summary', 'rejected', dup, NULL FROM vsum
UNION ALL SELECT chk, 'enabled', 1::BIGINT, NULL FROM checks
UNION ALL SELECT c.chk, 'triggered', (SELECT count(*) FROM viol v WHERE v.chk = c.chk)::BIGINT, NULL FROM checks c
UNION ALL SELECT 'content_policy.violations_by_category', category, count(*)::BIGINT, NULL FROM viol
  WHERE chk = 'content_policy' GROUP BY category
UNION ALL SELECT 'plausibility.violations_by_type', rule, count(*)::BIGINT, NULL FROM viol
  WHERE chk = 'plausibility' GROUP BY rule
UNION ALL SELECT chk || '.examples', lpad(CAST(rk AS VARCHAR), 3, '0'), rk::BIGINT, {ex_text} FROM ranked WHERE rk <= 100"""


VIOL_COLS = ["chk", "record_id", "record_ord", "batch_id", "seq", "position", "metric", "pattern_type", "category",
             "term", "context", "rule", "duplicate_id", "blocked_name", "expected", "actual", "deviation"]


def _viol_select(chk: str, src: str, cols: dict) -> str:
    out = []
    for c in VIOL_COLS:
        if c == "chk":
            out.append(f"{s(chk)} AS chk")
        elif c in cols:
            out.append(f"{cols[c]} AS {c}")
        else:
            kind = "BIGINT" if c in ("record_ord", "batch_id", "seq", "position") else \
                "DOUBLE" if c in ("expected", "actual", "deviation") else "VARCHAR"
            out.append(f"NULL::{kind} AS {c}")
    return f"SELECT {', '.join(out)} FROM {src}"


def _fault_report(batch_scope: bool = False, report=_report_sql) -> str:
    fr_cols = {"record_id": "record_id", "record_ord": "record_ord", "batch_id": "batch_id"}
    viol = " UNION ALL ".join([
        _viol_select("pii_scan", "fr_pii_rows", dict(fr_cols, seq="seq", position="position",
                                                     pattern_type="pattern_type")),
        _viol_select("name_safety", "fault_records WHERE lower(trim(regexp_replace(full_name, '\\s+', ' ', 'g'))) "
                     "IN (SELECT norm FROM blocklist)", dict(fr_cols, seq="0::BIGINT", blocked_name="full_name")),
        _viol_select("content_policy", "fr_content", dict(fr_cols, seq="seq", category="category", term="term",
                                                          context="context")),
        _viol_select("plausibility", "fr_rules", dict(fr_cols, seq="seq", rule="rule")),
        _viol_select("distribution", "fr_drift", {"record_id": "'aggregate'", "seq": "seq", "metric": "metric",
                                                  **{c: c for c in ("expected", "actual", "deviation")},
                                                  **({"batch_id": "batch_id"} if batch_scope else {})}),
        _viol_select("uniqueness", "fr_dups", dict(fr_cols, seq="0::BIGINT", duplicate_id="record_id")),
    ])
    ctes = ",\n".join([
        _fault_ctes(),
        _blocklist_ctes(),
        _terms_values(K.CONTENT_TERMS),
        _pii_ctes("fault_records", "record_id", "note_text", "fr_pii", ", record_ord, batch_id"),
        "fr_content AS (" + _content_select("fault_records", "record_id", "note_text", ", record_ord, batch_id") + ")",
        "fr_rules AS (" + _rules_select("fault_records", ", record_ord, batch_id") + ")",
        "fr_drift AS (" + _drift_select("fault_records", _cond_flags(), "batch_id" if batch_scope else None, True) + ")",
        "fr_dups AS (SELECT * FROM (SELECT *, min(record_ord) OVER (PARTITION BY "
        + ("batch_id, " if batch_scope else "") + "record_id) AS f FROM fault_records) WHERE record_ord > f)",
        f"viol AS ({viol})",
    ])
    return report(ctes, "fault_records")


def documents_report(record_id: str = "CAST(doc_id AS VARCHAR)", batch: int = 1000, batch_scope: bool = False) -> str:
    """The report over the documents; with ``batch_scope`` drift and duplicates are judged in each batch."""
    dcols = {"record_id": "record_id", "record_ord": "record_ord", "batch_id": "batch_id"}
    viol = " UNION ALL ".join([
        _viol_select("pii_scan", "d_pii_rows", dict(dcols, seq="seq", position="position", pattern_type="pattern_type")),
        _viol_select("content_policy", "d_content", dict(dcols, seq="seq", category="category", term="term",
                                                         context="context")),
        _viol_select("distribution", "d_drift", {"record_id": "'aggregate'", "seq": "seq", "metric": "metric",
                                                 **({"batch_id": "batch_id"} if batch_scope else {})}),
        _viol_select("uniqueness", "d_dups", dict(dcols, seq="0::BIGINT", duplicate_id="record_id")),
    ])
    ctes = ",\n".join([
        f"drec AS (SELECT {record_id} AS record_id, doc_id AS record_ord, (doc_id // {batch})::BIGINT AS batch_id, "
        "coalesce(text, '') AS text, lang FROM documents)",
        _terms_values(DOC_TERMS),
        _pii_ctes("drec", "record_id", "text", "d_pii", ", record_ord, batch_id"),
        "d_content AS (" + _content_select("drec", "record_id", "text", ", record_ord, batch_id") + ")",
        "d_drift AS (" + _drift_select("drec", _cat_flags("lang", LANG_SHARES), "batch_id" if batch_scope else None, True) + ")",
        "d_dups AS (SELECT * FROM (SELECT *, min(record_ord) OVER (PARTITION BY " + ("batch_id, " if batch_scope else "") + "record_id) AS f FROM drec) "
        "WHERE record_ord > f)",
        f"viol AS ({viol})",
    ])
    return _report_sql(ctes, "drec")


def _pii_counts(src: str, text: str) -> str:
    ctes = _pii_ctes(src, "1", text, "pc")
    n = len(K.PII_PATTERNS)
    parts = " UNION ALL ".join(f"SELECT {s(p)} AS pattern_type, coalesce(sum(len(m{i})), 0)::BIGINT AS n_matches "
                               f"FROM pc_{n}" for i, (p, _, _) in enumerate(K.PII_PATTERNS))
    return f"WITH {ctes}\n{parts}"


CONV = "(SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS record_id, text FROM conversations)"

SQL = {
    "pii_scan_counts": _pii_counts("documents", "text"),
    "pii_scan_counts_conversations": _pii_counts("conversations", "text"),
    "pii_redact": "WITH " + _pii_ctes("documents", "doc_id", "text", "pr") +
                  f",\nred AS (SELECT record_id, t{len(K.PII_PATTERNS)} AS t FROM pr_{len(K.PII_PATTERNS)})\n"
                  "SELECT d.doc_id, coalesce(r.t, d.text) AS redacted FROM documents d LEFT JOIN red r ON r.record_id = d.doc_id",
    "pii_positions": "WITH " + _pii_ctes("documents", "CAST(doc_id AS VARCHAR)", "text") +
                     "\nSELECT record_id, seq, pattern_type, position, redacted_to, match FROM pz_rows",
    "pii_positions_notes": "WITH " + _fault_ctes() + ",\n" + _pii_ctes("fault_patients", "patient_id", "note_text") +
                           "\nSELECT record_id, seq, pattern_type, position, redacted_to, match FROM pz_rows",
    "contains_pii_documents": "SELECT doc_id, coalesce(regexp_matches(text, '" + PREFILTER + "') AND (" +
                              " OR ".join(f"regexp_matches(text, {s(rx)})" for _, rx, _ in K.PII_PATTERNS) +
                              "), false) AS contains_pii FROM documents",
    "content_policy_hits": f"WITH {_terms_values(DOC_TERMS)}\n" +
                           _content_select("documents", "CAST(doc_id AS VARCHAR)", "text"),
    "content_policy_notes": f"WITH {_fault_ctes()},\n{_terms_values(K.CONTENT_TERMS)}\n" +
                            _content_select("fault_patients", "patient_id", "note_text"),
    "content_policy_conversations": f"WITH {_terms_values(CONVERSATION_TERMS)}\n" +
                                    _content_select(CONV, "record_id", "text"),
    "row_rules_patients": f"WITH {_fault_ctes()},\nfpr AS (SELECT patient_id AS record_id, * FROM fault_patients)\n" +
                          _rules_select("fpr"),
    "row_rules_orders": """SELECT CAST(o_orderkey AS VARCHAR) AS record_id, seq, rule, details FROM (
  SELECT o_orderkey, 0::BIGINT AS seq, 'non_positive_total' AS rule, printf('Total price %s is not positive', CAST(o_totalprice AS VARCHAR)) AS details FROM orders WHERE o_totalprice <= 0
  UNION ALL SELECT o_orderkey, 1, 'unknown_status', 'Status ' || coalesce(o_orderstatus, 'null') || ' is not one of F, O, P' FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P') OR o_orderstatus IS NULL
  UNION ALL SELECT o_orderkey, 2, 'unknown_priority', 'Priority ' || coalesce(o_orderpriority, 'null') || ' has no 1-5 rank' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-') OR o_orderpriority IS NULL
  UNION ALL SELECT o_orderkey, 3, 'total_above_limit', printf('Total price %s exceeds 500000', CAST(o_totalprice AS VARCHAR)) FROM orders WHERE o_totalprice > 500000.0
  UNION ALL SELECT o_orderkey, 4, 'urgent_order_still_open', 'Urgent order is still open' FROM orders WHERE starts_with(o_orderpriority, '1-') AND o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey, 5, 'order_dated_after_as_of', 'Order date ' || strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || ' is after 1998-08-02' FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1998-08-02'
) t""",
    "distribution_conditions": _drift_query(cohort_ctes()[1:], "cohort", _cond_flags(), "batch_id"),
    "distribution_conditions_faults": _drift_query(_fault_ctes()[1:], "fault_patients", _cond_flags(), None),
    "distribution_events": _drift_query("", "events", _cat_flags("event_type", EVENT_TYPE_SHARES), None),
    "distribution_lang": _drift_query("", "documents", _cat_flags("lang", LANG_SHARES), None),
    "uniqueness_ids": f"WITH {_fault_ctes()}\nSELECT record_id AS duplicate_id, record_ord FROM "
                      "(SELECT *, min(record_ord) OVER (PARTITION BY record_id) AS f FROM fault_records) WHERE record_ord > f",
    "uniqueness_text": "SELECT duplicate_id, record_ord FROM (SELECT md5(text) AS duplicate_id, doc_id AS record_ord, "
                       "min(doc_id) OVER (PARTITION BY md5(text)) AS f FROM documents) WHERE record_ord > f",
    "reject_duplicates": f"WITH {_fault_ctes()}\nSELECT record_id, record_ord FROM "
                         "(SELECT *, count(*) OVER (PARTITION BY record_id) AS n FROM fault_records) WHERE n = 1",
    "name_safety": f"WITH {cohort_ctes()[1:]},\n{_blocklist_ctes()}\nSELECT patient_id AS record_id, full_name AS blocked_name "
                   "FROM cohort WHERE lower(trim(regexp_replace(full_name, '\\s+', ' ', 'g'))) IN (SELECT norm FROM blocklist)",
    "guardrail_report": _fault_report(),
    "guardrail_report_batch": _fault_report(batch_scope=True),
    "guardrail_documents": documents_report(),
}

SQL["guardrail_report_json"] = _fault_report(report=lambda ctes, records: _report_json_sql(ctes, records, "faults", REPORT_TIME, 1234))

# Turns judged one by one, although a conversation's turns share id and ordinal.
SQL["reject_on_error_copies"] = f"""WITH {_terms_values(CONVERSATION_TERMS)},
turns AS (SELECT CAST(conv_id AS VARCHAR) AS record_id, coalesce(text, '') AS text FROM conversations),
clean AS (SELECT * FROM turns WHERE NOT ({' OR '.join(f"regexp_matches(text, {s(rx)})" for _, rx, _ in K.PII_PATTERNS)})),
hits AS ({_content_select('clean', 'record_id', 'text')}),
ids AS (SELECT record_id, count(*) AS n FROM clean GROUP BY record_id),
t AS (SELECT (SELECT count(*) FROM turns) AS total, (SELECT count(*) FROM turns) - (SELECT count(*) FROM clean) AS err,
  (SELECT coalesce(sum(n - 1), 0) FROM ids) AS dup, (SELECT count(*) FROM hits) AS hit, (SELECT count(*) FROM ids WHERE n = 1) AS rest)
SELECT 'total_checked' AS key, total::BIGINT AS n FROM t UNION ALL SELECT 'passed', (total - err - dup)::BIGINT FROM t
UNION ALL SELECT 'flagged', (hit + dup)::BIGINT FROM t UNION ALL SELECT 'rejected', (err + dup)::BIGINT FROM t
UNION ALL SELECT 'passed_rows', rest::BIGINT FROM t"""

# reject_on_error: records without PII or blocked-name errors, then without any copy of a duplicated id.
SQL["reject_on_error"] = "WITH " + ",\n".join([
    _fault_ctes(), _blocklist_ctes(),
    _pii_ctes("fault_records", "record_id", "note_text", "fr_pii", ", record_ord, batch_id"),
    "err AS (SELECT record_id, record_ord FROM fr_pii_rows UNION SELECT record_id, record_ord FROM fault_records "
    "WHERE lower(trim(regexp_replace(full_name, '\\s+', ' ', 'g'))) IN (SELECT norm FROM blocklist))",
    "ok AS (SELECT * FROM fault_records f WHERE NOT EXISTS (SELECT 1 FROM err e WHERE e.record_id = f.record_id "
    "AND e.record_ord = f.record_ord))",
]) + "\nSELECT record_id, record_ord FROM (SELECT *, count(*) OVER (PARTITION BY record_id) AS n FROM ok) WHERE n = 1"
