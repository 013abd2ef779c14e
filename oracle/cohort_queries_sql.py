"""Oracle SQL (DuckDB) for the cohort queries."""

from __future__ import annotations

from cohortsmith import constants as K

from .cohort_sql import s, with_cohort

ORDERS_KEYS = "SELECT o_orderkey AS patient_key FROM orders"


def _rates(key_sql=None):
    parts = []
    for d in K.ALL_DRUGS:
        parts.append(f"""SELECT {s(d)} AS drug,
  count_if(list_contains(medications, {s(d)}))::BIGINT AS exposed,
  count_if(allergic_reaction AND reaction_medication = {s(d)})::BIGINT AS reactors,
  count_if(allergic_reaction AND reaction_medication = {s(d)} AND reaction_severity = 'Severe')::BIGINT AS severe
FROM cohort""")
    body = f"""SELECT drug, exposed, reactors, severe,
  printf('%.1f', CASE WHEN exposed = 0 THEN 0.0::DOUBLE ELSE reactors::DOUBLE / exposed::DOUBLE * 100.0::DOUBLE END)
  || '% (' || CAST(reactors AS VARCHAR) || ' out of ' || CAST(exposed AS VARCHAR) || ' exposed)' AS answer
FROM ({' UNION ALL '.join(parts)}) t"""
    return with_cohort(body, key_sql) if key_sql else with_cohort(body)


def _prevalence():
    parts = " UNION ALL ".join(
        f"SELECT {s(c)} AS condition, count_if(list_contains(comorbidities, {s(c)}))::BIGINT AS n_patients, "
        f"count(*)::BIGINT AS total FROM cohort" for c in K.CONDITIONS)
    return with_cohort(f"SELECT condition, n_patients, n_patients::DOUBLE / total::DOUBLE AS rate FROM ({parts}) t")


SQL = {
    "cohort_profile": with_cohort(
        "SELECT patient_id, age::BIGINT AS age, gender, region, risk_bucket, first_name, last_name, middle_initial, "
        "name_suffix, full_name, sort_key, initials, batch_id FROM cohort"),
    "cohort_conditions": with_cohort(
        "SELECT patient_id, comorbidities_str AS comorbidities, len(comorbidities)::BIGINT AS n_conditions FROM cohort_n"),
    "cohort_medications": with_cohort(
        "SELECT patient_id, medications_str AS medications, len(medications)::BIGINT AS n_medications FROM cohort_n"),
    "cohort_reactions": with_cohort(
        "SELECT patient_id, allergic_reaction, reaction_medication, reaction_type, reaction_severity FROM cohort"),
    "cohort_notes": with_cohort(
        "SELECT 'note_' || patient_id || '_0' AS note_id, patient_id, 'primary_care' AS note_type, note_text AS text "
        "FROM cohort_n"),
    "cohort_chunks": with_cohort(
        "SELECT 'chunk_' || patient_id || '_note_0' AS chunk_id, patient_id, 'clinical_note_' || patient_id || '_0' AS source, "
        "'primary_care' AS note_type, note_text AS text FROM cohort_n"),
    "cohort_prevalence": _prevalence(),
    "exposure_reaction_rates": _rates(),
    "exposure_reaction_rates_orders": _rates(ORDERS_KEYS),
}


def _filters():
    rows = []
    for d in K.ALL_DRUGS:
        rows += [("exposed_to", d, f"list_contains(medications, {s(d)})"),
                 ("reactors_to", d, f"coalesce(allergic_reaction AND reaction_medication = {s(d)}, false)"),
                 ("severe_reactors_to", d, f"coalesce(allergic_reaction AND reaction_medication = {s(d)} "
                                           f"AND reaction_severity = 'Severe', false)")]
    for c in K.CONDITIONS:
        rows += [("with_condition", c, f"list_contains(comorbidities, {s(c)})"),
                 ("without_condition", c, f"NOT list_contains(comorbidities, {s(c)})"),
                 ("has_condition_ci", c.upper(), f"len(list_filter(comorbidities, lambda x: lower(x) = {s(c)})) > 0")]
    for d in K.REACTION_DRUGS:
        for t in K.REACTION_MODEL[d]["types"]:
            rows.append(("reactors_with_type", f"{d}/{t}",
                         f"coalesce(allergic_reaction AND reaction_medication = {s(d)} AND reaction_type = {s(t)}, false)"))
    rows.append(("with_both", "diabetes/hypertension",
                 "list_contains(comorbidities, 'diabetes') AND list_contains(comorbidities, 'hypertension')"))
    body = " UNION ALL ".join(f"SELECT {s(n)} AS predicate, {s(k)} AS param, count_if({e})::BIGINT AS n FROM cohort"
                              for n, k, e in rows)
    return with_cohort(body)


SQL.update({
    "cohort_filters": _filters(),
    "cohort_lookup": with_cohort("SELECT patient_id, age, gender FROM cohort WHERE patient_id IN "
                                 "(SELECT printf('P%09d', o_custkey) FROM orders WHERE o_custkey IS NOT NULL)"),
    "cohort_lookup_missing": with_cohort("SELECT printf('P%09d', o_orderkey) AS patient_id FROM orders "
                                         "WHERE printf('P%09d', o_orderkey) NOT IN (SELECT patient_id FROM cohort)"),
    "corpus_lists": with_cohort("SELECT array_to_string(list_sort(list_distinct(list(reaction_type) FILTER "
                                "(WHERE reaction_type IS NOT NULL))), ',') AS reaction_types, "
                                "array_to_string(list_sort(list_distinct(list(region))), ',') AS regions FROM cohort"),
})
