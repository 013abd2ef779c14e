"""Registered guardrail queries over the driver tables and the (fault-injected) cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.names import full_name
from ..operators import content, distribution, guardrail, names_safety, pii, rules, uniqueness
from ..operators.cohort import generate_cohort
from ..params import GuardrailParams
from ..session import materialize
from ..sources.tables import read_table, supplier_keys
from .cohort_queries import patients
from .faults import fault_patients, fault_records

# Expected shares used by the categorical drift queries (parameters of those queries).
EVENT_TYPE_SHARES = {"view": 0.2, "click": 0.2, "purchase": 0.2, "signup": 0.2, "error": 0.2}
LANG_SHARES = {"en": 0.6, "es": 0.1, "fr": 0.15, "de": 0.15}
# Default terms plus a user category with terms that occur in the documents.
DOC_TERMS = dict(K.CONTENT_TERMS, governance=["license", "token"])
#: Time that the registered report document carries.
REPORT_TIME = "2024-01-01T00:00:00.000000Z"
CONVERSATION_TERMS = dict(DOC_TERMS, harassment=["hate"])


def _docs(spark, sf_dir, *cols):
    return read_table(spark, sf_dir, "documents", *cols)


def _conversations(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"),
                    "text")


def pii_scan_counts(spark, sf_dir):
    return pii.counts(_docs(spark, sf_dir, "text"), "text")


def pii_scan_counts_conversations(spark, sf_dir):
    return pii.counts(_conversations(spark, sf_dir), "text")


def pii_redact(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "text")
    return pii.redact_column(d, "text", "redacted").select("doc_id", "redacted")


def pii_positions(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "text")
    return pii.scan(d, "doc_id", "text").select(F.col("record_id").cast("string").alias("record_id"), "seq",
                                                "pattern_type", "position", "redacted_to", "match")


def _notes(spark, sf_dir):
    """The texts of all notes of every patient."""
    notes = fault_patients(spark, sf_dir).select("patient_id", F.explode_outer("clinical_notes").alias("note"))
    return notes.where(F.col("note").isNotNull()).select("patient_id", "note.text")


def pii_positions_notes(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    return pii.scan(notes, "patient_id", "text").select("record_id", "seq", "pattern_type", "position",
                                                        "redacted_to", "match")


def contains_pii_documents(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "text")
    return d.select("doc_id", pii.contains_pii(F.col("text")).alias("contains_pii"))


def content_policy_hits(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "text")
    return content.check(d, "doc_id", "text", DOC_TERMS).select(
        F.col("record_id").cast("string").alias("record_id"), "seq", "category", "term", "context")


def content_policy_notes(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    return content.check(notes, "patient_id", "text").select("record_id", "seq", "category", "term", "context")


def content_policy_conversations(spark, sf_dir):
    return content.check(_conversations(spark, sf_dir), "record_id", "text", CONVERSATION_TERMS).select(
        "record_id", "seq", "category", "term", "context")


def row_rules_patients(spark, sf_dir):
    return rules.check(fault_patients(spark, sf_dir), "patient_id", rules.patient_rules()).select(
        "record_id", "seq", "rule", "details")


def row_rules_orders(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
                   "o_orderdate")
    return rules.check(o, "o_orderkey", rules.order_rules()).select(
        F.col("record_id").cast("string").alias("record_id"), "seq", "rule", "details")


def _drift_cols(df):
    return df.select(*[c for c in df.columns if c != "seq"])


def distribution_conditions(spark, sf_dir):
    p = patients(spark, sf_dir, with_notes=False).select("comorbidities", F.col("metadata.batch_id").alias("batch_id"))
    return _drift_cols(distribution.condition_drift(p, group_cols=["batch_id"], only_violations=False))


def distribution_conditions_faults(spark, sf_dir):
    p = fault_patients(spark, sf_dir).select("comorbidities")
    return _drift_cols(distribution.condition_drift(p, only_violations=False))


def distribution_events(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_type")
    return _drift_cols(distribution.categorical_drift(e, "event_type", EVENT_TYPE_SHARES, only_violations=False))


def distribution_lang(spark, sf_dir):
    d = _docs(spark, sf_dir, "lang")
    return _drift_cols(distribution.categorical_drift(d, "lang", LANG_SHARES, only_violations=False))


def uniqueness_ids(spark, sf_dir):
    r = fault_records(spark, sf_dir)
    return uniqueness.violations(r, "record_id", "record_ord").select("duplicate_id", "record_ord")


def uniqueness_text(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5("text").alias("text_md5"))
    return uniqueness.violations(d, "text_md5", "doc_id").select("duplicate_id", "record_ord")


def reject_duplicates(spark, sf_dir):
    r = fault_records(spark, sf_dir)
    return uniqueness.reject_duplicates(r, "record_id").select("record_id", "record_ord")


def _blocklist(spark, sf_dir):
    """Names of the cohort keyed on ``supplier.s_suppkey`` (a second, independent cohort)."""
    return generate_cohort(supplier_keys(spark, sf_dir), "s_suppkey", with_notes=False).select(full_name(F.col("name")).alias("name"))


def name_safety(spark, sf_dir):
    p = patients(spark, sf_dir, with_notes=False)
    return names_safety.check(p, "patient_id", full_name(F.col("name")), _blocklist(spark, sf_dir)).select(
        "record_id", "blocked_name")


def _fault_pipeline(spark, sf_dir, params: GuardrailParams):
    recs = materialize(fault_records(spark, sf_dir))
    return guardrail.run(recs, params, row_rules=rules.patient_rules(),
                         drift=lambda d, g: distribution.condition_drift(d, group_cols=g),
                         name_col=full_name(F.col("name")), blocklist=_blocklist(spark, sf_dir))


def guardrail_report(spark, sf_dir):
    return _fault_pipeline(spark, sf_dir, GuardrailParams()).report_rows


def guardrail_report_batch(spark, sf_dir):
    """The same pipeline with the reference's per-batch scope for drift and duplicates."""
    return _fault_pipeline(spark, sf_dir, GuardrailParams(scope="batch")).report_rows


def guardrail_report_json(spark, sf_dir):
    """The report document, compact, with time and duration given."""
    return guardrail.report_json(_fault_pipeline(spark, sf_dir, GuardrailParams()), "faults", 1234, REPORT_TIME, pretty=False)


def reject_on_error(spark, sf_dir):
    res = _fault_pipeline(spark, sf_dir, GuardrailParams(fail_on_error=True))
    return res.passed.select("record_id", "record_ord")


def reject_on_error_copies(spark, sf_dir):
    """GRD-15 where ids and ordinals repeat (a conversation's turns share its id): every turn is
    judged by its own text, then every conversation with several clean turns is a duplicate. The
    summary, and the number of rows that pass."""
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "text")
    res = guardrail.run(guardrail.text_records(turns, "conv_id", ["text"]), GuardrailParams(fail_on_error=True), content_terms=CONVERSATION_TERMS)
    summary = res.report_rows.where(F.col("section") == "summary").select("key", "n")
    return summary.unionByName(res.passed.agg(F.count(F.lit(1)).alias("n")).select(F.lit("passed_rows").alias("key"), "n"))


def guardrail_documents(spark, sf_dir):
    d = _docs(spark, sf_dir, "doc_id", "text", "lang")
    recs = guardrail.text_records(d, "doc_id", ["text"])
    res = guardrail.run(recs, GuardrailParams(), content_terms=DOC_TERMS,
                        drift=lambda x, g: distribution.categorical_drift(x, "lang", LANG_SHARES, group_cols=g))
    return res.report_rows


QUERIES = {
    "pii_scan_counts": pii_scan_counts,
    "pii_scan_counts_conversations": pii_scan_counts_conversations,
    "pii_redact": pii_redact,
    "pii_positions": pii_positions,
    "pii_positions_notes": pii_positions_notes,
    "contains_pii_documents": contains_pii_documents,
    "content_policy_hits": content_policy_hits,
    "content_policy_notes": content_policy_notes,
    "content_policy_conversations": content_policy_conversations,
    "row_rules_patients": row_rules_patients,
    "row_rules_orders": row_rules_orders,
    "distribution_conditions": distribution_conditions,
    "distribution_conditions_faults": distribution_conditions_faults,
    "distribution_events": distribution_events,
    "distribution_lang": distribution_lang,
    "uniqueness_ids": uniqueness_ids,
    "uniqueness_text": uniqueness_text,
    "reject_duplicates": reject_duplicates,
    "name_safety": name_safety,
    "guardrail_report": guardrail_report,
    "guardrail_report_batch": guardrail_report_batch,
    "guardrail_report_json": guardrail_report_json,
    "reject_on_error_copies": reject_on_error_copies,
    "reject_on_error": reject_on_error,
    "guardrail_documents": guardrail_documents,
}
