"""Registered cohort queries: each takes ``(spark, sf_dir)`` and returns a flat DataFrame
(arrays joined to strings) so that it can be compared with the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.names import full_name, initials, sort_key
from ..functions.text import one_decimal
from ..operators import cohort as C
from ..sources.tables import customer_keys, order_keys


def patients(spark: SparkSession, sf_dir: str, with_notes: bool = True) -> DataFrame:
    """The cohort keyed on ``customer.c_custkey`` (grows with the customer table)."""
    return C.generate_cohort(customer_keys(spark, sf_dir), "c_custkey", with_notes=with_notes)


def order_patients(spark: SparkSession, sf_dir: str, with_notes: bool = True) -> DataFrame:
    """The 10x larger cohort keyed on ``orders.o_orderkey``."""
    return C.generate_cohort(order_keys(spark, sf_dir), "o_orderkey", with_notes=with_notes)


def cohort_profile(spark, sf_dir):
    p = patients(spark, sf_dir, with_notes=False)
    n = F.col("name")
    return p.select(
        "patient_id", F.col("age").cast("long").alias("age"), "gender", "region", "risk_bucket",
        n["first_name"].alias("first_name"), n["last_name"].alias("last_name"),
        n["middle_initial"].alias("middle_initial"), n["name_suffix"].alias("name_suffix"),
        full_name(n).alias("full_name"), sort_key(n).alias("sort_key"), initials(n).alias("initials"),
        F.col("metadata.batch_id").alias("batch_id"),
    )


def cohort_conditions(spark, sf_dir):
    p = patients(spark, sf_dir, with_notes=False)
    return p.select("patient_id", F.array_join("comorbidities", ",").alias("comorbidities"),
                    F.size("comorbidities").cast("long").alias("n_conditions"))


def cohort_medications(spark, sf_dir):
    p = patients(spark, sf_dir, with_notes=False)
    return p.select("patient_id", F.array_join("medications", ",").alias("medications"),
                    F.size("medications").cast("long").alias("n_medications"))


def cohort_reactions(spark, sf_dir):
    p = patients(spark, sf_dir, with_notes=False)
    return p.select("patient_id", "allergic_reaction", "reaction_medication", "reaction_type", "reaction_severity")


def cohort_notes(spark, sf_dir):
    return C.clinical_notes(patients(spark, sf_dir)).select("note_id", "patient_id", "note_type", "text")


def cohort_chunks(spark, sf_dir):
    ch = C.chunks(patients(spark, sf_dir))
    return ch.select("chunk_id", "patient_id", "source", F.col("metadata")["note_type"].alias("note_type"), "text")


def cohort_prevalence(spark, sf_dir):
    """AGG-01/08: patients and rate per condition, one pass (conditional counts, no explode)."""
    p = patients(spark, sf_dir, with_notes=False)
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(F.array_contains("comorbidities", c)).alias(c) for c in K.CONDITIONS]
    wide = p.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in K.CONDITIONS)
    long = wide.selectExpr("total", f"stack({len(K.CONDITIONS)}, {stack}) AS (condition, n_patients)")
    return long.select("condition", F.col("n_patients").cast("long").alias("n_patients"),
                       F.try_divide(F.col("n_patients").cast("double"), F.col("total").cast("double")).alias("rate"))


def exposure_reaction_rates(spark, sf_dir, source=patients):
    """T-A1 for every drug: exposed / reactors / severe and the answer text, one aggregate."""
    p = source(spark, sf_dir, with_notes=False)
    aggs = []
    for d in K.ALL_DRUGS:
        exposed = F.array_contains("medications", d)
        react = F.col("allergic_reaction") & (F.col("reaction_medication") == d)
        aggs += [F.count_if(exposed).alias(f"{d}__e"), F.count_if(react).alias(f"{d}__r"),
                 F.count_if(react & (F.col("reaction_severity") == "Severe")).alias(f"{d}__s")]
    wide = p.agg(*aggs)
    stack = ", ".join(f"'{d}', `{d}__e`, `{d}__r`, `{d}__s`" for d in K.ALL_DRUGS)
    long = wide.selectExpr(f"stack({len(K.ALL_DRUGS)}, {stack}) AS (drug, exposed, reactors, severe)")
    e, r = F.col("exposed").cast("long"), F.col("reactors").cast("long")
    pct = F.when(e == 0, F.lit(0.0)).otherwise(F.try_divide(r.cast("double"), e.cast("double")) * F.lit(100.0))
    return long.select(
        "drug", e.alias("exposed"), r.alias("reactors"), F.col("severe").cast("long").alias("severe"),
        F.concat(one_decimal(pct), F.lit("% ("), r.cast("string"), F.lit(" out of "), e.cast("string"),
                 F.lit(" exposed)")).alias("answer"),
    )


def exposure_reaction_rates_orders(spark, sf_dir):
    """The same report on the orders-keyed cohort (10x rows)."""
    return exposure_reaction_rates(spark, sf_dir, source=order_patients)


QUERIES = {
    "cohort_profile": cohort_profile,
    "cohort_conditions": cohort_conditions,
    "cohort_medications": cohort_medications,
    "cohort_reactions": cohort_reactions,
    "cohort_notes": cohort_notes,
    "cohort_chunks": cohort_chunks,
    "cohort_prevalence": cohort_prevalence,
    "exposure_reaction_rates": exposure_reaction_rates,
    "exposure_reaction_rates_orders": exposure_reaction_rates_orders,
}


# ---------------------------------------------------------------------------
# cohort predicates (FLT-*) and corpus lists (EVL-08/09)
# ---------------------------------------------------------------------------

def cohort_filters(spark, sf_dir):
    """FLT-02…11: size of every single-parameter cohort, one aggregation pass."""
    from ..operators import filters as FL

    p = patients(spark, sf_dir, with_notes=False)
    specs = []
    for d in K.ALL_DRUGS:
        specs += [("exposed_to", d, FL.exposed_to(d)), ("reactors_to", d, FL.reactors_to(d)),
                  ("severe_reactors_to", d, FL.severe_reactors_to(d))]
    for c in K.CONDITIONS:
        specs += [("with_condition", c, FL.with_condition(c)), ("without_condition", c, FL.without_condition(c)),
                  ("has_condition_ci", c.upper(), FL.has_condition_ci(c.upper()))]
    for d in K.REACTION_DRUGS:
        for t in K.REACTION_MODEL[d]["types"]:
            specs.append(("reactors_with_type", f"{d}/{t}", FL.reactors_with_type(d, t)))
    specs.append(("with_both", "diabetes/hypertension", FL.with_both("diabetes", "hypertension")))
    wide = p.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(specs)])
    stack = ", ".join(f"'{n}', '{k}', `c{i}`" for i, (n, k, _) in enumerate(specs))
    return wide.selectExpr(f"stack({len(specs)}, {stack}) AS (predicate, param, n)").select(
        "predicate", "param", F.col("n").cast("long"))


def cohort_lookup(spark, sf_dir):
    """FLT-01 batched: patients of customers that placed orders (left-semi join)."""
    from ..operators import filters as FL
    from ..sources.tables import read_table

    probes = read_table(spark, sf_dir, "orders", "o_custkey").select(
        F.format_string("P%09d", F.col("o_custkey")).alias("pid"))
    return FL.find_by_ids(patients(spark, sf_dir, with_notes=False), probes, "pid").select("patient_id", "age", "gender")


def cohort_lookup_missing(spark, sf_dir):
    """JN-04: probe ids (one per order key) that match no patient (left-anti join)."""
    from ..operators import filters as FL
    from ..sources.tables import read_table

    probes = read_table(spark, sf_dir, "orders", "o_orderkey").select(
        F.format_string("P%09d", F.col("o_orderkey")).alias("pid"))
    return FL.find_by_ids(patients(spark, sf_dir, with_notes=False), probes, "pid", found=False)


def corpus_lists(spark, sf_dir):
    """EVL-08/09: sorted distinct reaction types and regions of the corpus."""
    p = patients(spark, sf_dir, with_notes=False)
    return p.agg(F.array_join(F.array_sort(F.collect_set("reaction_type")), ",").alias("reaction_types"),
                 F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions"))


QUERIES.update({
    "cohort_filters": cohort_filters,
    "cohort_lookup": cohort_lookup,
    "cohort_lookup_missing": cohort_lookup_missing,
    "corpus_lists": corpus_lists,
})
