"""Cohort predicates (FLT-01…12) as reusable columns and joins.

The eval builder evaluates these through its predicate table; the functions here are the
same semantics for direct use on a patient DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import has_ci


def exposed_to(med: str) -> Column:
    """FLT-02: medication list contains ``med`` (case-sensitive)."""
    return F.array_contains("medications", med)


def reactors_to(med: str) -> Column:
    """FLT-03: reacted, and to ``med`` (a null medication never matches)."""
    return F.coalesce(F.col("allergic_reaction") & (F.col("reaction_medication") == med), F.lit(False))


def severe_reactors_to(med: str) -> Column:
    """FLT-04."""
    return reactors_to(med) & F.coalesce(F.col("reaction_severity") == "Severe", F.lit(False))


def reactors_with_type(med: str, reaction: str) -> Column:
    """FLT-05."""
    return reactors_to(med) & F.coalesce(F.col("reaction_type") == reaction, F.lit(False))


def with_condition(cond: str) -> Column:
    """FLT-06 (case-sensitive)."""
    return F.array_contains("comorbidities", cond)


def without_condition(cond: str) -> Column:
    """FLT-07: the complement cohort."""
    return ~with_condition(cond)


def with_both(a: str, b: str) -> Column:
    """FLT-09 / JN-05."""
    return with_condition(a) & with_condition(b)


def has_condition_ci(cond: str) -> Column:
    """FLT-11: case-insensitive membership."""
    return has_ci(F.col("comorbidities"), cond)


def find_by_ids(patients: DataFrame, probes: DataFrame, probe_col: str, found: bool = True) -> DataFrame:
    """FLT-01 batched / JN-03/04: patients whose id is (or, with ``found=False``, probe ids
    that are not) in the probe table — semi / anti joins, null ids never match."""
    p = probes.select(F.col(probe_col).alias("patient_id")).where(F.col("patient_id").isNotNull())
    if found:
        return patients.join(p, "patient_id", "left_semi")
    return p.join(patients.select("patient_id"), "patient_id", "left_anti")
