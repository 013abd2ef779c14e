"""Fault injection for the guardrail checks, derived from the tables themselves.

Generated cohorts satisfy almost every rule, so the checks are exercised on a variant whose
faults are chosen by the customer's market segment (no sampling, no id subsets):

* BUILDING   — gender Male with ``ovarian_cancer``          (gender/condition mismatch)
* AUTOMOBILE — Metformin without diabetes                    (medication without condition)
* MACHINERY  — age 16 with Lisinopril                        (age-inappropriate medication)
* HOUSEHOLD  — age 25 with all seven conditions              (too many comorbidities)
* FURNITURE  — note mentions an SSN, a phone number and alcohol abuse (PII, content)

``fault_records`` then keys the records on ``orders`` (one record per order of the
customer), so every customer with several orders is a duplicated id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.cohort import attach_notes, generate_cohort
from ..operators.guardrail import patient_records
from ..session import materialize, spread
from ..sources.tables import read_table

FAULT_NOTE = " Contact on file: SSN %s, phone %s. History of alcohol abuse."


def fault_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = spread(read_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"))
    base = generate_cohort(cust, "c_custkey", with_notes=False)
    seg = cust.select(F.col("c_custkey").alias("patient_key"), "c_mktsegment")
    df = base.join(seg, "patient_key")  # same key, one row each side
    s, c, m, a = F.col("c_mktsegment"), F.col("comorbidities"), F.col("medications"), F.col("age")
    df = df.withColumns({
        "gender": F.when(s == "BUILDING", F.lit("Male")).otherwise(F.col("gender")),
        "age": F.when(s == "MACHINERY", F.lit(16)).when(s == "HOUSEHOLD", F.lit(25)).otherwise(a),
        "comorbidities": F.when(s == "BUILDING", F.array_append(c, F.lit("ovarian_cancer")))
        .when(s == "AUTOMOBILE", F.filter(c, lambda x: x != F.lit("diabetes")))
        .when(s == "HOUSEHOLD", F.array(*[F.lit(x) for x in K.CONDITIONS]))
        .otherwise(c),
        "medications": F.when((s == "AUTOMOBILE") & ~F.array_contains(m, "Metformin"), F.array_append(m, F.lit("Metformin")))
        .when((s == "MACHINERY") & ~F.array_contains(m, "Lisinopril"), F.array_append(m, F.lit("Lisinopril")))
        .otherwise(m),
    })
    digits = F.format_string("%09d", F.col("patient_key"))
    ssn = F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4))
    phone = F.concat(F.lit("555-"), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 6, 4))
    df = attach_notes(df)  # notes are rendered from the faulted columns
    note = F.col("clinical_notes")[0]
    fault_text = F.concat(note["text"], F.format_string(FAULT_NOTE, ssn, phone))
    df = df.withColumn("clinical_notes", F.when(
        F.col("c_mktsegment") == "FURNITURE",
        F.array(note.withField("text", fault_text))).otherwise(F.col("clinical_notes")))
    return df.drop("c_mktsegment")


def fault_records(spark: SparkSession, sf_dir: str, batch_size: int = 1000) -> DataFrame:
    """One record per order, ``record_ord = o_orderkey`` (unique), patient of ``o_custkey``."""
    pats = materialize(patient_records(fault_patients(spark, sf_dir)))
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    pats = pats.withColumnRenamed("record_ord", "patient_key")
    j = orders.join(pats.drop("batch_id"), orders.o_custkey == pats.patient_key, "inner")
    return j.select(
        "record_id", F.col("o_orderkey").alias("record_ord"),
        F.floor(F.col("o_orderkey") / F.lit(batch_size)).cast("long").alias("batch_id"),
        "texts", "patient_id", "name", "age", "gender", "comorbidities", "medications")
