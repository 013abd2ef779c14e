"""Explicit schemas of the exchanged tables (§1.3); never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

NAME = T.StructType([
    T.StructField("first_name", T.StringType(), False),
    T.StructField("last_name", T.StringType(), False),
    T.StructField("middle_initial", T.StringType(), True),
    T.StructField("name_suffix", T.StringType(), True),
])

NOTE = T.StructType([
    T.StructField("note_id", T.StringType(), False),
    T.StructField("patient_id", T.StringType(), False),
    T.StructField("note_type", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
])

PATIENT = T.StructType([
    T.StructField("patient_id", T.StringType(), False),
    T.StructField("name", NAME, False),
    T.StructField("age", T.IntegerType(), False),
    T.StructField("gender", T.StringType(), False),
    T.StructField("region", T.StringType(), False),
    T.StructField("comorbidities", T.ArrayType(T.StringType()), False),
    T.StructField("medications", T.ArrayType(T.StringType()), False),
    T.StructField("allergic_reaction", T.BooleanType(), False),
    T.StructField("reaction_medication", T.StringType(), True),
    T.StructField("reaction_type", T.StringType(), True),
    T.StructField("reaction_severity", T.StringType(), True),
    T.StructField("clinical_notes", T.ArrayType(NOTE), False),
    T.StructField("metadata", T.StructType([
        T.StructField("seed", T.LongType(), False),
        T.StructField("batch_id", T.LongType(), False),
    ]), False),
])

# required (non-optional) top-level fields and the enum domains checked on read
REQUIRED = [f.name for f in PATIENT.fields if not f.nullable]
DOMAINS = {
    "gender": ["Female", "Male"],
    "reaction_severity": ["Mild", "Moderate", "Severe"],
}

#: JSONL records of the eval set and of its RAGAS projection.
EVAL_RECORD = ("eval_id string, query string, answer string, ground_truth_patient_ids array<string>, "
               "ground_truth_facts array<struct<patient_id:string,fact:string>>, contexts array<string>, context_chunk_ids array<string>, "
               "query_type string, difficulty string, metadata struct<seed:bigint,batch_id:bigint>")
RAGAS_RECORD = "question string, answer string, contexts array<string>, ground_truth string"
