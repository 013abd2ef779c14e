"""Strict JSON-lines scan of stored patient records (SRC-03).

The file is read with the explicit schema in PERMISSIVE mode plus a corrupt-record column;
a line is kept only if it parsed, every required field is present (Spark keeps a missing
required field as null even under a non-null schema, so this is checked explicitly), no list
holds a null, and enums, ages (0 to 255), counters and the middle initial are in their domain. Blank lines are skipped by the reader. The rejected
lines are returned too, so the caller can count what was dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

CORRUPT = "_corrupt_record"


@dataclass
class ScanResult:
    records: DataFrame
    rejects: DataFrame  # the raw text of every dropped line


def _valid() -> F.Column:
    ok = F.col(CORRUPT).isNull()
    for f in S.REQUIRED:
        ok = ok & F.col(f).isNotNull()
    for f in ("first_name", "last_name"):
        ok = ok & F.col(f"name.{f}").isNotNull()
    ok = ok & F.col("gender").isin(*S.DOMAINS["gender"])
    ok = ok & (F.col("reaction_severity").isNull() | F.col("reaction_severity").isin(*S.DOMAINS["reaction_severity"]))
    ok = ok & F.col("metadata.seed").isNotNull() & F.col("metadata.batch_id").isNotNull()
    ok = ok & F.col("age").between(0, 255) & (F.col("metadata.seed") >= 0) & (F.col("metadata.batch_id") >= 0)
    ok = ok & (F.col("name.middle_initial").isNull() | (F.char_length("name.middle_initial") == 1))
    for f in ("comorbidities", "medications"):
        ok = ok & ~F.exists(f, lambda x: x.isNull())
    note = [f.name for f in S.NOTE.fields]
    ok = ok & F.forall("clinical_notes", lambda n: n.isNotNull() & F.forall(F.array(*[n[f] for f in note]), lambda x: x.isNotNull()))
    return F.coalesce(ok, F.lit(False))


def read_patients(spark: SparkSession, path: str) -> ScanResult:
    sch = T.StructType(S.PATIENT.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    raw = (spark.read.schema(sch).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
           .json(path))
    flagged = raw.withColumn("_ok", _valid())
    records = flagged.where("_ok").drop("_ok", CORRUPT)
    rejects = flagged.where(~F.col("_ok")).select(
        F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*[F.col(f.name) for f in S.PATIENT.fields]))).alias("line"))
    return ScanResult(records, rejects)
