"""From raw documents to packed training sequences, a table between each two stages.

Stages: quality rules, SimHash near-duplicates, benchmark decontamination, redaction of personal
data, packing. Each works on all that its predecessor kept; all but the last return the columns
of documents, the last a row for each piece of a sequence (see bin_packing.pack).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortsmith.llm import bin_packing, decontaminate, line_frequency, pii_boost, simhash
from cohortsmith.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limits go from the others."""
    return line_frequency.clean(docs, host="source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the smallest doc_id."""
    return simhash.deduplicate(docs, shingle=3, bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii_boost.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids (4 bytes each, little-endian), sequence and place."""
    return bin_packing.pack(docs, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packing),
]

#: SimHash components, edit distances and packing are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
