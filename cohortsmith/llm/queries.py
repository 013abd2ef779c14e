"""The registered queries of this package, one for each operator, and the pipeline.

Each is a thin application of its operator, with production parameters, to its whole table; the
digest columns are derived from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bin_packing,
    chat_prefix,
    collocations,
    decontaminate,
    line_frequency,
    pii_boost,
    simhash,
    substring_dedup,
    template_removal,
    token_alignment,
    toxicity,
    uniform_shuffle,
    warc_merge,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_merge.page_records(warc_merge.capture_index(_table(spark, sf_dir, "pages")))


def op2_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = uniform_shuffle.shuffle(uniform_shuffle.sizes(_table(spark, sf_dir, "documents")), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_chat_prefix_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_prefix.collapse_and_render(_table(spark, sf_dir, "conversations"))


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge(_table(spark, sf_dir, "documents"), host="source")


def op6_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_removal.extract(_table(spark, sf_dir, "pages"))


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.report(_table(spark, sf_dir, "documents"))


def op8_countmin_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack(_table(spark, sf_dir, "documents"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=3, bits=2)


def op11_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_whitespace_anchor_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(_table(spark, sf_dir, "documents"))


def op13_quotient_filter_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_warc_index_merge, op2_hypergeometric_shuffle, op3_chat_prefix_collapse, op4_qgram_decontamination, op5_line_frequency_rules,
        op6_site_template_removal, op7_boosted_pii, op8_countmin_substring_dedup,
        op9_best_fit_packing, op10_simhash_components, op11_segment_toxicity, op12_whitespace_anchor_alignment, op13_quotient_filter_collocations, pipeline)
}

#: DuckDB statements over the same tables, where SQL can express the query.
SQL: dict[str, str] = {
    "op3_chat_prefix_collapse": chat_prefix.SQL,
    "op5_line_frequency_rules": line_frequency.SQL,
    "op13_quotient_filter_collocations": collocations.SQL,
}
