"""Table sources (SRC-01/02): the driver's Parquet tables and dense key ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan; listing ``columns`` keeps the ``ReadSchema`` to what the query uses."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01 on a real table: ``customer.c_custkey`` is dense from 0."""
    return spread(read_table(spark, sf_dir, "customer", "c_custkey"))


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger cohort key: ``orders.o_orderkey`` (10x customer)."""
    return spread(read_table(spark, sf_dir, "orders", "o_orderkey"))


def supplier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a second, independent cohort."""
    return spread(read_table(spark, sf_dir, "supplier", "s_suppkey"))


def key_range(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """SRC-01/02: ``0..n-1`` as column ``id``."""
    return spark.range(0, n, 1, partitions) if partitions else spark.range(n)
