"""Session helpers for tests, the bench and local runs.

On a cluster the session comes from the launcher; nothing here overrides settings that
are already present. ``shared_dir`` resolves the folder used to cut lineage from the
session's ``spark.checkpoint.dir`` and only falls back to a scratch folder when it is unset
(local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no per-call call-site capture while building large column expressions (batch jobs)
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # constraint inference over many aliased generated expressions (29 draws, the note
    # template, six staged regex columns) grows exponentially in the optimizer
    "spark.sql.constraintPropagation.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g",
                  app: str = "cohortsmith") -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark

#: Parquet stores a value that recurs once in each row group, in a dictionary, but by default gives that up at
#: 1 MB of distinct values: a list of a few MB would be written, and held in pages of 100 rows, once for each row.
REPEATED_CELLS = {"parquet.dictionary.page.size": str(64 << 20)}


def keep_repeated_cells_once(spark: SparkSession) -> None:
    """Whoever writes rows that repeat large cells as Parquet in this session stores each cell once
    in a row group. Values that the session or the cluster sets stay."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in REPEATED_CELLS.items():
        if spark.conf.get(k, None) is None and hadoop.get(k) is None:
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only where it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="cohortsmith-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def shared_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder, for tables written to cut lineage."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df):
    """Cut lineage once a table feeds several branches: write it as Parquet under the shared
    ``spark.checkpoint.dir`` and read it back (one job; survives executor loss; no local
    checkpoint)."""
    spark = df.sparkSession
    path = shared_dir(spark, f"tables/tmp-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spread(keys):
    """A table of keys dealt over twice the cores. A few bytes a key fit one row group, which one
    task reads, and whatever is generated from the keys would stay in that task."""
    return keys.repartition(2 * keys.sparkSession.sparkContext.defaultParallelism)


def cut_for_optimizer(df):
    """Inputs that feed several check branches are written once when the session still
    infers constraints (default Spark): generated cohorts otherwise make that inference
    explode. With constraint propagation off the plan stays lazy."""
    conf = df.sparkSession.conf.get("spark.sql.constraintPropagation.enabled", "true")
    return materialize(df) if str(conf).lower() == "true" else df
