"""Structured Streaming run modes of the guardrails (STR-01…03).

* ``run_guardrail`` — file stream → the whole guardrail pipeline on every micro-batch (drift and
  duplicates are judged within it and, with ``scope="batch"``, within each ``batch_id`` of it; they
  don't survive it, as in the behaviour we reproduce). An epoch folds its counts and first examples
  into the report of the epoch before it and writes the running report of that epoch, so no
  violation is read again. Every output lies in an ``epoch=<id>`` folder written with overwrite and
  made from the epoch's rows and the report before it alone: a retried epoch replaces itself.
* ``run_event_windows`` — event-time form of the drift check: tumbling windows with a
  watermark (bounded state), ``update`` output folded per epoch; the final value of each
  window is the row of the latest epoch that touched it.
* ``window_duplicates`` — the copies of a key within a window, across micro-batches: a count for
  each (window, key) whose state the watermark bounds. Copies are counted before the shuffle, so
  a hot key costs a row for each task.

All use ``trigger(availableNow=True)`` so a run processes what is there and stops.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guardrail
from ..params import GuardrailParams
from ..session import shared_dir


def split_source(df: DataFrame, key_col: str, path: str, n_files: int) -> str:
    """Write a table as ``n_files`` files by key range (a stream source for local runs)."""
    df.repartitionByRange(n_files, key_col).write.mode("overwrite").parquet(path)
    return path


def split_source_in_time_order(df: DataFrame, ts_col: str, path: str, n_files: int) -> str:
    """Write an event table as ``n_files`` time ranges, one file each, one range after the
    other, so the file source (which reads files in modification-time order) sees the
    events in time order — as a live stream would — and the watermark never drops them."""
    t = F.col(ts_col).cast("timestamp").cast("double")
    probs = [i / n_files for i in range(1, n_files)]
    cuts = df.select(t.alias("_t")).approxQuantile("_t", probs, 0.0) if n_files > 1 else []
    bounds = [None] + cuts + [None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = df
        if lo is not None:
            part = part.where(t >= F.lit(lo))
        if hi is not None:
            part = part.where(t < F.lit(hi))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


@dataclass
class StreamReport:
    violations: DataFrame   # of all epochs
    report_rows: DataFrame  # the running report after the last epoch, as guardrail.run gives it
    examples: DataFrame


def run_guardrail(spark: SparkSession, source: str, schema, records: Callable[[DataFrame], DataFrame], out: str,
                  params: GuardrailParams = GuardrailParams(scope="batch"), files_per_trigger: int = 1, **checks) -> StreamReport:
    """STR-01…03: ``records`` makes record tables of the source's rows, ``checks`` are the other
    arguments of ``guardrail.run``. Run again on the same ``out``, it takes only new files."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def per_batch(batch: DataFrame, epoch: int) -> None:
        judge_epoch(records(batch), epoch, out, params, **checks)

    q = (stream.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return read_report(spark, out)


def judge_epoch(recs: DataFrame, epoch: int, out: str, params: GuardrailParams, **checks) -> None:
    """The violations of one micro-batch, and the running report up to it."""
    spark = recs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = f"{out}/{name}/epoch={epoch}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    recs = recs.persist()  # read by each of the checks
    res = guardrail.run(recs, params, store=lambda v: stored(v, "violations"), **checks)
    counts, examples = res.report_counts.drop("text"), res.examples.drop("rank", "within_tolerance")
    if epoch > 0:  # epochs are numbered without gaps
        before = f"epoch={epoch - 1}"
        counts = counts.unionByName(spark.read.parquet(f"{out}/report/{before}"))
        examples = examples.unionByName(spark.read.parquet(f"{out}/examples/{before}").drop("rank", "within_tolerance"))
    total = F.when(F.col("key") == "enabled", F.max("n")).otherwise(F.sum("n"))
    stored(counts.groupBy("section", "key").agg(total.alias("n")), "report")
    stored(guardrail.first_examples(examples, params), "examples")
    recs.unpersist()


def read_report(spark: SparkSession, out: str) -> StreamReport:
    """The running report of the last epoch, and the violations of all."""
    last = spark.read.parquet(f"{out}/report").agg(F.max("epoch")).first()[0]
    examples = spark.read.parquet(f"{out}/examples/epoch={last}")
    counts = spark.read.parquet(f"{out}/report/epoch={last}").withColumn("text", F.lit(None).cast("string"))
    return StreamReport(spark.read.parquet(f"{out}/violations"),
                        counts.unionByName(guardrail.example_rows(examples)), examples)


def run_event_windows(spark: SparkSession, source: str, schema, ts_col: str, cat_col: str, out: str,
                      window: str = "1 day", watermark: str = "1 day", files_per_trigger: int = 1) -> DataFrame:
    """STR-02 (event time): per tumbling window, count per category; returns the final counts."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    # Watermarks need TIMESTAMP. A TIMESTAMP_NTZ wall time is read as a UTC instant whatever
    # the session time zone, so daily windows follow the wall-clock day; window starts are
    # mapped back to wall time on output.
    tz = spark.conf.get("spark.sql.session.timeZone")
    wall_clock = dict(schema_fields(schema)).get(ts_col) == "timestamp_ntz"
    if wall_clock:
        stream = stream.withColumn(ts_col, F.from_utc_timestamp(F.col(ts_col).cast("timestamp"), tz))

    def to_wall(c: Column) -> Column:
        return F.to_utc_timestamp(c, tz).cast("timestamp_ntz") if wall_clock else c
    agg = (stream.withWatermark(ts_col, watermark)
           .groupBy(F.window(ts_col, window).alias("w"), F.col(cat_col).alias("category"))
           .agg(F.count(F.lit(1)).alias("n")))

    def per_batch(batch: DataFrame, epoch: int) -> None:
        batch.select(to_wall(F.col("w.start")).alias("window_start"), "category", F.col("n").cast("long").alias("n"),
                     F.lit(epoch).cast("long").alias("epoch")) \
            .write.mode("overwrite").parquet(f"{out}/updates/epoch={epoch}")

    q = (agg.writeStream.outputMode("update").foreachBatch(per_batch)
         .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    ups = spark.read.parquet(f"{out}/updates")
    return ups.groupBy("window_start", "category").agg(F.max_by("n", "epoch").alias("n"))


def window_duplicates(counts: DataFrame) -> DataFrame:
    """STR-03 across micro-batches: per window and key, the copies after the first (``counts`` as
    ``run_event_windows`` gives them, the key as its category; rows without a key are no copies)."""
    return counts.where((F.col("n") > 1) & F.col("category").isNotNull()).select(
        "window_start", F.col("category").cast("string").alias("duplicate_id"), (F.col("n") - 1).alias("n_extra"))


def window_drift(counts: DataFrame, expected: dict, tolerance: float) -> DataFrame:
    """Share of each category within its window vs. expected (all rows, with the flag)."""
    from pyspark.sql import Window

    tot = F.sum("n").over(Window.partitionBy("window_start"))
    exp = F.element_at(F.create_map(*[x for kv in expected.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))]),
                       F.col("category"))
    out = counts.withColumn("total", tot).withColumn("expected", exp) \
        .withColumn("actual", F.col("n").cast("double") / F.col("total").cast("double"))
    out = out.withColumn("deviation", F.abs(F.col("actual") - F.col("expected")))
    return out.withColumn("within_tolerance", F.col("deviation") <= F.lit(float(tolerance)))


def schema_fields(schema) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return shared_dir(spark, f"stream/{name}-{uuid.uuid4().hex}")
