"""Sinks (SNK-01…08). Writes are distributed; only the one-row report/summary documents are
coalesced to a single file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cohort import chunks, clinical_notes
from ..operators.evals import ragas


def write_jsonl(df: DataFrame, path: str, sort_col: str | None = None, compression: str | None = None, dealt: bool = False) -> int:
    """SNK-01: one JSON object per line, explicit nulls kept; returns the row count
    (from an ``observe`` metric of the same job, no second pass). With ``sort_col`` the rows are
    dealt by range and sorted (SRT-02): files in name order hold them in its order, as text for a
    text column. Rows already ``dealt`` over partitions by its ranges are not moved again. The
    metric stands above the sort, whose sampling would count rows twice."""
    from pyspark.sql import Observation

    obs = Observation("rows")
    if sort_col:
        df = df.sortWithinPartitions(sort_col) if dealt else df.orderBy(sort_col)
    df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression=compression)
    return int(obs.get["n"])


def write_patient_outputs(patients: DataFrame, out_dir: str) -> dict:
    """SNK-02…04: ``patients``, ``clinical_notes`` and ``chunks`` JSONL directories."""
    p = patients.drop("patient_key", "risk_bucket") if "patient_key" in patients.columns else patients
    return {
        "patients": write_jsonl(p, f"{out_dir}/patients", "patient_id"),
        "clinical_notes": write_jsonl(clinical_notes(patients).drop("patient_key", "note_idx"),
                                      f"{out_dir}/clinical_notes", "note_id"),
        "chunks": write_jsonl(chunks(patients).drop("patient_key"), f"{out_dir}/chunks", "chunk_id"),
    }


def write_eval_outputs(records: DataFrame, out_dir: str, dealt: bool = False) -> int:
    """SNK-05: ``evals`` (nested arrays and metadata) and ``ragas_dataset`` JSONL directories, in
    gzip: a record repeats the list that other evals hold too. ``dealt``: the partitions are ranges
    of eval_id, as ``evals.records`` makes them; whole records are then neither stored nor shuffled."""
    n = write_jsonl(records.drop("eval_idx", "n_ground_truth"), f"{out_dir}/evals", "eval_id", compression="gzip", dealt=dealt)
    write_jsonl(ragas(records), f"{out_dir}/ragas_dataset", compression="gzip")
    return n


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-08: CSV of a flat projection; arrays are joined with ``|``, structs flattened."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t.startswith("array"):
            cols.append(F.array_join(F.transform(F.col(f.name), lambda x: x.cast("string")), "|").alias(f.name))
        elif t.startswith("struct") or t.startswith("map"):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    df.select(*cols).write.mode("overwrite").option("header", "true").csv(path)


def write_document(doc: DataFrame, path: str) -> None:
    """SNK-06/07: a one-row DataFrame with one string column written as one text file."""
    doc.coalesce(1).write.mode("overwrite").text(path)
