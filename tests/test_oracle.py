"""Registered queries vs. their DuckDB oracle on the smallest dataset."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from cohortsmith.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
KEYS = ["cohort_profile", "cohort_notes", "exposure_reaction_rates", "pii_scan_counts", "content_policy_hits",
        "row_rules_patients", "distribution_conditions", "uniqueness_text", "guardrail_documents", "eval_set"]


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return "NULL" if v is None else str(v)


def _digest(rows):
    return sorted(hashlib.md5("|".join(map(_norm, r)).encode()).hexdigest() for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF)
    cols = sorted(sdf.columns)
    srows = [tuple(r[c] for c in cols) for r in sdf.collect()]
    sql = E.oracle_sql()[key]
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    drows = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()
    assert _digest(srows) == _digest(drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 7
