"""GEN-17/20…22: name formats and note text (exact strings)."""

from pyspark.sql import functions as F

from cohortsmith.functions.names import full_name, initials, name_struct, sort_key
from cohortsmith.operators.cohort import note_text


def _names(spark):
    rows = [("John", "Smith", None, None), ("John", "Smith", "A", None), ("John", "Smith", None, "Jr."),
            ("John", "Smith", "A", "Jr.")]
    df = spark.createDataFrame(rows, "f string, l string, mi string, sx string")
    n = name_struct(F.col("f"), F.col("l"), F.col("mi"), F.col("sx"))
    return df.select(full_name(n).alias("full"), sort_key(n).alias("sk"), initials(n).alias("ini")).collect()


def test_name_formats(spark):
    got = [tuple(r) for r in _names(spark)]
    assert got == [
        ("John Smith", "Smith, John", "J. Smith"),
        ("John A. Smith", "Smith, John A", "J. A. Smith"),
        ("John Smith, Jr.", "Smith, John", "J. Smith"),
        ("John A. Smith, Jr.", "Smith, John A", "J. A. Smith"),
    ]


def test_note_text_template(spark):
    df = spark.createDataFrame(
        [("Jane", "Doe", 45, "Female", ["diabetes"], ["Metformin"], False, None, None, None)],
        "f string, l string, age int, gender string, c array<string>, m array<string>, r boolean, "
        "rm string, rt string, rs string")
    n = name_struct(F.col("f"), F.col("l"))
    text = df.select(note_text(n, F.col("age"), F.col("gender"), F.col("c"), F.col("m"), F.col("r"), F.col("rm"),
                               F.col("rt"), F.col("rs")).alias("t")).first().t
    assert text == "Patient Jane Doe is a 45-year-old female with diabetes. Prescribed medications: Metformin."
    assert "P00000001" not in text


def test_note_text_reaction_and_empty_lists(spark):
    df = spark.createDataFrame(
        [("Al", "Roe", 70, "Male", [], [], True, "DrugX", "rash", "Severe")],
        "f string, l string, age int, gender string, c array<string>, m array<string>, r boolean, "
        "rm string, rt string, rs string")
    n = name_struct(F.col("f"), F.col("l"))
    text = df.select(note_text(n, F.col("age"), F.col("gender"), F.col("c"), F.col("m"), F.col("r"), F.col("rm"),
                               F.col("rt"), F.col("rs")).alias("t")).first().t
    assert text == ("Patient Al Roe is a 70-year-old male with no significant comorbidities. Prescribed medications: "
                    "no current medications. Within 24 hours of DrugX exposure, patient developed a severe rash. "
                    "DrugX was discontinued. Reaction resolved after antihistamine treatment and monitoring.")
