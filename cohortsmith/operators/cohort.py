"""Seeded synthetic-cohort operators (GEN-07…19).

``generate_cohort`` turns any DataFrame with a dense numeric key (``spark.range(n)``,
``customer.c_custkey``, ``orders.o_orderkey`` …) into a patient table. Every column is a
pure expression of ``(seed, key)``: the whole cohort is one narrow stage of whole-stage
codegen, needs no shuffle, and is identical for every partitioning and after retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.draws import Drawer, below, int_between, pick
from ..functions.names import full_name, name_struct
from ..functions.text import join_or, str_array, zero_padded_id
from ..params import CohortParams

PROFILE_PICKS = ["age", "region", "first", "last", "mi", "suffix"]
PROFILE_FLAGS = ["gender", "risk", "mi_flag", "suffix_flag"]
MED_DRAWS = ["metformin", "aspirin_senior", "aspirin_any", "drug_x", "drug_y", "drug_z"]
RX_DRAWS = ["x", "x_type", "x_severity", "y", "y_type", "y_severity"]


def _surname_pool(region: Column) -> Column:
    """SRC-05: regional surname pool; unknown regions fall back to the West pool."""
    expr = str_array(K.SURNAMES_BY_REGION[K.FALLBACK_SURNAME_REGION])
    for reg in reversed(K.REGIONS):
        expr = F.when(region == F.lit(reg), str_array(K.SURNAMES_BY_REGION[reg])).otherwise(expr)
    return expr


def generate_cohort(keys: DataFrame, key_col: str = "id", params: CohortParams = CohortParams(),
                    with_notes: bool = True) -> DataFrame:
    """JOB-01 core: keys -> patients (profile, conditions, medications, reaction, note)."""
    p = params
    key = F.col(key_col).cast("long")
    base = keys.select(key.alias("patient_key"))
    k = F.col("patient_key")
    prof, cond, med, rx = (Drawer(k, s, p.seed, p.hash) for s in ("profile", "cond", "med", "rx"))

    # 1. every draw once (md5 is not "cheap", so Catalyst keeps this projection un-collapsed).
    #    Draws only ever compared with a probability stay in their raw form (``below``);
    #    draws that index a list are uniform doubles.
    draws = {f"u_p_{d}": prof(d) for d in PROFILE_PICKS}
    draws.update({f"r_p_{d}": prof.raw(d) for d in PROFILE_FLAGS})
    draws.update({f"r_c_{c}": cond.raw(c) for c in K.CONDITIONS})
    draws.update({f"r_m_{d}": med.raw(d) for d in MED_DRAWS})
    draws.update({f"r_r_{d}": rx.raw(d) for d in ("x", "x_severity", "y", "y_severity")})
    draws.update({f"u_r_{d}": rx(d) for d in ("x_type", "y_type")})
    df = base.withColumns(draws)
    u = F.col

    def lt(name: str, prob: float) -> Column:
        return below(F.col(name), prob, p.hash)

    def lt_if(flag: Column, name: str, p_true: float, p_false: float) -> Column:
        return F.when(flag, lt(name, p_true)).otherwise(lt(name, p_false))

    # 2. profile (GEN-07…11)
    gender = F.when(lt("r_p_gender", p.female_probability), F.lit("Female")).otherwise(F.lit("Male"))
    df = df.withColumns({
        "patient_id": zero_padded_id("P", k),
        "age": int_between(u("u_p_age"), p.min_age, p.max_age),
        "gender": gender,
        "region": pick(u("u_p_region"), K.REGIONS),
    })
    first_pool = F.when(F.col("gender") == "Female", str_array(K.FIRST_NAMES_FEMALE)).otherwise(
        str_array(K.FIRST_NAMES_MALE))
    mi = F.when(lt("r_p_mi_flag", K.MIDDLE_INITIAL_PROBABILITY),
                F.char(F.lit(65) + F.floor(u("u_p_mi") * F.lit(26)).cast("int")))
    suffix = F.when(lt("r_p_suffix_flag", K.SUFFIX_PROBABILITY), pick(u("u_p_suffix"), K.SUFFIXES))
    df = df.withColumns({
        "risk_bucket": F.when((F.col("age") > K.RISK_HIGH_AGE) | lt("r_p_risk", K.RISK_HIGH_ROLL), F.lit("High"))
        .when((F.col("age") > K.RISK_MEDIUM_AGE) | lt("r_p_risk", K.RISK_MEDIUM_ROLL), F.lit("Medium"))
        .otherwise(F.lit("Low")),
        "name": name_struct(pick(u("u_p_first"), first_pool), pick(u("u_p_last"), _surname_pool(F.col("region"))),
                            mi, suffix),
    })

    # 3. conditions (GEN-12): independent Bernoullis, fixed order
    has = {c: lt(f"r_c_{c}", p.condition_rates[c]) for c in K.CONDITIONS}
    df = df.withColumn("comorbidities", F.array_compact(F.array(*[F.when(has[c], F.lit(c)) for c in K.CONDITIONS])))

    # 4. medications (GEN-13); aspirin keeps the two-draw rule for age > 55
    age = F.col("age")
    aspirin = (has["coronary_artery_disease"]
               | ((age > K.ASPIRIN_SENIOR_AGE) & lt("r_m_aspirin_senior", p.aspirin_exposure))
               | lt("r_m_aspirin_any", p.aspirin_exposure))
    meds = [
        ("Metformin", has["diabetes"] & lt("r_m_metformin", p.metformin_if_diabetes)),
        ("Lisinopril", has["hypertension"]),
        ("Albuterol", has["asthma"]),
        ("Aspirin", aspirin),
        ("DrugX", lt("r_m_drug_x", p.drug_x_exposure)),
        ("DrugY", lt("r_m_drug_y", p.drug_y_exposure)),
        ("DrugZ", lt("r_m_drug_z", p.drug_z_exposure)),
    ]
    df = df.withColumns({
        "medications": F.array_compact(F.array(*[F.when(flag, F.lit(m)) for m, flag in meds])),
        "_x_exposed": meds[4][1],
        "_y_exposed": meds[5][1],
        "_diabetic": has["diabetes"],
    })

    # 5. reaction (GEN-14/15): DrugX first, DrugY only without a DrugX reaction. Bumped
    #    probabilities are summed on the driver, in the reference's order of operations.
    mx, my = p.reaction_model["DrugX"], p.reaction_model["DrugY"]
    senior = age > K.SEVERE_AGE
    diab = F.col("_diabetic")
    rx_x = F.col("_x_exposed") & lt_if(diab, "r_r_x", mx["probability"] + mx["diabetes_bump"], mx["probability"])
    rx_y = ~rx_x & F.col("_y_exposed") & lt_if(diab, "r_r_y", my["probability"] + my["diabetes_bump"],
                                                 my["probability"])

    def sev(name: str, model: dict) -> Column:
        """GEN-15: Severe if roll < s, Moderate if roll < s + .35, else Mild (s bumped past 65)."""
        s_old = model["severe"] + model["senior_severe_bump"]
        s_young = model["severe"]
        return (F.when(lt_if(senior, name, s_old, s_young), F.lit("Severe"))
                .when(lt_if(senior, name, s_old + K.MODERATE_BAND, s_young + K.MODERATE_BAND), F.lit("Moderate"))
                .otherwise(F.lit("Mild")))

    df = df.withColumns({"_rx": rx_x, "_ry": rx_y})
    rxc, ryc = F.col("_rx"), F.col("_ry")
    df = df.withColumns({
        "allergic_reaction": rxc | ryc,
        "reaction_medication": F.when(rxc, F.lit("DrugX")).when(ryc, F.lit("DrugY")),
        "reaction_type": F.when(rxc, pick(u("u_r_x_type"), mx["types"])).when(ryc, pick(u("u_r_y_type"), my["types"])),
        "reaction_severity": F.when(rxc, sev("r_r_x_severity", mx)).when(ryc, sev("r_r_y_severity", my)),
        "metadata": F.struct(F.lit(p.seed).cast("long").alias("seed"),
                             F.floor(k / F.lit(p.batch_size)).cast("long").alias("batch_id")),
    })
    cols = ["patient_key", "patient_id", "name", "age", "gender", "region", "risk_bucket", "comorbidities",
            "medications", "allergic_reaction", "reaction_medication", "reaction_type", "reaction_severity"]
    df = df.select(*cols, "metadata")
    if with_notes:
        df = attach_notes(df)
    return df


# ---------------------------------------------------------------------------
# Notes and chunks (GEN-16…19)
# ---------------------------------------------------------------------------

def note_text(name: Column, age: Column, gender: Column, comorbidities: Column, medications: Column,
              allergic: Column, reaction_medication: Column, reaction_type: Column, severity: Column) -> Column:
    """GEN-17: the clinical-note template with its conditional sentences."""
    sev_word = F.coalesce(F.lower(severity), F.lit("reported"))
    reaction = F.when(
        allergic & reaction_medication.isNotNull(),
        F.concat(
            F.lit(" Within 24 hours of "), reaction_medication, F.lit(" exposure, patient developed a "),
            sev_word, F.lit(" "), F.coalesce(reaction_type, F.lit("unknown reaction")), F.lit(". "),
            reaction_medication, F.lit(" was discontinued."),
            F.when(severity == F.lit("Severe"),
                   F.lit(" Reaction resolved after antihistamine treatment and monitoring.")).otherwise(F.lit("")),
        ),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("Patient "), full_name(name), F.lit(" is a "), age.cast("string"), F.lit("-year-old "),
        F.lower(gender), F.lit(" with "), join_or(comorbidities, " and ", "no significant comorbidities"),
        F.lit(". Prescribed medications: "), join_or(medications, ", ", "no current medications"), F.lit("."),
        reaction,
    )


def attach_notes(patients: DataFrame) -> DataFrame:
    """GEN-16/18: one ``primary_care`` note per patient, nested as ``clinical_notes``."""
    c = F.col
    text = note_text(c("name"), c("age"), c("gender"), c("comorbidities"), c("medications"),
                     c("allergic_reaction"), c("reaction_medication"), c("reaction_type"), c("reaction_severity"))
    note = F.struct(
        F.concat(F.lit("note_"), c("patient_id"), F.lit("_0")).alias("note_id"),
        c("patient_id").alias("patient_id"),
        F.lit(K.NOTE_TYPE).alias("note_type"),
        text.alias("text"),
    )
    return patients.withColumn("clinical_notes", F.array(note)).select(
        *[x for x in patients.columns if x != "metadata"], "clinical_notes", "metadata")


def clinical_notes(patients: DataFrame) -> DataFrame:
    """SNK-03 shape: flat ``(note_id, patient_id, note_type, text)`` rows, plus the note index."""
    # outer: a plain explode lets Spark infer a filter on the array, which draws every note again
    return (patients.select("patient_key", F.posexplode_outer("clinical_notes").alias("note_idx", "note"))
            .where(F.col("note_idx").isNotNull())
            .select("patient_key", "note_idx", "note.note_id", "note.patient_id", "note.note_type", "note.text"))


def chunk_id(owner: Column, idx: Column) -> Column:
    return F.concat(F.lit("chunk_"), owner, F.lit("_note_"), idx.cast("string"))


def chunks(patients: DataFrame) -> DataFrame:
    """GEN-19: one chunk per note — id ``chunk_<pid>_note_<i>``, source, metadata map."""
    notes = clinical_notes(patients)
    return notes.select(
        "patient_key",
        chunk_id(F.col("patient_id"), F.col("note_idx")).alias("chunk_id"),
        "patient_id",
        "text",
        F.concat(F.lit("clinical_note_"), F.col("patient_id"), F.lit("_"), F.col("note_idx").cast("string")).alias("source"),
        F.create_map(F.lit("note_type"), F.col("note_type")).alias("metadata"),
    )


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    type_col: str | None = "source") -> DataFrame:
    """GEN-19 applied to any text table: one chunk per row, same id and source rules."""
    owner = F.col(id_col).cast("string")
    note_type = F.col(type_col) if type_col else F.lit(K.NOTE_TYPE)
    return docs.select(
        chunk_id(owner, F.lit(0)).alias("chunk_id"),
        owner.alias("owner_id"),
        F.col(text_col).alias("text"),
        F.concat(F.lit("clinical_note_"), owner, F.lit("_0")).alias("source"),
        F.create_map(F.lit("note_type"), note_type).alias("metadata"),
    )


def patient_facts(patients: DataFrame) -> DataFrame:
    """§1.4: normalised ``(patient_key, patient_id, kind, value)`` for conditions and medications."""
    conds = patients.select("patient_key", "patient_id", F.lit("condition").alias("kind"),
                            F.explode("comorbidities").alias("value"))
    meds = patients.select("patient_key", "patient_id", F.lit("medication").alias("kind"),
                           F.explode("medications").alias("value"))
    return conds.unionByName(meds)
