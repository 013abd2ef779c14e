"""DuckDB SQL twin of the cohort generator, used only to build oracle queries.

The draw is the same hash as ``cohortsmith.functions.draws.uniform(hash="md5")``:
first 13 hex digits of ``md5(seed|stage|key|draw)`` / 2^52. Probabilities are written as
``repr`` of the Python double and cast to DOUBLE (a bare ``0.2`` is a DECIMAL in DuckDB).
"""

from __future__ import annotations

from cohortsmith import constants as K

SEED = 42
BATCH_SIZE = 1000


def dbl(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(s(x) for x in items) + "]"


def draw(stage: str, name: str, key: str = "patient_key", seed: int = SEED) -> str:
    return (f"((('0x' || substr(md5(concat_ws('|', {s(str(seed))}, {s(stage)}, CAST({key} AS VARCHAR), {s(name)})),"
            f" 1, 13))::BIGINT)::DOUBLE / 4503599627370496::DOUBLE)")


def pick(u: str, items) -> str:
    return f"list_extract({lst(items)}, (floor({u} * {len(items)}))::INTEGER + 1)"


def cohort_ctes(key_sql: str = "SELECT c_custkey AS patient_key FROM customer", seed: int = SEED, prefix: str = "") -> str:
    """CTEs ``ck_u``…``cohort`` producing the same columns as ``generate_cohort``, with the
    arrays also given as joined strings (``comorbidities_str`` …)."""
    prof = ["age", "gender", "region", "risk", "first", "last", "mi_flag", "mi", "suffix_flag", "suffix"]
    meds = ["metformin", "aspirin_senior", "aspirin_any", "drug_x", "drug_y", "drug_z"]
    rxs = ["x", "x_type", "x_severity", "y", "y_type", "y_severity"]
    cols = [f"{draw('profile', d, seed=seed)} AS u_p_{d}" for d in prof]
    cols += [f"{draw('cond', c, seed=seed)} AS u_c_{c}" for c in K.CONDITIONS]
    cols += [f"{draw('med', d, seed=seed)} AS u_m_{d}" for d in meds]
    cols += [f"{draw('rx', d, seed=seed)} AS u_r_{d}" for d in rxs]
    span = K.MAX_AGE - K.MIN_AGE + 1
    surname = "CASE " + " ".join(
        f"WHEN region = {s(r)} THEN {pick('u_p_last', K.SURNAMES_BY_REGION[r])}" for r in K.REGIONS
    ) + f" ELSE {pick('u_p_last', K.SURNAMES_BY_REGION[K.FALLBACK_SURNAME_REGION])} END"
    has = ", ".join(f"u_c_{c} < {dbl(r)} AS has_{c}" for c, r in K.CONDITION_RATES.items())
    mx, my = K.REACTION_MODEL["DrugX"], K.REACTION_MODEL["DrugY"]

    def thr(flag, base, bump):
        return f"CASE WHEN {flag} THEN {dbl(base + bump)} ELSE {dbl(base)} END"

    def sev(roll, base, bump):
        sv = f"CASE WHEN age > {K.SEVERE_AGE} THEN {dbl(base + bump)} ELSE {dbl(base)} END"
        md = (f"CASE WHEN age > {K.SEVERE_AGE} THEN {dbl(base + bump + K.MODERATE_BAND)} "
              f"ELSE {dbl(base + K.MODERATE_BAND)} END")
        return f"CASE WHEN {roll} < {sv} THEN 'Severe' WHEN {roll} < {md} THEN 'Moderate' ELSE 'Mild' END"

    med_items = [
        ("Metformin", f"has_diabetes AND u_m_metformin < {dbl(K.METFORMIN_IF_DIABETES)}"),
        ("Lisinopril", "has_hypertension"),
        ("Albuterol", "has_asthma"),
        ("Aspirin", f"(has_coronary_artery_disease OR (age > {K.ASPIRIN_SENIOR_AGE} AND u_m_aspirin_senior < "
                    f"{dbl(K.ASPIRIN_EXPOSURE)}) OR u_m_aspirin_any < {dbl(K.ASPIRIN_EXPOSURE)})"),
        ("DrugX", f"u_m_drug_x < {dbl(K.DRUG_X_EXPOSURE)}"),
        ("DrugY", f"u_m_drug_y < {dbl(K.DRUG_Y_EXPOSURE)}"),
        ("DrugZ", f"u_m_drug_z < {dbl(K.DRUG_Z_EXPOSURE)}"),
    ]
    med_flags = ", ".join(f"({cond}) AS m_{m}" for m, cond in med_items)
    cond_list = "list_filter([" + ", ".join(f"CASE WHEN has_{c} THEN {s(c)} END" for c in K.CONDITIONS) + \
                "], lambda x: x IS NOT NULL)"
    med_list = "list_filter([" + ", ".join(f"CASE WHEN m_{m} THEN {s(m)} END" for m, _ in med_items) + \
               "], lambda x: x IS NOT NULL)"
    full = ("first_name || coalesce(' ' || middle_initial || '.', '') || ' ' || last_name || "
            "coalesce(', ' || name_suffix, '')")
    return f"""
{prefix}ck_keys AS ({key_sql}),
{prefix}ck_u AS (SELECT patient_key, {', '.join(cols)} FROM {prefix}ck_keys),
{prefix}ck_p1 AS (SELECT *, printf('P%09d', patient_key) AS patient_id,
    ({K.MIN_AGE} + floor(u_p_age * {span}))::INTEGER AS age,
    CASE WHEN u_p_gender < {dbl(K.FEMALE_PROBABILITY)} THEN 'Female' ELSE 'Male' END AS gender,
    {pick('u_p_region', K.REGIONS)} AS region FROM {prefix}ck_u),
{prefix}ck_p2 AS (SELECT *,
    CASE WHEN age > {K.RISK_HIGH_AGE} OR u_p_risk < {dbl(K.RISK_HIGH_ROLL)} THEN 'High'
         WHEN age > {K.RISK_MEDIUM_AGE} OR u_p_risk < {dbl(K.RISK_MEDIUM_ROLL)} THEN 'Medium' ELSE 'Low' END AS risk_bucket,
    CASE WHEN gender = 'Female' THEN {pick('u_p_first', K.FIRST_NAMES_FEMALE)}
         ELSE {pick('u_p_first', K.FIRST_NAMES_MALE)} END AS first_name,
    {surname} AS last_name,
    CASE WHEN u_p_mi_flag < {dbl(K.MIDDLE_INITIAL_PROBABILITY)} THEN chr((65 + floor(u_p_mi * 26))::INTEGER) END AS middle_initial,
    CASE WHEN u_p_suffix_flag < {dbl(K.SUFFIX_PROBABILITY)} THEN {pick('u_p_suffix', K.SUFFIXES)} END AS name_suffix,
    {has} FROM {prefix}ck_p1),
{prefix}ck_p3 AS (SELECT *, {med_flags} FROM {prefix}ck_p2),
{prefix}ck_p4 AS (SELECT *,
    m_DrugX AND u_r_x < {thr('has_diabetes', mx['probability'], mx['diabetes_bump'])} AS rx_x FROM {prefix}ck_p3),
{prefix}ck_p5 AS (SELECT *,
    (NOT rx_x) AND m_DrugY AND u_r_y < {thr('has_diabetes', my['probability'], my['diabetes_bump'])} AS rx_y FROM {prefix}ck_p4),
{prefix}cohort AS (SELECT patient_key, patient_id, first_name, last_name, middle_initial, name_suffix,
    {full} AS full_name,
    last_name || ', ' || first_name || coalesce(' ' || middle_initial, '') AS sort_key,
    coalesce(nullif(substr(first_name, 1, 1), ''), ' ') || '. ' || coalesce(middle_initial || '. ', '') || last_name AS initials,
    age, gender, region, risk_bucket,
    {cond_list} AS comorbidities, {med_list} AS medications,
    {', '.join(f'has_{c}' for c in K.CONDITIONS)},
    {', '.join(f'm_{m}' for m, _ in med_items)},
    rx_x OR rx_y AS allergic_reaction,
    CASE WHEN rx_x THEN 'DrugX' WHEN rx_y THEN 'DrugY' END AS reaction_medication,
    CASE WHEN rx_x THEN {pick('u_r_x_type', mx['types'])} WHEN rx_y THEN {pick('u_r_y_type', my['types'])} END AS reaction_type,
    CASE WHEN rx_x THEN {sev('u_r_x_severity', mx['severe'], mx['senior_severe_bump'])}
         WHEN rx_y THEN {sev('u_r_y_severity', my['severe'], my['senior_severe_bump'])} END AS reaction_severity,
    {seed}::BIGINT AS seed, (patient_key // {BATCH_SIZE})::BIGINT AS batch_id
  FROM {prefix}ck_p5),
{prefix}cohort_n AS (SELECT *,
    array_to_string(comorbidities, ',') AS comorbidities_str,
    array_to_string(medications, ',') AS medications_str,
    {NOTE_SQL} AS note_text
  FROM {prefix}cohort)"""


NOTE_SQL = """'Patient ' || full_name || ' is a ' || CAST(age AS VARCHAR) || '-year-old ' || lower(gender) || ' with ' ||
    CASE WHEN len(comorbidities) = 0 THEN 'no significant comorbidities' ELSE array_to_string(comorbidities, ' and ') END ||
    '. Prescribed medications: ' ||
    CASE WHEN len(medications) = 0 THEN 'no current medications' ELSE array_to_string(medications, ', ') END || '.' ||
    CASE WHEN allergic_reaction AND reaction_medication IS NOT NULL THEN
        ' Within 24 hours of ' || reaction_medication || ' exposure, patient developed a ' ||
        coalesce(lower(reaction_severity), 'reported') || ' ' || coalesce(reaction_type, 'unknown reaction') || '. ' ||
        reaction_medication || ' was discontinued.' ||
        CASE WHEN reaction_severity = 'Severe' THEN ' Reaction resolved after antihistamine treatment and monitoring.' ELSE '' END
    ELSE '' END"""


def with_cohort(body: str, key_sql: str = "SELECT c_custkey AS patient_key FROM customer", extra_ctes: str = "") -> str:
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {cohort_ctes(key_sql)}{extra}\n{body}"
