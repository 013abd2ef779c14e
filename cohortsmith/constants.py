"""Fixed values that results depend on.

Everything in this module is data, not logic: the lists and rates below must equal
the values of the behaviour we reproduce, so they are written out plainly, in their
natural order. Code elsewhere turns them into Spark literals.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — cohort model
# ---------------------------------------------------------------------------

REGIONS = ["Northeast", "Southeast", "Midwest", "Southwest", "West"]

MIN_AGE = 18
MAX_AGE = 90
FEMALE_PROBABILITY = 0.52

# Condition name -> base rate, in the order conditions are drawn and listed.
CONDITION_RATES = {
    "diabetes": 0.12,
    "hypertension": 0.28,
    "asthma": 0.09,
    "chronic_kidney_disease": 0.04,
    "coronary_artery_disease": 0.06,
    "copd": 0.05,
    "obesity": 0.22,
}
CONDITIONS = list(CONDITION_RATES)

METFORMIN_IF_DIABETES = 0.70
ASPIRIN_EXPOSURE = 0.18
DRUG_X_EXPOSURE = 0.05
DRUG_Y_EXPOSURE = 0.08
DRUG_Z_EXPOSURE = 0.03
ASPIRIN_SENIOR_AGE = 55  # strictly older than this gets the extra aspirin draw

# Reaction model per drug: base probability, diabetic bump, severe probability,
# bump for age > 65, reaction types.
REACTION_MODEL = {
    "DrugX": {
        "probability": 0.20,
        "diabetes_bump": 0.05,
        "severe": 0.15,
        "senior_severe_bump": 0.10,
        "types": ["rash", "hives", "shortness of breath"],
    },
    "DrugY": {
        "probability": 0.08,
        "diabetes_bump": 0.03,
        "severe": 0.05,
        "senior_severe_bump": 0.05,
        "types": ["nausea", "dizziness", "rash"],
    },
}
SEVERE_AGE = 65
MODERATE_BAND = 0.35

# Risk bucket: High if age > 70 or roll < .1, Medium if age > 50 or roll < .3.
RISK_HIGH_AGE = 70
RISK_HIGH_ROLL = 0.1
RISK_MEDIUM_AGE = 50
RISK_MEDIUM_ROLL = 0.3

MIDDLE_INITIAL_PROBABILITY = 0.10
SUFFIX_PROBABILITY = 0.02
SUFFIXES = ["Jr.", "Sr.", "II", "III", "IV"]

NOTE_TYPE = "primary_care"

# ---------------------------------------------------------------------------
# FIXED VALUES — name dictionaries (public census-frequency name lists)
# ---------------------------------------------------------------------------

FIRST_NAMES_FEMALE = [
    "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth",
    "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy",
    "Lisa", "Betty", "Margaret", "Sandra", "Ashley", "Kimberly",
    "Emily", "Donna", "Michelle", "Dorothy", "Carol", "Amanda",
    "Melissa", "Deborah", "Stephanie", "Rebecca", "Sharon", "Laura",
    "Cynthia", "Kathleen", "Amy", "Angela", "Shirley", "Anna",
    "Brenda", "Pamela", "Emma", "Nicole", "Helen", "Samantha",
    "Katherine", "Christine", "Debra", "Rachel", "Carolyn", "Janet",
    "Catherine", "Maria", "Heather", "Diane", "Julie", "Joyce",
    "Victoria", "Ruth", "Andrea", "Lauren", "Evelyn", "Judith",
    "Megan", "Cheryl", "Martha", "Frances", "Hannah",
    "Jacqueline", "Annie", "Gloria", "Eleanor", "Teresa",
    "Kathryn", "Sara", "Janice", "Jean", "Alice", "Doris",
    "Abigail", "Julia", "Judy", "Grace", "Denise", "Amber",
    "Marilyn", "Beverly", "Danielle", "Theresa", "Sophia", "Marie",
    "Diana", "Brittany", "Natalie", "Isabella", "Charlotte", "Rose",
    "Alexis", "Kayla", "Mia", "Alexandra", "Lillian", "Claire",
]

FIRST_NAMES_MALE = [
    "James", "Robert", "John", "Michael", "David", "William",
    "Richard", "Joseph", "Thomas", "Charles", "Christopher", "Daniel",
    "Matthew", "Anthony", "Donald", "Mark", "Paul", "Steven",
    "Andrew", "Kenneth", "Joshua", "Kevin", "Brian", "George",
    "Timothy", "Ronald", "Edward", "Jason", "Jeffrey", "Ryan",
    "Jacob", "Gary", "Nicholas", "Eric", "Jonathan", "Stephen",
    "Larry", "Justin", "Scott", "Brandon", "Benjamin", "Samuel",
    "Raymond", "Gregory", "Frank", "Alexander", "Patrick", "Jack",
    "Dennis", "Jerry", "Tyler", "Aaron", "Jose", "Adam",
    "Henry", "Nathan", "Douglas", "Zachary", "Peter", "Kyle",
    "Noah", "Ethan", "Jeremy", "Walter", "Christian", "Keith",
    "Roger", "Terry", "Gerald", "Harold", "Sean", "Austin",
    "Arthur", "Lawrence", "Jesse", "Dylan", "Bryan", "Joe",
    "Jordan", "Billy", "Bruce", "Albert", "Willie", "Gabriel",
    "Logan", "Alan", "Juan", "Wayne", "Elijah", "Roy",
    "Ralph", "Randy", "Eugene", "Vince", "Russell", "Louis",
    "Philip", "Bobby", "Johnny", "Bradley", "Marcus", "Melvin",
]

# Regional surname pools; an unknown region uses the West pool.
SURNAMES_BY_REGION = {
    "Northeast": [
        "Smith", "Johnson", "Williams", "Brown", "Jones", "Miller",
        "Davis", "Wilson", "Anderson", "Taylor", "Thomas", "Moore",
        "Sullivan", "O'Brien", "Murphy", "Kelly", "Ryan", "Connolly",
        "Romano", "Russo", "Esposito", "Costello",
    ],
    "Southeast": [
        "Smith", "Johnson", "Williams", "Brown", "Jones", "Davis",
        "Wilson", "Taylor", "Moore", "Anderson", "Thomas", "Jackson",
        "Campbell", "MacDonald", "Sullivan", "Murphy", "Fitzpatrick",
    ],
    "Midwest": [
        "Smith", "Johnson", "Williams", "Brown", "Jones", "Miller",
        "Davis", "Wilson", "Anderson", "Taylor", "Thomas", "Moore",
        "Schmidt", "Mueller", "Weber", "Wagner", "Becker", "Hoffman",
        "Olson", "Larson", "Carlson", "Jensen",
    ],
    "Southwest": [
        "Smith", "Johnson", "Williams", "Brown", "Jones",
        "Garcia", "Rodriguez", "Martinez", "Hernandez", "Lopez",
        "Gonzalez", "Perez", "Sanchez", "Ramirez", "Torres", "Rivera",
        "Cruz", "Ortiz", "Mendoza", "Ruiz", "Vasquez", "Castillo",
    ],
    "West": [
        "Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia",
        "Miller", "Davis", "Rodriguez", "Martinez", "Hernandez", "Lopez",
        "Lee", "Nguyen", "Kim", "Wong", "Chen", "Patel", "Singh",
    ],
}
FALLBACK_SURNAME_REGION = "West"

# ---------------------------------------------------------------------------
# FIXED VALUES — guardrails
# ---------------------------------------------------------------------------

# PII patterns, applied in this order on the progressively redacted text:
# (name, regex, redaction tag)
PII_PATTERNS = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    ("SSN_NO_DASH", r"\b\d{3}\s?\d{2}\s?\d{4}\b", "[REDACTED_SSN]"),
    ("PHONE", r"\b\d{3}-\d{3}-\d{4}\b", "[REDACTED_PHONE]"),
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[REDACTED_EMAIL]"),
    ("ZIP_PLUS_4", r"\b\d{5}-\d{4}\b", "[REDACTED_ZIP]"),
    ("CREDIT_CARD", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[REDACTED_CARD]"),
]

# Content policy: category -> terms, in check order.
CONTENT_TERMS = {
    "self_harm": [
        "suicide", "self-harm", "suicidal ideation", "overdose intentional", "attempted suicide",
    ],
    "violence": ["homicide", "murder", "assault", "abuse", "domestic violence"],
    "substance_abuse": ["alcohol abuse", "drug abuse", "addiction", "withdrawal"],
}
CONTENT_CONTEXT_CHARS = 20

# Plausibility rules.
MAX_COMORBIDITIES_BY_AGE = [(30, 4), (65, 6)]  # age < 30 -> 4, age < 65 -> 6
MAX_COMORBIDITIES_ELSE = 10
MALE_INCOMPATIBLE = ["ovarian_cancer", "cervical_cancer", "uterine_cancer"]
FEMALE_INCOMPATIBLE = ["prostate_cancer", "testicular_cancer"]
PEDIATRIC_AGE = 18

DISTRIBUTION_TOLERANCE = 0.05
MAX_EXAMPLES = 100

# Check names in report order, and their severity.
CHECKS = ["pii_scan", "name_safety", "content_policy", "plausibility", "distribution", "uniqueness"]
CHECK_SEVERITY = {
    "pii_scan": "Error",
    "name_safety": "Error",
    "uniqueness": "Error",
    "content_policy": "Warning",
    "plausibility": "Warning",
    "distribution": "Warning",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — evaluation set
# ---------------------------------------------------------------------------

REACTION_DRUGS = ["DrugX", "DrugY"]
ALL_DRUGS = ["DrugX", "DrugY", "DrugZ", "Aspirin", "Metformin", "Lisinopril", "Albuterol"]
UNKNOWN_DRUGS = ["DrugQ", "DrugW", "Cephalexin", "Warfarin"]
UNKNOWN_CONDITIONS = ["lupus", "psoriasis", "cirrhosis", "epilepsy"]
AGGREGATE_CONTEXT_LIMIT = 5
NON_EMPTY_ATTEMPTS = 4
FAKE_ID_BASE = 900_000_000
FAKE_ID_SPAN = 1_000_000

# Query classes in pick order with weights; the last three can be disabled.
QUERY_CLASS_WEIGHTS = [
    ("Lookup", 0.12),
    ("FilteredLookup", 0.13),
    ("Comparative", 0.15),
    ("EvidenceRetrieval", 0.20),
    ("Aggregation", 0.15),
    ("MultiHop", 0.15),
    ("Negative", 0.10),
]
CLASS_DIFFICULTY = {
    "Lookup": "Easy",
    "FilteredLookup": "Medium",
    "Comparative": "Medium",
    "EvidenceRetrieval": "Easy",
    "Aggregation": "Medium",
    "MultiHop": "Hard",
    "Negative": "Easy",
}
