"""Types, enumerations and vocabulary of structured cases."""

from __future__ import annotations

from dataclasses import dataclass

# The enumerations, languages, patterns and word lists of the data model.
STATUSES = ("present", "absent", "uncertain")
INFO_STATUSES = ("unknown", "none", "reported")
UNITS = ("hours", "days", "weeks")
MISSING = ("duration", "medications", "allergies")
LANGUAGES = ("en", "de", "ar_msa", "fr", "es", "hi", "sw")
SPLITS = ("train", "validation", "test")
PATTERNS = ("simple", "negation", "uncertainty", "mixed", "missing_duration", "missing_medications", "missing_allergies", "multiple_present")
PATTERN_WEIGHTS = (0.15, 0.15, 0.15, 0.15, 0.10, 0.10, 0.10, 0.10)
GROUPS = {
    "respiratory": (("cough", "sore throat", "shortness of breath", "runny nose"), ("fever", "fatigue", "headache", "chest pain")),
    "gastrointestinal": (("abdominal pain", "nausea", "vomiting", "diarrhea", "constipation"), ("fever", "fatigue", "dizziness", "loss of appetite")),
    "general": (("headache", "dizziness", "fatigue", "fever", "weakness"), ("nausea", "loss of appetite")),
    "pain": (("back pain", "headache", "abdominal pain", "chest pain", "joint pain"), ("fatigue", "dizziness")),
    "urinary": (("painful urination", "frequent urination"), ("fever", "abdominal pain", "back pain")),
    "skin": (("rash", "itching"), ("fever", "swelling", "pain")),
}
MEDICATIONS = ("ibuprofen", "paracetamol", "aspirin", "amoxicillin")
ALLERGENS = ("penicillin", "aspirin", "ibuprofen")
STATUS_LABELS = {"present": "Present", "absent": "Absent", "uncertain": "Uncertain"}
INFO_LABELS = {"unknown": "Not reported", "none": "None reported", "reported": "Reported"}
MISSING_LABELS = {"duration": "symptom duration", "medications": "current medications", "allergies": "allergies"}
PROMPT_HIDDEN = ("_split", "case_pattern", "symptom_group", "case_id")
SAMPLE_SOURCE, SCHEMA_VERSION = "synthetic", "v2"
SEED, MAX_TOKENS = 42, 512

DURATION = "struct<value:int,unit:string>"
SYMPTOM = f"struct<name:string,status:string,duration:{DURATION}>"
INFO = "struct<status:string,items:array<string>>"
TARGET_FIELDS = {
    "chief_complaint": "string",
    "symptoms": f"array<{SYMPTOM}>",
    "medications": INFO,
    "allergies": INFO,
    "missing_information": "array<string>",
}
TARGET = "struct<" + ",".join(f"{k}:{v}" for k, v in TARGET_FIELDS.items()) + ">"
CASE = "case_id string, case_pattern string, symptom_group string, " + ", ".join(f"{k} {v}" for k, v in TARGET_FIELDS.items())
SAMPLE = f"case_id string, split string, language string, utterance string, target {TARGET}, source string, schema_version string"
QC_ERROR = "array<struct<type:string,description:string>>"
QC = f"case_id string, split string, language string, semantic_passed boolean, language_passed boolean, semantic_errors {QC_ERROR}, language_errors {QC_ERROR}, judge_model string"
PREDICTION = f"case_id string, split string, language string, utterance string, target {TARGET}, prediction string"

METRICS = (
    "valid_json",
    "schema_valid",
    "raw_exact",
    "core_exact",
    "pipeline_exact",
    "chief_complaint",
    "symptom_extraction",
    "symptom_status",
    "duration",
    "medication",
    "allergy",
    "missing_information_raw",
    "missing_information_derived",
)
ERROR_TYPES = (
    "invalid_json",
    "wrong_chief_complaint",
    "missing_symptom",
    "extra_symptom",
    "duplicate_symptom",
    "wrong_symptom_status",
    "wrong_duration",
    "medication_error",
    "allergy_error",
)


@dataclass(frozen=True)
class Dialect:
    """Choices in which the evaluators differ."""

    name: str
    brace_fallback: bool
    #: What a string field that holds something else becomes: an empty string, or itself.
    other_to_empty: bool
    #: A malformed duration counts as none.
    bad_duration_is_none: bool
    #: Statuses and units are compared in lower case.
    lower_status: bool
    #: Of entries with one name: ``last`` wins, the whole map is ``void``, or the comparison is ``false``.
    duplicates: str
    #: JSON types of a duration's value that the schema allows.
    value_types: tuple[str, ...]
    absent_may_have_duration: bool
    fixed_missing: bool
    #: Accuracy as a fraction, a percentage, or a percentage with two digits.
    accuracy: str


E1 = Dialect("e1", True, True, True, False, "last", ("int", "float", "bool"), True, False, "percent2")
E2 = Dialect("e2", False, False, False, True, "void", ("int", "bool"), False, True, "fraction")
E3 = Dialect("e3", True, False, False, True, "false", ("int", "float"), True, False, "percent")
DIALECTS = {d.name: d for d in (E1, E2, E3)}
