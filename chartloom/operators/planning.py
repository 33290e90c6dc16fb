"""Reading of query texts, many at once: intent, sections, entities, expansions and channel weights, from tables of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import SYNONYMS, normalize_whitespace, written_dates
from chartloom.session import spread_join

# Words that hint at a section, by substring, in the order in which sections are given.
SECTION_HINTS = {
    "vitals": ["blood pressure", "bp", "weight", "vitals"],
    "assessment": ["icd", "diagnosis", "diagnoses", "assessment", "diagnosis codes"],
    "plan": ["started", "initiate", "increase", "added", "medication", "plan", "why", "worked up", "workup", "considered"],
    "laboratory_results": ["lab", "hba1c", "ldl", "cholesterol", "value", "lab values"],
    "laboratory_orders": ["plasma renin", "aldosterone", "tsh", "laboratory orders"],
    "referrals": ["referred", "referral", "specialty", "cardiology"],
    "signature": ["signed", "electronically signed", "signature"],
    "allergies": ["allergy", "allergies", "reaction"],
    "medications": ["medication", "dose", "taking"],
    "medical_history": ["diagnosed", "history", "status", "chronic"],
    "surgical_history": ["surgical", "surgery", "procedure"],
    "family_history": ["family history", "father", "mother"],
    "demographics": ["blood type", "date of birth", "demographics"],
    "imaging_orders": ["imaging", "ultrasound", "x-ray", "ecg", "doppler"],
    "clinical_notes": ["clinical notes", "discussed"],
    "follow_up": ["follow-up", "follow up", "return", "weeks", "timeframe"],
}
# Words that hint at a type of encounter.
ENCOUNTER_HINTS = {
    "annual physical": ["annual physical", "annual physical exam"],
    "office visit": ["office visit"],
    "telehealth": ["telehealth"],
    "follow-up": ["follow-up", "follow up"],
    "progress note": ["progress note"],
}
# Intents in the order in which they are tried; every group must have a word in the query.
INTENT_RULES = [
    ("signature_lookup", [["signed", "signature"]]),
    ("lab_value_linked_to_medication_change", [["hba1c", "ldl", "lab"], ["medication", "started", "increased", "dose", "initiated", "added"]]),
    ("icd_code_lookup", [["icd", "diagnosis code"]]),
    ("table_heavy", [["table"]]),
    ("table_heavy", [["lab"], ["value"]]),
    ("multi_part_clinical", "two sections"),
    ("clinical_explanation", [["why", "rationale", "because", "reason"]]),
    ("metadata_exact", "signature, demographics or medications"),
]
# Weights of the channels by intent (lexical, dense, structured, visual).
WEIGHTS = {
    "general": (0.35, 0.25, 0.30, 0.10),
    "lab_value_linked_to_medication_change": (0.35, 0.25, 0.30, 0.10),
    "signature_lookup": (0.40, 0.15, 0.40, 0.05),
    "metadata_exact": (0.40, 0.15, 0.40, 0.05),
    "icd_code_lookup": (0.40, 0.15, 0.40, 0.05),
    "table_heavy": (0.25, 0.20, 0.25, 0.30),
    "clinical_explanation": (0.20, 0.45, 0.20, 0.15),
    "multi_part_clinical": (0.30, 0.30, 0.30, 0.10),
}
# Laboratory tests known by name, and what a query's words add to it. Every group must have a word in the query.
LAB_TERMS = ["HbA1c", "LDL", "HDL", "TSH", "BMI"]
EXPANSIONS = [
    ([["blood pressure", " bp "]], ["BP", "mmHg"]),
    ([["signed", "signature"]], ["Electronically signed", "Signed by"]),
    ([["imaging", "ultrasound"]], ["Ultrasound", "Imaging", "Doppler"]),
    ([["icd", "diagnosis"]], ["ICD", "Assessment", "Diagnoses"]),
    ([["lab"]], ["HbA1c", "LDL", "Laboratory Results"]),
    ([["secondary"], ["hypertension"]], ["secondary hypertension", "renal artery stenosis", "primary aldosteronism", "plasma renin", "aldosterone", "TSH"]),
    ([["sglt2"]], ["SGLT2 inhibitor", "Empagliflozin", "Jardiance", "HbA1c", "LDL"]),
]
CHANNELS = ("lexical", "dense", "structured", "visual")
MONTHS = "january february march april may june july august september october november december".split()
NUMBER = r"(?i)\b\d{2,3}\s*/\s*\d{2,3}\b|\b\d+(?:\.\d+)?%|\b\d+\s*mg\b|\b\d{2,3}\s*lbs\b"
DOSE = r"(?i)\b\d+(?:\.\d+)?\s*mg\b"
CODE = r"\b[A-TV-Z]\d{2}(?:\.\d{1,4})?\b"
PERSON = r"(?:Dr\.\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?:\s*,\s*(?:MD|DO|NP|PA))?"
#: Words of the longest name that is looked up in a query.
NAME_WORDS = 3


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _all_of(text: Column, groups) -> Column:
    out = F.lit(True)
    for words in groups:
        out = out & _any(text, words)
    return out


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _hinted(low: Column, hints: dict[str, list[str]]) -> Column:
    return F.array_compact(F.array(*(F.when(_any(low, words), F.lit(key)) for key, words in hints.items())))


def hinted_sections(text: Column) -> Column:
    """Keys of the sections that a text hints at by substring, in the order of the hint table."""
    return _hinted(F.lower(text), SECTION_HINTS)


def intent(text: Column) -> Column:
    """What a query asks for, by the first rule that holds."""
    low, found = F.lower(text), hinted_sections(text)
    special = {
        "two sections": F.size(found) >= 2,
        "signature, demographics or medications": F.arrays_overlap(found, F.array(*map(F.lit, ("signature", "demographics", "medications")))),
    }
    out = F.lit("general")
    for label, rule in reversed(INTENT_RULES):
        out = F.when(special[rule] if isinstance(rule, str) else _all_of(low, rule), label).otherwise(out)
    return out


def _grams(low: Column) -> Column:
    """Runs of up to NAME_WORDS words of a text."""
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'-]*"), F.lit(0))

    def runs(n: int) -> Column:
        return F.array_compact(F.transform(words, lambda x, i: F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, n), " "))))

    return F.array_distinct(F.flatten(F.array(*map(runs, range(1, NAME_WORDS + 1)))))


def _distinct_by_case(values: Column) -> Column:
    """The values in order, without those that repeat an earlier one in another case."""
    low = F.transform(values, lambda v: F.lower(v))
    return F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def plan(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Plans of queries (query_id, text); other columns are dropped.

    Columns: query_id, text, intent, sections, dates, medications, providers, encounter_types, numbers, codes, labs,
    expansions, expanded (the text with them), needles (lower case, distinct, two characters or more), and a weight
    per channel that sum to 1. Medications are the runs of up to three words that are among ``names`` (one column,
    name; case and blanks are ignored), sorted. A year or month name in the query moves weight to the structured and
    lexical channels. A null text has the intent general and no entities.
    """
    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<string>")
    low = F.lower(text)
    base = queries.select("query_id", text.alias("text"))
    known = names.select(F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    grams = base.select("query_id", F.explode(_grams(F.lower("text"))).alias("name")).distinct()
    # A frequent name is in many queries; those are spread.
    meds = spread_join(grams, known, ["name"], F.col("query_id")).groupBy("query_id").agg(F.array_sort(F.collect_set("name")).alias("medications"))
    base = base.join(meds, "query_id", "left").withColumn("medications", F.coalesce("medications", none))
    synonyms = F.create_map(*(x for name, alias in SYNONYMS.items() for x in (F.lit(name), F.array(*map(F.lit, sorted({name, *alias}))))))
    aliases = F.array_distinct(F.flatten(F.transform("medications", lambda m: F.coalesce(F.try_element_at(synonyms, m), F.array(m)))))
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    labs = F.array_compact(F.array(*(F.when(low.contains(lab.lower()), F.lit(lab)) for lab in LAB_TERMS)))
    more_labs = F.when(_any(low, ("lab", "sglt2")), F.array(F.lit("HbA1c"), F.lit("LDL"))).otherwise(none)
    cues = F.flatten(F.array(*(F.when(_all_of(padded, groups), F.array(*map(F.lit, words))).otherwise(none) for groups, words in EXPANSIONS)))
    read = base.select(
        "query_id", "text", intent(F.col("text")).alias("intent"), hinted_sections(F.col("text")).alias("sections"), written_dates(F.col("text")).alias("dates"),
        "medications", aliases.alias("aliases"), F.transform(_found(F.col("text"), PERSON), lambda p: normalize_whitespace(p)).alias("providers"),
        _hinted(low, ENCOUNTER_HINTS).alias("encounter_types"), _found(F.col("text"), NUMBER).alias("numbers"), _found(F.col("text"), CODE).alias("codes"),
        F.array_distinct(F.concat(labs, more_labs)).alias("labs"), _distinct_by_case(F.concat(aliases, labs, cues)).alias("expansions"), _found(F.col("text"), DOSE).alias("_doses"),
    )
    all_needles = F.concat("medications", "providers", "codes", "numbers", "labs", "aliases", F.filter("expansions", lambda e: F.length(e) >= 4), "_doses")
    read = read.withColumn("needles", F.array_sort(F.array_distinct(F.filter(F.transform(all_needles, lambda n: F.lower(n)), lambda n: F.length(n) >= 2))))
    read = read.withColumn("expanded", F.concat_ws(" ", "text", F.array_join("expansions", " "), F.array_join("dates", " ")))
    read = read.withColumn("expanded", normalize_whitespace(F.col("expanded"))).drop("_doses")
    dated = low.rlike(r"\b(?:19|20)[0-9]{2}\b") | _any(low, MONTHS)
    table = F.create_map(*(x for name, w in WEIGHTS.items() for x in (F.lit(name), F.array(*map(F.lit, w)))))
    w = [F.element_at(F.element_at(table, F.col("intent")), i + 1) for i in range(4)]
    w[2] = F.when(dated, F.least(F.lit(0.45), w[2] + 0.10)).otherwise(w[2])
    w[0] = F.when(dated, F.least(F.lit(0.45), w[0] + 0.05)).otherwise(w[0])
    total = w[0] + w[1] + w[2] + w[3]
    return read.select("*", *(F.round(x / total, 6).alias(f"w_{c}") for x, c in zip(w, CHANNELS)))


def channel_weights(plans: DataFrame, share: dict[str, tuple[str, float]]) -> DataFrame:
    """(query_id, channel, weight) of the channels in use: channel -> (planned channel, factor)."""
    rows = F.array(*(F.struct(F.lit(c).alias("channel"), (F.col(f"w_{p}") * x).alias("weight")) for c, (p, x) in share.items()))
    return plans.select("query_id", F.explode(rows).alias("r")).select("query_id", "r.channel", "r.weight")
