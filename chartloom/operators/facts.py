"""Atomic facts of a section's text: labelled values, tables unrolled into lines, diagnoses, plans, referrals, orders.

Everything is a column: an array of (table_type, columns, search_text, raw_text) per text, so facts of all sections come
from one projection. Texts are read by line; sequential scans are aggregates over a text's lines, inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT = "array<struct<table_type:string,columns:map<string,string>,search_text:string,raw_text:string>>"

# Labels whose value stands on the next line, head cells of tables, and names that start a fact.
LABELS = {"Blood Type": "blood_type", "Patient ID": "patient_id", "Full Name": "full_name", "Date of Birth": "dob", "Gender": "gender"}
SEVERITIES = ["mild", "moderate", "severe"]
LAB_TEST = r"(?i)^(?:HbA1c|LDL(?:\s*Cholesterol)?|HDL|Triglycerides|Creatinine|eGFR|TSH|Glucose|BMI)$"
DIAGNOSIS = r"(?m)^([A-Z]\d{2}(?:\.\d{1,4})?)\s*[—\-]\s*(.+)$"
BULLET = r"(?m)^[•\-]\s*(.+)$"
RELATIVE = r"(?i)(?:[•\-]\s*)?(Father|Mother|Sister|Brother):\s*(.+)"
STACKED_SPECIALTY = r"(?i)^(?:Cardiology|Ophthalmology|Nephrology|Endocrinology|Registered Dietitian|Diabetic Education Program|Podiatry|Neurology)$"
INLINE_SPECIALTY = (
    r"(?im)^(Cardiology|Ophthalmology|Nephrology|Endocrinology|Registered Dietitian|Diabetic Education Program|Podiatry|Neurology|"
    r"Pulmonology|Rheumatology|Gastroenterology|Dermatology|Urology|Psychiatry)\b\s*(.+)$"
)
STUDY = r"(?i)(Renal Ultrasound(?:\s+with\s+Doppler)?|Chest X-ray(?:\s*\(CXR\))?|Electrocardiogram(?:\s*\(ECG\))?)(?=(?s:(.{0,220})))"
SIGNATURE = r"(?i)Electronically signed by:\s*(Dr\.\s*[^,\n]+(?:,\s*MD)?)\s*Date:\s*([A-Za-z]+\s+\d{1,2},\s+\d{4})"
PRESSURE, POUNDS = r"\b(\d{2,3}\s*/\s*\d{2,3})\s*(?:mmHg)?\b", r"(?is)\bWeight\b.*?(\d{2,3})\s*lbs"
# Which sections give which facts.
HISTORY_KEYS = ["demographics", "patient_summary", "allergies", "medications", "medical_history", "social_family", "family_history", "general"]
LAB_KEYS = ["laboratory_results", "objective", "plan"]
SIGNED_KEYS = ["signature", "follow_up", "general", "clinical_notes", "plan", "patient_education", "imaging_orders", "referrals", "laboratory_orders"]
VITAL_KEYS = ["subjective", "objective", "vitals", "general", "encounter_key_facts"]
#: A plan of fewer characters without bullets is one fact, of which so many are searched.
PLAN_BLOCK, PLAN_SEARCHED = 2500, 1200


def _none() -> Column:
    return F.array().cast(FACT)


def fact(table_type: str, columns: dict[str, Column], search: Column, raw: Column) -> Column:
    entries = [x for name, c in columns.items() for x in (F.lit(name), c)]
    return F.struct(F.lit(table_type).alias("table_type"), (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("columns"), search.alias("search_text"), raw.alias("raw_text"))


def text_lines(text: Column) -> Column:
    """The lines of a text without blanks around them, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def between(lines: Column, start: str, ends: str) -> Column:
    """The lines after the first that fits ``start``, up to the next that fits ``ends``; none without a start."""
    at = F.array_position(F.transform(lines, lambda x: x.rlike("(?i)" + start)), True).cast("int")
    rest = F.slice(lines, at + 1, F.greatest(F.lit(0), F.size(lines) - at))
    stop = F.array_position(F.transform(rest, lambda x: x.rlike("(?i)" + ends)), True).cast("int")
    return F.when(at == 0, F.array().cast("array<string>")).when(stop == 0, rest).otherwise(F.slice(rest, 1, F.greatest(F.lit(0), stop - 1)))


def _without(lines: Column, heads) -> Column:
    return F.filter(lines, lambda x: ~x.isin(*heads))


def strides(body: Column, width: int) -> Column:
    """Lines in rows of ``width``, an incomplete last row left out."""
    n = F.floor(F.size(body) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(body, i * width + 1, width))).otherwise(F.array().cast("array<array<string>>"))


def triples_with_year(body: Column) -> Column:
    """Rows (name, year, note) of a table whose other lines break the rhythm: three lines on after a row, one after any other line."""
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<array<string>>").alias("rows"))

    def step(acc: Column, i: Column) -> Column:
        row = F.slice(body, i, 3)
        hit = (acc["skip"] == 0) & (F.size(row) == 3) & F.get(row, F.lit(1)).rlike(r"^\d{4}$")
        return F.struct(F.when(hit, F.lit(2)).otherwise(F.greatest(F.lit(0), acc["skip"] - 1)).alias("skip"), F.when(hit, F.array_append(acc["rows"], row)).otherwise(acc["rows"]).alias("rows"))

    return F.when(F.size(body) >= 3, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(body) - 2)), start, step)["rows"]).otherwise(F.array().cast("array<array<string>>"))


def _groups(text: Column, pattern: str, *at: int) -> Column:
    """The wanted groups of all matches, as arrays."""
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in at))


def history_facts(text: Column, lines: Column) -> Column:
    """Labelled values, allergies, current medications, medical, surgical and family history."""
    at = lambda r, i: F.get(r, F.lit(i))
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    names = F.create_map(*(x for kv in LABELS.items() for x in map(F.lit, kv)))
    pairs = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("label"), F.get(lines, i + 1).alias("value"))), lambda p: p["label"].isin(*LABELS) & p["value"].isNotNull())
    said = lambda p: join(p["label"], ": ", p["value"])
    labelled = F.transform(pairs, lambda p: F.struct(F.lit("demographics").alias("table_type"), F.map_from_arrays(F.array(F.try_element_at(names, p["label"])), F.array(p["value"])).alias("columns"), said(p).alias("search_text"), said(p).alias("raw_text")))
    rows = strides(_without(between(lines, "^Allergies$", "^Current Medications$|^Medical|^Social"), ("Substance", "Reaction", "Severity")), 3)
    allergy = lambda r: join(at(r, 0), " — Reaction: ", at(r, 1), " — Severity: ", at(r, 2))
    allergies = F.transform(F.filter(rows, lambda r: F.lower(at(r, 2)).isin(*SEVERITIES)), lambda r: fact("allergies", {"substance": at(r, 0), "reaction": at(r, 1), "severity": at(r, 2)}, join("Allergies | ", allergy(r)), allergy(r)))
    rows = strides(_without(between(lines, "^Current Medications$", "^Medical|^Social|^Allergies"), ("Medication", "Dose", "Frequency", "Indication")), 4)
    drugs = F.transform(rows, lambda r: fact("current_medications", {"medication": at(r, 0), "dose": at(r, 1), "frequency": at(r, 2), "indication": at(r, 3)}, join("Current Medications | ", at(r, 0), " | Dose ", at(r, 1), " | Frequency ", at(r, 2), " | Indication ", at(r, 3)), join(at(r, 0), " ", at(r, 1), ", ", at(r, 2), ", Indication: ", at(r, 3))))
    rows = strides(_without(between(lines, r"^Medical\s*&\s*Surgical History$", "^Procedure$|^Social|^Family History"), ("Condition", "Year Diagnosed", "Status")), 3)
    illness = lambda r: join(at(r, 0), " — Year Diagnosed ", at(r, 1), " — Status: ", at(r, 2))
    medical = F.transform(F.filter(rows, lambda r: at(r, 1).rlike(r"^\d{4}$")), lambda r: fact("medical_history", {"condition": at(r, 0), "year": at(r, 1), "status": at(r, 2)}, join("Medical History | ", illness(r)), illness(r)))
    rows = triples_with_year(_without(between(lines, "^Procedure$", "^Social|^Family History|^Review of Systems"), ("Procedure", "Year", "Notes")))
    operation = lambda r: join(at(r, 0), " (", at(r, 1), ", ", F.rtrim(at(r, 2), F.lit(".")), ")")
    surgical = F.transform(rows, lambda r: fact("surgical_history", {"procedure": at(r, 0), "year": at(r, 1), "notes": at(r, 2)}, join("Surgical History | ", operation(r)), operation(r)))
    kin = lambda m: join("Family History — ", m["g1"], ": ", F.trim(m["g2"]))
    family = F.transform(_groups(text, RELATIVE, 1, 2), lambda m: fact("family_history", {"relation": m["g1"], "condition": F.trim(m["g2"])}, kin(m), kin(m)))
    return F.concat(labelled, allergies, drugs, medical, surgical, family)


def referral_facts(text: Column, lines: Column) -> Column:
    """Referrals with the reason on the next line, and those with it on the same line; a line may count as both."""
    pairs = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("g1"), F.coalesce(F.get(lines, i + 1), F.lit("")).alias("g2"))), lambda p: p["g1"].rlike(STACKED_SPECIALTY) & ~F.lower(p["g2"]).isin("specialty", "reason"))
    inline = F.filter(F.transform(_groups(text, INLINE_SPECIALTY, 1, 2), lambda m: F.struct(m["g1"].alias("g1"), F.trim(m["g2"]).alias("g2"))), lambda m: m["g2"] != "")
    said = lambda m: F.concat(m["g1"], F.lit(" — "), m["g2"])
    return F.transform(F.concat(pairs, inline), lambda m: fact("referrals", {"specialty": m["g1"], "reason": m["g2"]}, F.concat(F.lit("Referrals | "), said(m)), said(m)))


def facts_of(key: Column, text: Column) -> Column:
    """All atomic facts of a section, by its key; none for a null text. Notes' sentences are no facts."""
    text = F.coalesce(text, F.lit(""))
    lines = text_lines(text)
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    tests = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("t"), F.get(lines, i + 1).alias("v"))), lambda p: p["t"].rlike(LAB_TEST) & p["v"].rlike(r"^\d"))
    labs = F.transform(tests, lambda p: fact("laboratory_results", {"test": p["t"], "value": p["v"]}, line("Laboratory Results | ", p["t"], " | Value ", p["v"]), line(p["t"], ": ", p["v"])))
    codes = _groups(text, DIAGNOSIS, 1, 2)
    code = lambda m: line(m["g1"], " — ", m["g2"])
    each = F.transform(codes, lambda m: fact("diagnoses", {"code": m["g1"], "desc": m["g2"]}, line("Assessment / Diagnoses | ", code(m)), code(m)))
    said = F.transform(codes, code)
    together = F.array(fact("diagnoses_set", {"codes": F.array_join(F.transform(codes, lambda m: m["g1"]), ";")}, line("Assessment / Diagnoses | ", F.array_join(said, "; ")), F.array_join(said, "\n")))
    diagnoses = F.concat(each, F.when(F.size(codes) >= 2, together).otherwise(_none()))
    bullets = F.transform(F.regexp_extract_all(text, F.lit(BULLET), F.lit(1)), lambda b: F.trim(b))
    block = F.when((F.length(text) < PLAN_BLOCK) & (text != ""), F.array(fact("plan_block", {}, line("Plan | ", F.left(text, F.lit(PLAN_SEARCHED))), text))).otherwise(_none())
    plans = F.when(F.size(bullets) > 0, F.transform(bullets, lambda b: fact("plan_item", {"item": b}, line("Plan | ", b), line("• ", b)))).otherwise(block)
    studies = F.transform(_groups(text, STUDY, 1, 2), lambda m: F.struct(m["g1"].alias("s"), F.trim(F.replace(m["g2"], F.lit("\n"), F.lit(" "))).alias("w")))
    imaging = F.transform(studies, lambda m: fact("imaging_orders", {"study": m["s"], "context": m["w"]}, line("Imaging Orders | ", m["s"], " — ", m["w"]), line(m["s"], " — ", m["w"])))
    signer, day = F.regexp_extract(text, SIGNATURE, 1), F.regexp_extract(text, SIGNATURE, 2)
    sign = line("Electronically signed by: ", signer, " Date: ", day)
    signed = F.when(signer != "", F.array(fact("signature", {"provider": signer, "date": day}, sign, sign))).otherwise(_none())
    bp, weight = F.replace(F.regexp_extract(text, PRESSURE, 1), F.lit(" "), F.lit("")), F.regexp_extract(text, POUNDS, 1)
    measured = F.concat_ws("; ", F.when(bp != "", line("BP ", bp, " mmHg")), F.when(weight != "", line("Weight ", weight, " lbs")))
    vitals = F.when(measured != "", F.array(fact("vitals", {"bp": F.nullif(bp, F.lit("")), "weight": F.when(weight != "", line(weight, " lbs"))}, line("Vitals | ", measured), measured))).otherwise(_none())
    gated = [(HISTORY_KEYS, history_facts(text, lines)), (LAB_KEYS, labs), (["assessment"], diagnoses), (["plan"], plans), (["referrals"], referral_facts(text, lines)), (["imaging_orders"], imaging), (SIGNED_KEYS, signed), (VITAL_KEYS, vitals)]
    return F.concat(*(F.coalesce(F.when(key.isin(*keys), found.cast(FACT)), _none()) for keys, found in gated))


def section_facts(texts: DataFrame) -> DataFrame:
    """The facts of sections (document_id, encounter_id, chunk_id, key, page_start, page_end, text): one row per fact, in order.

    A section of an encounter gives no history facts: those are told once, in front of the encounters.
    """
    key = F.when(F.col("encounter_id").isNotNull() & F.col("key").isin(*HISTORY_KEYS), F.lit(None)).otherwise(F.col("key"))
    rows = texts.select("document_id", "encounter_id", "chunk_id", "key", "page_start", "page_end", F.posexplode(facts_of(key, F.col("text"))).alias("fact_no", "f"))
    return rows.select("document_id", "encounter_id", "chunk_id", "key", "page_start", "page_end", "fact_no", "f.*")
