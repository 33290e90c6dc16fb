"""Structure of charts: encounter intervals, sections, facts in lines, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.operators.order import ordinals, running_sum
from chartloom.operators.pages import latest_pages

# Section keys with the heading that opens each, in the order in which they are tried.
HEADINGS = [
    ("demographics", "patient demographics"), ("allergies", "allergies"), ("medications", "current medications"),
    ("family_history", "family history"), ("social_history", "social history"), ("surgical_history", "surgical history"),
    ("medical_history", "medical history"), ("ros", "review of systems"), ("subjective", "subjective"), ("objective", "objective"),
    ("vitals", "vital signs"), ("laboratory_results", "laboratory results"), ("assessment", "assessment"), ("plan", "plan of care"),
    ("laboratory_orders", "laboratory orders"), ("imaging_orders", "imaging orders"), ("referrals", "referrals"),
    ("clinical_notes", "clinical notes"), ("patient_education", "patient education"), ("follow_up", "follow-up instructions"),
]
#: Headings that mark a chart as written in the subjective, objective, assessment, plan style.
SOAP = ("subjective", "objective", "assessment", "plan of care")
ICD = r"\b([A-TV-Z][0-9]{2}(?:\.[0-9]{1,4})?)\b"
PRESSURE = r"\b([0-9]{2,3}/[0-9]{2,3}) mmHg"
WEIGHT = r"[Ww]eight was ([0-9]+(?:\.[0-9]+)?) kg"
ROW = r"^([A-Za-z][A-Za-z0-9 ]*?)(?:\t|; | \| |  )([0-9]+(?:\.[0-9]+)?)(?:\t|; | \| |  )([^\t;| ]+)(?:\t|; | \| |  )([a-z ]+)$"
ITEM = r"^ *(?:[-*•]|[0-9]+[.)]) +(.+)$"
SIGNED = r"[Ss]igned by ([^,.\n]+)"


def latest_encounters(encounters: DataFrame) -> DataFrame:
    """One row per encounter of a chart: the copy loaded last."""
    rest = [c for c in encounters.columns if c not in ("document_id", "encounter_id", "loaded_at")]
    return (
        encounters.where("document_id is not null and encounter_id is not null")
        .groupBy("document_id", "encounter_id").agg(F.max_by(F.struct(*rest), F.struct("loaded_at")).alias("e")).select("document_id", "encounter_id", "e.*")
    )


def closed_intervals(encounters: DataFrame, pages: DataFrame, overlap: bool = True) -> DataFrame:
    """Page intervals from the encounters' starts: (document_id, encounter_id, ordinal, start_page, end_page).

    An interval ends where the next one starts (``overlap``) or a page before, never before its own start, and the
    last one on the chart's last page. Encounters without start page are left out.
    """
    starts = latest_encounters(encounters).where("start_page is not null").select("document_id", "encounter_id", "start_page")
    starts = ordinals(starts, ["document_id"], ["start_page", "encounter_id"])
    following = starts.select("document_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("start_page").alias("next_start"))
    last = pages.where("document_id is not null").groupBy("document_id").agg(F.max("page_number").alias("last_page"))
    end = F.coalesce(F.col("next_start") - (0 if overlap else 1), F.col("last_page"), F.col("start_page"))
    return (
        starts.join(following, ["document_id", "ordinal"], "left").join(last, "document_id", "left")
        .select("document_id", "encounter_id", F.col("ordinal").cast("bigint").alias("ordinal"), "start_page", F.greatest("start_page", end).alias("end_page"))
    )


def encounter_of_page(pages: DataFrame, encounters: DataFrame) -> DataFrame:
    """Each page with the first encounter whose given interval holds it, null where none does.

    The range join is an equi join on the pages of each interval. First means lowest start, then id.
    """
    own = latest_encounters(encounters).where("start_page <= end_page")
    spread = own.select("document_id", F.explode(F.sequence("start_page", "end_page")).alias("page_number"), "start_page", "encounter_id")
    first = spread.groupBy("document_id", "page_number").agg(F.min_by("encounter_id", F.struct("start_page", "encounter_id")).alias("encounter_id"))
    every = pages.where("document_id is not null and page_number is not null").select("document_id", "page_number").distinct()
    return every.join(first, ["document_id", "page_number"], "left")


def chart_style(pages: DataFrame, first_pages: int = 8, least: int = 2) -> DataFrame:
    """(document_id, markers, style): soap if the chart's first pages hold at least ``least`` marker headings."""
    lines = latest_pages(pages).where(F.col("page_number") <= first_pages).select("document_id", F.explode_outer(F.split("clean_text", "\n")).alias("line"))
    marks = lines.groupBy("document_id").agg(F.count_if(F.lower(F.trim("line")).isin(*SOAP)).alias("markers"))
    return marks.withColumn("style", F.when(F.col("markers") >= least, "soap").otherwise("generic"))


def section_key(line: Column) -> Column:
    """The key of the section a line opens, null for any other line; "(continued)" opens none."""
    plain = F.lower(F.trim(line))
    out = F.lit(None).cast("string")
    for key, heading in reversed(HEADINGS):
        out = F.when(plain == heading, key).otherwise(out)
    return out


def sections(pages: DataFrame) -> DataFrame:
    """Sections of each chart: (document_id, section_no, section, start_page, end_page, lines, characters).

    A section runs from its heading to the next one, over page breaks; section 0 is what stands before the first.
    """
    lines = (
        latest_pages(pages).select("document_id", "page_number", F.posexplode(F.split("clean_text", "\n")).alias("pos", "line"))
        .where("trim(line) <> ''").withColumn("key", section_key(F.col("line"))).withColumn("opens", F.col("key").isNotNull().cast("int"))
    )
    numbered = running_sum(lines, ["document_id"], ["page_number", "pos"], "opens", "section_no")
    return numbered.groupBy("document_id", F.col("section_no").cast("bigint").alias("section_no")).agg(
        F.coalesce(F.max("key"), F.lit("general")).alias("section"), F.min("page_number").alias("start_page"), F.max("page_number").alias("end_page"),
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"),
    )


# Headings that split a chart's text, and how the beginning of a section tells its key, in the order in which it is tried.
SPLIT_HEADINGS = (
    r"S\s*[—\-]\s*Subjective|O\s*[—\-]\s*Objective|A\s*[—\-]\s*Assessment|P\s*[—\-]\s*Plan|Laboratory Results|Laboratory Orders|Imaging Orders|Referrals|"
    r"Clinical Notes|Patient Education|Follow-Up Instructions|Electronically signed by:|Encounter\s+#\d+\s*\||Patient Demographics|Allergies|Current Medications|"
    r"Medical\s*&\s*Surgical History|Social\s*&\s*Family History|Family History|Review of Systems"
)
LABELS = [
    ("demographics", r"^Patient Demographics\s*$"), ("allergies", r"^Allergies\s*$"), ("medications", r"^Current Medications\s*$"), ("medical_history", r"^Medical\s*&\s*Surgical History\s*$"),
    ("social_family", r"^Social\s*&\s*Family History\s*$"), ("family_history", r"^Family History\s*$"), ("ros", r"^Review of Systems"), ("subjective", r"^S\s*[—\-]\s*Subjective"),
    ("objective", r"^O\s*[—\-]\s*Objective"), ("laboratory_results", r"^Laboratory Results"), ("assessment", r"^A\s*[—\-]\s*Assessment"), ("plan", r"^P\s*[—\-]\s*Plan"),
    ("laboratory_orders", r"^Laboratory Orders\s*$"), ("imaging_orders", r"^Imaging Orders\s*$"), ("referrals", r"^Referrals\s*$"), ("clinical_notes", r"^Clinical Notes\s*$"),
    ("patient_education", r"^Patient Education"), ("follow_up", r"^Follow-Up Instructions\s*$"), ("signature", r"^Electronically signed by:"),
]
LABEL_HEAD = 240


def section_label(text: Column) -> Column:
    """The key that the beginning of a section's text tells: its heading, a bullet, a code, vital signs, else general."""
    head = F.left(F.regexp_replace(text, r"^\s+", ""), F.lit(LABEL_HEAD))
    out = F.when(head.startswith("•"), "plan").when(head.rlike(r"\b[A-Z]\d{2}(?:\.\d{1,4})?\s*[—\-]"), "assessment").when(head.rlike(r"(?im)^(?:BP|Vitals)\b"), "vitals").otherwise("general")
    for key, pattern in reversed(LABELS):
        out = F.when(head.rlike("(?im)" + pattern), key).otherwise(out)
    return out


def labelled_sections(pages: DataFrame, encounters: DataFrame) -> DataFrame:
    """Sections between headings within each encounter, and within what stands before or outside of them (no encounter).

    Columns: document_id, encounter_id, section_no (from 0), section, start_page, end_page, text. A section runs over
    page breaks to the next heading of the same encounter; a page goes to the first encounter that holds it.
    """
    parts = F.filter(F.split("clean_text", rf"(?im)(?=^(?:{SPLIT_HEADINGS}))"), lambda x: ~x.rlike(r"^\s*$"))
    rows = latest_pages(pages).select("document_id", "page_number", F.posexplode(parts).alias("pos", "part"))
    rows = rows.join(encounter_of_page(pages, encounters), ["document_id", "page_number"], "left").withColumn("visit", F.coalesce("encounter_id", F.lit("")))
    rows = rows.withColumn("opens", F.col("part").rlike(rf"(?i)^(?:{SPLIT_HEADINGS})").cast("int"))
    numbered = running_sum(rows, ["document_id", "visit"], ["page_number", "pos"], "opens", "section_no")
    whole = numbered.groupBy("document_id", "encounter_id", F.col("section_no").cast("bigint").alias("section_no")).agg(
        F.min("page_number").alias("start_page"), F.max("page_number").alias("end_page"), F.array_sort(F.collect_list(F.struct("page_number", "pos", "part"))).alias("l")
    )
    text = F.regexp_replace(F.array_join(F.transform("l", lambda s: s["part"]), "\n\n"), r"^\s+|\s+$", "")
    return whole.withColumn("text", text).select("document_id", "encounter_id", "section_no", section_label(F.col("text")).alias("section"), "start_page", "end_page", "text")


def page_lines(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, line_no, line) of the pages' clean_text, blank lines left out."""
    return (
        latest_pages(pages).select("document_id", "page_number", F.posexplode(F.split("clean_text", "\n")).alias("pos", "line"))
        .where("trim(line) <> ''").select("document_id", "page_number", (F.col("pos") + 1).alias("line_no"), "line")
    )


def table_rows(pages: DataFrame) -> DataFrame:
    """Rows of result tables, whatever separates their cells: analyte, value, unit, trend."""
    part = lambda i: F.regexp_extract("line", ROW, i)
    return page_lines(pages).where(F.col("line").rlike(ROW)).select(
        "document_id", "page_number", "line_no", part(1).alias("analyte"), part(2).cast("double").alias("value"), part(3).alias("unit"), F.trim(part(4)).alias("trend")
    )


def list_items(pages: DataFrame) -> DataFrame:
    """Items of bulleted and numbered lists."""
    return page_lines(pages).where(F.col("line").rlike(ITEM)).select("document_id", "page_number", "line_no", F.trim(F.regexp_extract("line", ITEM, 1)).alias("item"))


def code_sets(pages: DataFrame, least: int = 2) -> DataFrame:
    """Pages with several diagnosis codes: their distinct codes, sorted."""
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all("clean_text", F.lit(ICD), F.lit(1))))
    return latest_pages(pages).select("document_id", "page_number", codes.alias("codes")).where(F.size("codes") >= least)


def vitals(pages: DataFrame) -> DataFrame:
    """The first blood pressure and weight of each page that has either."""
    first = lambda p: F.nullif(F.regexp_extract("clean_text", p, 1), F.lit(""))
    out = latest_pages(pages).select("document_id", "page_number", first(PRESSURE).alias("pressure"), first(WEIGHT).cast("double").alias("weight_kg"))
    return out.where("pressure is not null or weight_kg is not null")


def signatures(pages: DataFrame) -> DataFrame:
    """The first signature of each signed page."""
    out = latest_pages(pages).select("document_id", "page_number", F.trim(F.regexp_replace(F.regexp_extract("clean_text", SIGNED, 1), r"\s+", " ")).alias("signer"))
    return out.where("signer <> ''")


def note_sentences(docs: DataFrame, words: list[str], least: int = 40, most: int = 600) -> DataFrame:
    """Sentences of documents that hold one of ``words`` and are between ``least`` and ``most`` characters long."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    found = docs.select("doc_id", F.posexplode(F.split(flat, r"(?<=[.!?]) ")).alias("pos", "sentence"))
    return found.where(F.lower("sentence").rlike("|".join(words)) & (F.length("sentence") > least) & (F.length("sentence") < most)).select(
        "doc_id", F.col("pos").cast("int").alias("pos"), "sentence"
    )


def entity_postings(docs: DataFrame, medications: DataFrame) -> DataFrame:
    """Distinct (kind, value, doc_id) of codes, blood pressures and medications in documents.

    Medications are matched as whole words against the distinct names of ``medications``, by an equi join of words.
    """
    text = F.col("text")
    codes = docs.select("doc_id", F.lit("icd").alias("kind"), F.explode(F.regexp_extract_all(text, F.lit(ICD), F.lit(1))).alias("value"))
    pressures = docs.select("doc_id", F.lit("pressure").alias("kind"), F.explode(F.regexp_extract_all(text, F.lit(PRESSURE), F.lit(1))).alias("value"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))).alias("value"))
    names = medications.select(F.lower(F.trim("medication")).alias("value")).where("value rlike '^[a-z]+$'").distinct()
    drugs = words.join(names, "value").select("doc_id", F.lit("medication").alias("kind"), "value")
    return codes.unionByName(pressures).unionByName(drugs).distinct().select("kind", "value", "doc_id")
