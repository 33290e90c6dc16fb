"""Encounters found in page texts: numbered headers, dated visits and notes, and the choice between the two by a registry of parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import MONTH_NAMES, written_dates
from chartloom.operators.order import ordinals
from chartloom.operators.pages import latest_pages

# How charts write the header of an encounter, its date, provider and facility.
HEADER = r"(?i)Encounter\s+#(\d+)\s*\|\s*(ENC-\d+)\s*\|?"
DATE = r"((?:" + "|".join(MONTH_NAMES) + r")\s+\d{1,2},\s+\d{4})"
TYPE_AND_DATE = rf"(?is)^\s*(?:00:00\s+)?([^|]+?)\s*\|?\s*{DATE}"
PROVIDER = r"(?i)Provider:\s*(Dr\.\s*[^—\n]+?)(?:\s*—|\s*NPI:|\s*\n|\s*$)"
FACILITY_WORDS = "Clinic|Hospital|Medical Center|Health Center|Care Center|Health"
# How charts without numbered headers begin a visit; a page's first pattern that fits counts.
VISIT_DATE = r"(?i)(?:Visit Date|Date of Service|DOS)\s*[:\-]\s*([^\n]{6,40})"
VISIT_HEAD = r"(?i)\b(?:Encounter|Office Visit|Progress Note)\b\s*(?:#?\d+\s*)?(?:\|\s*)?(ENC-?\d+|[A-Z]{2,}-\d+)?"
VISIT_TYPE = (
    r"(?i)\b(Annual Physical|Follow-?Up Visit|Office Visit|Telehealth|Urgent Care|Progress Note|Ambulatory Visit)\b.{0,60}?"
    r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})"
)
NOTE = r"(?i)(?:Progress Note|Office Visit|Clinical Note)"
SIGNER = r"(?:Dr\.\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+,\s*(?:MD|DO|NP|PA|RN|APRN)\b"
#: Lines and characters after a header in which type, date, provider and facility are looked for, and what no facility line holds.
HEAD_LINES, HEAD_CHARACTERS, FACILITY_LINES = 6, 500, 12
NO_FACILITY = r"\|$|^Encounter|^Provider|NPI|Follow-Up"


def iso_date(written: Column) -> Column:
    """``February 20, 2024`` as ``2024-02-20``; null for no date."""
    return F.date_format(F.try_to_date(F.regexp_replace(written, r"\s+", " "), "MMMM d, yyyy"), "yyyy-MM-dd")


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _runs(found: DataFrame) -> DataFrame:
    """The first of consecutive rows with the same encounter, in page order; an id that comes back later begins anew."""
    rows = ordinals(found, ["document_id"], ["page_number", "pos"])
    before = rows.select("document_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("encounter_id").alias("before"))
    return rows.join(before, ["document_id", "ordinal"], "left").where(~F.col("encounter_id").eqNullSafe(F.col("before"))).drop("before", "ordinal")


def numbered(pages: DataFrame) -> DataFrame:
    """Encounters from headers such as ``Encounter #3 | ENC-464119 |``, one row per run of headers of the same id.

    Columns: document_id, encounter_id, encounter_number, encounter_type, encounter_date (ISO), provider, facility,
    start_page. Type and date are looked for in the lines after the header, provider and facility in its neighbourhood.
    """
    parts = latest_pages(pages).select("document_id", "page_number", F.posexplode(F.split("clean_text", rf"(?={HEADER})")).alias("pos", "part")).where(F.col("part").rlike("^" + HEADER))
    after = F.regexp_replace("part", "^" + HEADER, "")
    lines = F.slice(F.filter(F.split(after, "\n"), lambda x: (F.trim(x) != "") & (F.trim(x) != "00:00")), 1, HEAD_LINES)
    before_provider = F.regexp_replace(F.array_join(lines, "\n"), r"(?is)Provider:.*$", "")
    window = F.left(after, F.lit(HEAD_CHARACTERS))
    facility = F.get(
        F.filter(
            F.transform(F.slice(F.split(window, "\n"), 1, FACILITY_LINES), lambda x: F.trim(x)),
            lambda x: x.rlike(FACILITY_WORDS) & ~x.rlike(NO_FACILITY),
        ),
        F.lit(0),
    )
    found = parts.select(
        "document_id", "page_number", "pos",
        F.upper(F.regexp_extract("part", HEADER, 2)).alias("encounter_id"), F.regexp_extract("part", HEADER, 1).try_cast("int").alias("encounter_number"),
        _filled(F.regexp_extract(before_provider, TYPE_AND_DATE, 1)).alias("encounter_type"), iso_date(F.regexp_extract(before_provider, TYPE_AND_DATE, 2)).alias("encounter_date"),
        _filled(F.regexp_extract(window, PROVIDER, 1)).alias("provider"), facility.alias("facility"),
    )
    return _runs(found).drop("pos").withColumnRenamed("page_number", "start_page")


def generic(pages: DataFrame) -> DataFrame:
    """Encounters of charts without numbered headers: visit dates, heads of notes, types with a date, signed notes.

    Ids are those written, else ``VISIT-<date>`` or ``GEN-P<page>``; a chart without any visit is one encounter, GEN-DOC.
    """
    own = latest_pages(pages).select("document_id", "page_number", "clean_text")
    text = F.col("clean_text")
    visit, head, typed = (text.rlike(p) for p in (VISIT_DATE, VISIT_HEAD, VISIT_TYPE))
    signer = _filled(F.regexp_extract("clean_text", SIGNER, 0))
    note = signer.isNotNull() & text.rlike(NOTE)
    written = F.when(visit, F.regexp_extract("clean_text", VISIT_DATE, 1)).when(~head & typed, F.regexp_extract("clean_text", VISIT_TYPE, 2))
    day = F.get(written_dates(written), F.lit(0))
    given = F.when(~visit & head, _filled(F.regexp_extract("clean_text", VISIT_HEAD, 1)))
    given = F.regexp_replace(given, "^ENC(?!-)", "ENC-")
    kind = F.when(visit | head, "Clinical Visit").when(typed, F.regexp_extract("clean_text", VISIT_TYPE, 1)).otherwise("Progress Note")
    found = own.where(visit | head | typed | note).select(
        "document_id", "page_number", F.lit(0).alias("pos"), F.coalesce(given, F.concat(F.lit("VISIT-"), day), F.concat(F.lit("GEN-P"), F.col("page_number"))).alias("encounter_id"),
        kind.alias("encounter_type"), day.alias("encounter_date"), signer.alias("provider"),
    )
    starts = ordinals(_runs(found), ["document_id"], ["page_number", "pos"])
    whole = own.groupBy("document_id").agg(F.min("page_number").alias("start_page")).join(starts.select("document_id").distinct(), "document_id", "left_anti")
    none = F.lit(None).cast("string")
    whole = whole.select("document_id", F.lit("GEN-DOC").alias("encounter_id"), F.lit(1).alias("encounter_number"), F.lit("Document").alias("encounter_type"), none.alias("encounter_date"), none.alias("provider"), none.alias("facility"), "start_page")
    return starts.select("document_id", "encounter_id", F.col("ordinal").cast("int").alias("encounter_number"), "encounter_type", "encounter_date", "provider", none.alias("facility"), F.col("page_number").alias("start_page")).unionByName(whole)


def with_ends(encounters: DataFrame, pages: DataFrame, overlap: bool | Column = True) -> DataFrame:
    """Add ``end_page``: the page where the chart's next encounter starts (or, without ``overlap``, the one before), the last page for the last."""
    shared = overlap if isinstance(overlap, Column) else F.lit(overlap)
    rows = ordinals(encounters, ["document_id"], ["start_page", "encounter_number", "encounter_id"])
    following = rows.select("document_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("start_page").alias("next_start"))
    last = pages.where("document_id is not null").groupBy("document_id").agg(F.max("page_number").alias("last_page"))
    end = F.coalesce(F.when(shared, F.col("next_start")).otherwise(F.col("next_start") - 1), F.col("last_page"), F.col("start_page"))
    joined = rows.join(following, ["document_id", "ordinal"], "left").join(last, "document_id", "left")
    return joined.withColumn("end_page", F.greatest("start_page", end)).drop("ordinal", "next_start", "last_page")


def soap(pages: DataFrame) -> DataFrame:
    """Encounters by numbered headers with their ends; the page of the next header still belongs to the one before."""
    return with_ends(numbered(pages), pages).withColumn("parser", F.lit("synthetic_soap"))


def plain(pages: DataFrame) -> DataFrame:
    """Encounters by visit dates and notes with their ends, a page before the next."""
    return with_ends(generic(pages), pages, overlap=False).withColumn("parser", F.lit("generic"))


def detected(pages: DataFrame) -> DataFrame:
    """Encounters of each chart by its numbered headers, or by visit dates and notes where it has none."""
    by_number = soap(pages)
    return by_number.unionByName(plain(pages).join(by_number.select("document_id").distinct(), "document_id", "left_anti"))


#: Parsers by name: a table of pages -> encounters with ``end_page`` and the parser's name.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"synthetic_soap": soap, "generic": plain, "auto": detected}


def register_parser(name: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    PARSERS[name.strip().lower()] = parser


def get_parser(name: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A parser by name, without regard to case; the one for numbered headers by default."""
    key = (name or "synthetic_soap").strip().lower()
    if key not in PARSERS:
        raise ValueError(f"unknown structure parser '{name}', there are: {', '.join(sorted(PARSERS))}")
    return PARSERS[key]
