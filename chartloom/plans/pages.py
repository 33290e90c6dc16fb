"""Queries of the page operators and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import text as fx
from chartloom.operators import pages as op
from chartloom.session import once, table

LATEST = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY loaded_at DESC NULLS LAST, coalesce(clean_text, '') DESC) AS rn
  FROM page_content WHERE document_id IS NOT NULL AND page_number IS NOT NULL) WHERE rn = 1)"""
MASK = "lower(trim(regexp_replace(regexp_replace({0}, '\\d+', '#', 'g'), '\\s+', ' ', 'g'), ' '))"
LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
REPEATED = rf"""{LATEST},
own AS (SELECT document_id, page_number, text, {LINES} AS l FROM latest),
edge AS (SELECT document_id, unnest(list_concat(l[1:6], l[greatest(1, len(l) - 3):len(l)])) AS x FROM own),
counted AS (SELECT document_id, {MASK.format("x")} AS line, count(*) AS copies FROM edge GROUP BY 1, 2),
sizes AS (SELECT document_id, count(*) AS pages FROM own GROUP BY 1),
repeated AS (SELECT document_id, line, copies FROM counted JOIN sizes USING (document_id) WHERE copies / pages >= 0.2)"""
ALWAYS = " OR ".join(f"regexp_matches(lower(trim({{0}})), '{p}')" for p in op.ALWAYS_FURNITURE)


def a01_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability of each chart."""
    out = op.validation_report(table(spark, sf_dir, "page_content"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("document_id", "page_count", "pages_with_text", join("ocr_pages"), join("unreadable_pages"), "characters")


A01 = rf"""WITH {LATEST}, f AS (SELECT *, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) < 40 AS poor FROM latest)
SELECT document_id, count(*) AS page_count, count(*) FILTER (NOT poor) AS pages_with_text,
 coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (poor), '') AS ocr_pages,
 coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (text IS NULL), '') AS unreadable_pages,
 coalesce(sum(length(text)), 0)::BIGINT AS characters FROM f GROUP BY 1"""


def b02_repeated_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked lines that run through a chart's page edges."""
    return op.repeated_edge_lines(table(spark, sf_dir, "page_content"))


B02 = f"WITH {REPEATED} SELECT * FROM repeated"


def b04_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages without furniture."""
    return op.clean_pages(table(spark, sf_dir, "page_content"))


B04 = rf"""WITH {REPEATED},
r AS (SELECT document_id, list(line) AS ls FROM repeated GROUP BY 1),
kept AS (SELECT own.document_id, page_number, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) = '' OR NOT (({ALWAYS.replace("{0}", "x")}) OR coalesce(list_contains(ls, {MASK.format("x")}), false))) AS k
  FROM own LEFT JOIN r USING (document_id))
SELECT document_id, page_number, trim(regexp_replace(array_to_string(list_transform(k, lambda x: rtrim(x, ' ')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS cleaned FROM kept"""


def b05_block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and footer blocks."""
    return op.block_kinds(table(spark, sf_dir, "text_blocks"), table(spark, sf_dir, "page_content"))


B05 = rf"""WITH {REPEATED},
b AS (SELECT document_id, page_number, block_id, bbox, trim(string_split(text, chr(10))[1]) AS first FROM text_blocks WHERE text IS NOT NULL)
SELECT DISTINCT b.document_id, b.page_number, b.block_id, CASE WHEN b.bbox[2] < l.height * 0.15 THEN 'header' ELSE 'footer' END AS kind
FROM b LEFT JOIN repeated r ON r.document_id = b.document_id AND r.line = {MASK.format("b.first")}
LEFT JOIN latest l ON l.document_id = b.document_id AND l.page_number = b.page_number
WHERE b.first <> '' AND (r.line IS NOT NULL OR {ALWAYS.replace("{0}", "b.first")})"""


def a04_block_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each chart by type."""
    return op.block_profile(table(spark, sf_dir, "text_blocks"))


A04 = """SELECT document_id, coalesce(block_type, 'unknown') AS block_type, count(*) AS blocks, round(avg(font_size), 6) AS mean_font_size,
 count(*) FILTER (is_bold) AS bold_blocks, coalesce(sum(len(string_split(text, chr(10)))), 0)::BIGINT AS lines FROM text_blocks GROUP BY 1, 2"""

NORM = "regexp_replace(lower({0}), '[—–]', '-', 'g')"
for _p, _r in fx.REWRITES:
    NORM = f"regexp_replace({NORM}, '{_p}', '{_r.replace('$1', chr(92) + '1')}', 'g')"
NORM = f"trim({NORM}, ' ')"


def b08_normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised document texts, as length and digest."""
    docs = once(table(spark, sf_dir, "documents").select("doc_id", "text"), norm=fx.normalize_text(F.col("text")))
    return docs.select("doc_id", F.length("norm").alias("characters"), F.md5("norm").alias("digest"))


B08 = f"SELECT doc_id, length({NORM.format('text')})::INTEGER AS characters, md5({NORM.format('text')}) AS digest FROM documents"


def b09_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that gain synonyms, with what they gain."""
    docs = once(table(spark, sf_dir, "documents").select("doc_id", "text"), norm=fx.normalize_text(F.col("text")))
    docs = once(docs.select("doc_id", "norm"), more=fx.with_synonyms(F.col("norm")))
    return docs.where("more <> norm").select("doc_id", F.substring("more", F.length("norm") + 2, F.length("more")).alias("gained"))


def _b09() -> str:
    cases = ", ".join(
        f"CASE WHEN regexp_matches(n, '\\b{t}\\b') THEN [{', '.join(repr(a) for a in names)}] ELSE [] END" for t, names in fx.SYNONYMS.items()
    )
    return f"""WITH d AS (SELECT doc_id, {NORM.format('text')} AS n FROM documents),
g AS (SELECT doc_id, array_to_string(list_sort(list_distinct(flatten([{cases}]))), ' ') AS gained FROM d)
SELECT doc_id, gained FROM g WHERE gained <> ''"""


def b13_written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in page texts."""
    pages = op.latest_pages(table(spark, sf_dir, "page_content"))
    return pages.select("document_id", "page_number", F.array_join(fx.written_dates(F.col("text")), ",").alias("dates")).where("dates <> ''")


_M = "(?:" + "|".join(fx.MONTH_NAMES) + ")"


def written_dates_sql(c: str) -> str:
    """A sorted list of the dates written in a text."""
    return rf"""list_sort(list_distinct(list_filter(list_concat(
  list_transform(regexp_extract_all({c}, '(?i)\b({_M}\s+\d{{1,2}},\s+\d{{4}})\b', 1), lambda d: strftime(try_strptime(regexp_replace(d, '\s+', ' ', 'g'), '%B %d, %Y'), '%Y-%m-%d')),
  regexp_extract_all({c}, '\b((?:19|2[0-7])\d{{2}}-\d{{2}}-\d{{2}})\b', 1),
  list_transform(regexp_extract_all({c}, '(?i)\b({_M}\s+(?:19|2[0-7])\d{{2}})\b', 1), lambda d: strftime(try_strptime('1 ' || regexp_replace(d, '\s+', ' ', 'g'), '%d %B %Y'), '%Y-%m'))), lambda x: x IS NOT NULL)))"""


B13 = f"""WITH {LATEST}, found AS (SELECT document_id, page_number, {written_dates_sql('text')} AS l FROM latest)
SELECT document_id, page_number, array_to_string(l, ',') AS dates FROM found WHERE len(l) > 0"""


def a23_ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over all charts."""
    return op.ingest_summary(*(table(spark, sf_dir, t) for t in ("page_content", "text_blocks", "chunks", "encounters")))


A23 = rf"""WITH {LATEST} SELECT (SELECT count(DISTINCT document_id) FROM latest) AS charts, (SELECT count(*) FROM latest) AS pages, (SELECT count(*) FROM latest WHERE length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) < 40) AS ocr_needed,
 (SELECT count(*) FROM (SELECT DISTINCT document_id, encounter_id FROM encounters WHERE document_id IS NOT NULL AND encounter_id IS NOT NULL)) AS encounters, (SELECT count(*) FROM chunks) AS chunks,
 (SELECT count(*) FROM chunks WHERE chunk_type = 'section') AS sections, (SELECT count(*) FROM text_blocks) AS blocks, (SELECT count(*) FROM text_blocks WHERE len(bbox) >= 4) AS blocks_with_box"""


def b18_safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of the jobs' source files."""
    return table(spark, sf_dir, "ingest_jobs").select("job_id", fx.safe_id(F.col("source_pdf")).alias("safe_id")).distinct()


B18 = r"""SELECT DISTINCT job_id, CASE WHEN s = '' THEN 'upload' ELSE s END AS safe_id FROM (SELECT job_id,
 left(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(source_pdf, ''), '^.*/', ''), '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9._-]+', '-', 'g'), '-._'), 80) AS s FROM ingest_jobs)"""

QUERIES = {
    f.__name__: f
    for f in (a01_validation_report, a04_block_profile, a23_ingest_summary, b02_repeated_edge_lines, b04_clean_pages, b05_block_kinds, b08_normalized_texts, b09_synonyms, b13_written_dates, b18_safe_ids)
}
SQL = {
    "a01_validation_report": A01, "a04_block_profile": A04, "a23_ingest_summary": A23, "b02_repeated_edge_lines": B02, "b04_clean_pages": B04, "b05_block_kinds": B05,
    "b08_normalized_texts": B08, "b09_synonyms": _b09(), "b13_written_dates": B13, "b18_safe_ids": B18,
}
