"""Queries of the chunk operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import chunking as op
from chartloom.operators.facts import section_facts
from chartloom.operators import facts as fc
from chartloom.operators.structure import HEADINGS
from chartloom.plans.pages import LATEST
from chartloom.plans.structure import ENC
from chartloom.session import table

_PLAIN = r"regexp_replace(lower(trim(c.section, ' ')), '\s+', ' ', 'g')"
KEY = f"CASE {_PLAIN} " + " ".join(f"WHEN '{h}' THEN '{k}'" for k, h in HEADINGS) + f" ELSE replace({_PLAIN}, ' ', '_') END"
TEXTS = rf"""{LATEST}, texts AS (SELECT c.chunk_id, c.document_id, c.encounter_id, c.section, c.page_start, c.page_end, {KEY} AS key,
  string_agg(p.clean_text, chr(10) ORDER BY p.page_number) AS text
  FROM chunks c JOIN latest p ON p.document_id = c.document_id AND p.page_number BETWEEN c.page_start AND c.page_end AND p.clean_text <> ''
  WHERE c.chunk_type = 'section' GROUP BY ALL)"""
LONGEST = f"""{TEXTS}, longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, encounter_id, key ORDER BY length(text) DESC, chunk_id) AS rn
  FROM texts WHERE key IS NOT NULL AND encounter_id IS NOT NULL) WHERE rn = 1)"""


def _clip(c: str, n: int) -> str:
    t = f"trim({c}, ' ')"
    return f"CASE WHEN length({t}) > {n} THEN left({t}, {n}) || '…' ELSE {t} END"


def _compound(parts: dict[str, int], least: int, most: int, needed: str = "true") -> str:
    told = "CASE key " + " ".join(f"WHEN '{k}' THEN {_clip('text', n)}" for k, n in parts.items()) + " END"
    order = "CASE key " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(parts)) + " END"
    keys = ", ".join(f"'{k}'" for k in parts)
    nl = "chr(10) || chr(10)"
    return f"""WITH {LONGEST}, {ENC}, g AS (SELECT document_id, encounter_id, count(*) AS parts, min(page_start) AS page_start, max(page_end) AS page_end,
   string_agg('[' || coalesce(section, key) || ']' || chr(10) || {told}, {nl} ORDER BY {order}) AS body, list(key) AS keys FROM longest WHERE key IN ({keys}) GROUP BY 1, 2 HAVING count(*) >= {least})
SELECT g.document_id, g.encounter_id, parts, g.page_start, g.page_end, md5(left('Encounter ' || g.encounter_id || {nl} || 'Type: ' || coalesce(e.encounter_type, 'Unknown') || {nl} || 'Date: ' || coalesce(e.encounter_date, 'Unknown')
   || {nl} || 'Provider: ' || coalesce(e.provider, 'Unknown') || {nl} || body, {most})) AS digest FROM g LEFT JOIN enc e USING (document_id, encounter_id) WHERE {needed}"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.section_texts(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "page_content"))


def d01_document_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in overlapping pieces of fixed size."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(op.pieces(F.col("text"))).alias("piece_no", "piece"))


#: The same cuts as a recursive query: the last line end or sentence end of a window of 1,200 if it lies beyond 480.
D01 = r"""WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS start, 0 AS n, ''::VARCHAR AS piece, false AS done FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
 UNION ALL SELECT doc_id, text, greatest(0, e - 120), n + 1, regexp_replace(substr(text, start + 1, e - start), '^\s+|\s+$', '', 'g'), e >= length(text)
 FROM (SELECT *, CASE WHEN length(text) - start > 1200 AND c > 480 THEN start + c + 1 ELSE least(length(text), start + 1200) END AS e
  FROM (SELECT *, greatest(CASE WHEN contains(win, chr(10)) THEN 1200 - instr(reverse(win), chr(10)) ELSE -1 END, CASE WHEN contains(win, '. ') THEN 1200 - instr(reverse(win), ' .') - 1 ELSE -1 END) AS c
   FROM (SELECT *, substr(text, start + 1, 1200) AS win FROM w WHERE NOT done)))),
k AS (SELECT doc_id, n, piece FROM w WHERE n > 0 AND piece <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INTEGER AS piece_no, piece FROM k"""


def d05_longest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest section of each kind in an encounter."""
    return op.longest_sections(_texts(spark, sf_dir)).withColumn("characters", F.length("text")).drop("text", "section")


D05 = f"WITH {LONGEST} SELECT document_id, encounter_id, key, chunk_id, page_start, page_end, length(text)::INTEGER AS characters FROM longest"


def _encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "encounters")


def d07_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laboratory results, assessment and plan of an encounter in one text."""
    return op.compounds(_texts(spark, sf_dir), op.LAB_COMPOUND, 2, about=_encounters(spark, sf_dir)).withColumn("digest", F.md5("text")).drop("text")


def d08_imaging_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imaging orders with follow-up or plan of an encounter in one text."""
    return op.compounds(_texts(spark, sf_dir), op.IMAGING_COMPOUND, 2, [["imaging_orders"], ["follow_up", "plan"]], _encounters(spark, sf_dir)).withColumn("digest", F.md5("text")).drop("text")


def d09_order_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan and laboratory orders of an encounter in one text."""
    return op.compounds(_texts(spark, sf_dir), op.ORDER_COMPOUND, 2, about=_encounters(spark, sf_dir)).withColumn("digest", F.md5("text")).drop("text")


def d10_key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key facts of each encounter."""
    return op.key_facts(_texts(spark, sf_dir), _encounters(spark, sf_dir)).withColumn("digest", F.md5("text")).drop("text")


def d15_chunk_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks built from sections, pages and encounters: numbers, links and digests of their texts."""
    built = op.build_chunks(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "page_content"), _encounters(spark, sf_dir))
    return built.select("chunk_id", "document_id", "encounter_id", "chunk_type", "table_type", "section", "page_start", "page_end", "previous_id", "next_id", F.md5("raw_text").alias("digest"), F.length("retrieval_text").alias("characters"))


def c28_section_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atomic facts of all sections: diagnoses, plans, referrals, orders, results, signatures, vital signs, history."""
    facts = section_facts(_texts(spark, sf_dir))
    return facts.select("chunk_id", "key", "table_type", "search_text", F.md5("raw_text").alias("digest"))


def _facts_sql() -> str:
    keys = lambda names: ", ".join(f"'{k}'" for k in names)
    own = f"SELECT *, (encounter_id IS NOT NULL AND key IN ({keys(fc.HISTORY_KEYS)})) AS hidden FROM texts"
    group = lambda i, names: f"regexp_extract(m, {names}, {i})"
    diagnosis, relative, inline = (f"'{p}'" for p in (fc.DIAGNOSIS, fc.RELATIVE, fc.INLINE_SPECIALTY))
    sign = f"'{fc.SIGNATURE}'"
    study = r"'(?is)(Renal Ultrasound(?:\s+with\s+Doppler)?|Chest X-ray(?:\s*\(CXR\))?|Electrocardiogram(?:\s*\(ECG\))?)'"
    return rf"""WITH {TEXTS}, s AS (SELECT * FROM ({own}) WHERE NOT hidden),
l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM s),
pairs AS (SELECT chunk_id, key, unnest(ls) AS a, unnest(list_concat(ls[2:], [NULL])) AS b FROM l),
dx AS (SELECT chunk_id, key, m, i FROM (SELECT chunk_id, key, unnest(regexp_extract_all(text, {diagnosis})) AS m, unnest(range(len(regexp_extract_all(text, {diagnosis})))) AS i FROM s WHERE key = 'assessment')),
dt AS (SELECT chunk_id, key, i, {group(1, diagnosis)} || ' — ' || {group(2, diagnosis)} AS t FROM dx),
bl AS (SELECT chunk_id, key, trim(unnest(regexp_extract_all(text, '{fc.BULLET}', 1)), ' ') AS b FROM s WHERE key = 'plan'),
sg AS (SELECT chunk_id, key, 'Electronically signed by: ' || regexp_extract(text, {sign}, 1) || ' Date: ' || regexp_extract(text, {sign}, 2) AS t FROM s WHERE key IN ({keys(fc.SIGNED_KEYS)}) AND regexp_extract(text, {sign}, 1) <> ''),
vt AS (SELECT chunk_id, key, concat_ws('; ', 'BP ' || nullif(replace(regexp_extract(text, '{fc.PRESSURE}', 1), ' ', ''), '') || ' mmHg', 'Weight ' || nullif(regexp_extract(text, '{fc.POUNDS}', 1), '') || ' lbs') AS t FROM s WHERE key IN ({keys(fc.VITAL_KEYS)})),
ip AS (SELECT chunk_id, key, string_split(regexp_replace(text, {study}, chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM s WHERE key = 'imaging_orders'),
iu AS (SELECT chunk_id, key, parts, unnest(range(1, len(parts) // 2 + 1)) AS i FROM ip),
im AS (SELECT chunk_id, key, parts[2 * i] || ' — ' || trim(replace(left(array_to_string(parts[2 * i + 1:], ''), 220), chr(10), ' '), ' ') AS t FROM iu),
f AS (SELECT chunk_id, key, 'diagnoses' AS table_type, 'Assessment / Diagnoses | ' || t AS search_text, t AS raw FROM dt
 UNION ALL SELECT chunk_id, key, 'diagnoses_set', 'Assessment / Diagnoses | ' || string_agg(t, '; ' ORDER BY i), string_agg(t, chr(10) ORDER BY i) FROM dt GROUP BY 1, 2 HAVING count(*) >= 2
 UNION ALL SELECT chunk_id, key, 'plan_item', 'Plan | ' || b, '• ' || b FROM bl
 UNION ALL SELECT chunk_id, key, 'plan_block', 'Plan | ' || left(text, {fc.PLAN_SEARCHED}), text FROM s WHERE key = 'plan' AND length(text) < {fc.PLAN_BLOCK} AND text <> '' AND chunk_id NOT IN (SELECT chunk_id FROM bl)
 UNION ALL SELECT chunk_id, key, 'laboratory_results', 'Laboratory Results | ' || a || ' | Value ' || b, a || ': ' || b FROM pairs WHERE key IN ({keys(fc.LAB_KEYS)}) AND regexp_matches(a, '{fc.LAB_TEST}') AND regexp_matches(b, '^\d')
 UNION ALL SELECT chunk_id, key, 'referrals', 'Referrals | ' || a || ' — ' || coalesce(b, ''), a || ' — ' || coalesce(b, '') FROM pairs WHERE key = 'referrals' AND regexp_matches(a, '{fc.STACKED_SPECIALTY}') AND lower(coalesce(b, '')) NOT IN ('specialty', 'reason')
 UNION ALL SELECT chunk_id, key, 'referrals', 'Referrals | ' || x || ' — ' || y, x || ' — ' || y FROM (SELECT chunk_id, key, {group(1, inline)} AS x, trim({group(2, inline)}, ' ') AS y FROM (SELECT chunk_id, key, unnest(regexp_extract_all(text, {inline})) AS m FROM s WHERE key = 'referrals')) WHERE y <> ''
 UNION ALL SELECT chunk_id, key, 'imaging_orders', 'Imaging Orders | ' || t, t FROM im UNION ALL SELECT chunk_id, key, 'signature', t, t FROM sg UNION ALL SELECT chunk_id, key, 'vitals', 'Vitals | ' || t, t FROM vt WHERE t <> ''
 UNION ALL SELECT chunk_id, key, 'family_history', t, t FROM (SELECT chunk_id, key, 'Family History — ' || {group(1, relative)} || ': ' || trim({group(2, relative)}, ' ') AS t FROM (SELECT chunk_id, key, unnest(regexp_extract_all(text, {relative})) AS m FROM s WHERE key IN ({keys(fc.HISTORY_KEYS)})))
 UNION ALL SELECT chunk_id, key, 'demographics', a || ': ' || b, a || ': ' || b FROM pairs WHERE key IN ({keys(fc.HISTORY_KEYS)}) AND a IN ({keys(fc.LABELS)}) AND b IS NOT NULL)
SELECT chunk_id, key, table_type, search_text, md5(raw) AS digest FROM f"""


def d11_uncovered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without an atomic fact."""
    facts = table(spark, sf_dir, "chunks").where("chunk_type = 'atomic_fact'")
    return op.uncovered_pages(facts, table(spark, sf_dir, "page_content"))


D11 = f"""WITH {LATEST} SELECT p.document_id, p.page_number, length(p.clean_text)::INTEGER AS characters FROM latest p WHERE length(p.clean_text) >= 80
 AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_type = 'atomic_fact' AND c.document_id = p.document_id AND p.page_number BETWEEN c.page_start AND c.page_end)"""


def d13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks before and after each chunk."""
    return op.neighbours(table(spark, sf_dir, "chunks"))


D13 = """SELECT chunk_id, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM chunks WHERE document_id IS NOT NULL
 WINDOW w AS (PARTITION BY document_id ORDER BY coalesce(try_cast(regexp_extract(chunk_id, '([0-9]+)$', 1) AS BIGINT), 0), chunk_id)"""


def d14_unique_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section chunks without repetitions."""
    return op.unique_chunks(_texts(spark, sf_dir))


D14 = f"WITH {TEXTS} SELECT min(chunk_id) AS chunk_id, document_id, page_start, count(*) AS copies FROM texts GROUP BY document_id, page_start, left(text, 500)"


def d16_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context lines of all chunks."""
    return op.headers(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "encounters"))


D16 = f"""WITH {ENC} SELECT c.chunk_id, concat_ws(chr(10), 'Encounter: ' || c.encounter_id, 'Type: ' || e.encounter_type,
 'Date: ' || CASE WHEN regexp_full_match(e.encounter_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime(e.encounter_date, '%Y-%m-%d') IS NOT NULL
   THEN strftime(try_strptime(e.encounter_date, '%Y-%m-%d'), '%B %-d, %Y') ELSE coalesce(e.encounter_date, 'Unknown') END,
 'Provider: ' || coalesce(c.provider, e.provider), 'Facility: ' || e.facility, 'Section: ' || c.section,
 CASE WHEN c.page_start = c.page_end THEN 'Page: ' || c.page_start ELSE 'Pages: ' || c.page_start || '-' || c.page_end END) AS header
 FROM chunks c LEFT JOIN enc e ON e.document_id = c.document_id AND e.encounter_id = c.encounter_id"""


def d18_chunk_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes in which each section stands on its pages."""
    return op.chunk_boxes(_texts(spark, sf_dir), table(spark, sf_dir, "text_blocks"), table(spark, sf_dir, "page_content"))


D18 = rf"""WITH {TEXTS}, n0 AS (SELECT chunk_id, document_id, page_start, page_end, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(trim(x, ' ' || chr(9) || chr(13) || chr(10)))), lambda x: length(x) >= 12)[1:12] AS l,
   trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS whole FROM texts),
n AS (SELECT *, CASE WHEN len(l) > 0 THEN l WHEN whole <> '' THEN [lower(left(whole, 80))] ELSE [] END AS needles FROM n0),
b AS (SELECT document_id, page_number, reading_order, lower(text) AS low, array_to_string(list_transform(bbox[1:4], lambda x: printf('%.1f', x)), ',') AS box FROM text_blocks WHERE text <> '' AND len(bbox) >= 4),
h AS (SELECT n.chunk_id, b.page_number, b.box, b.reading_order, list_position(list_transform(needles, lambda x: contains(low, x) OR contains(x, low) OR (length(x) > 20 AND contains(low, left(x, 40)))), true) AS needle
   FROM n JOIN b ON b.document_id = n.document_id AND b.page_number BETWEEN n.page_start AND n.page_end),
d AS (SELECT chunk_id, page_number, box, min((needle, page_number, reading_order)) AS o FROM h WHERE needle > 0 GROUP BY 1, 2, 3),
found AS (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY o, box)::INTEGER AS box_no, page_number, box FROM d QUALIFY box_no <= 8),
missed AS (SELECT * FROM n WHERE chunk_id NOT IN (SELECT chunk_id FROM found)),
largest AS (SELECT m.chunk_id, row_number() OVER (PARTITION BY m.chunk_id ORDER BY length(b.low) DESC, b.reading_order, b.box)::INTEGER AS box_no, b.page_number, b.box FROM missed m JOIN b ON b.document_id = m.document_id AND b.page_number = m.page_start QUALIFY box_no <= 3)
SELECT * FROM found UNION ALL SELECT * FROM largest
UNION ALL SELECT m.chunk_id, 1, l.page_number, '0.0,0.0,' || printf('%.1f', coalesce(l.width, 0)) || ',' || printf('%.1f', coalesce(l.height, 0)) FROM missed m JOIN latest l ON l.document_id = m.document_id AND l.page_number = m.page_start
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.document_id = m.document_id AND b.page_number = m.page_start)"""

QUERIES = {
    f.__name__: f
    for f in (
        c28_section_facts, d01_document_pieces, d05_longest_sections, d07_compounds, d08_imaging_compounds, d09_order_compounds, d10_key_facts,
        d11_uncovered_pages, d13_neighbours, d14_unique_chunks, d15_chunk_build, d16_headers, d18_chunk_boxes,
    )
}
SQL = {
    "c28_section_facts": _facts_sql(), "d01_document_pieces": D01, "d05_longest_sections": D05, "d07_compounds": _compound(op.LAB_COMPOUND, 2, 10_000),
    "d08_imaging_compounds": _compound(op.IMAGING_COMPOUND, 2, 10_000, "list_contains(keys, 'imaging_orders') AND list_has_any(keys, ['follow_up', 'plan'])"),
    "d09_order_compounds": _compound(op.ORDER_COMPOUND, 2, 10_000), "d10_key_facts": _compound(dict(op.KEY_FACTS), 1, op.SUMMARY),
    "d11_uncovered_pages": D11, "d13_neighbours": D13, "d14_unique_chunks": D14, "d16_headers": D16, "d18_chunk_boxes": D18,
}
