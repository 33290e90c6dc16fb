"""Queries of search, fusion, ranking, evaluation and answers.

The query set is every medication posting whose id is divisible by 20, asked in six phrasings; the searched texts are
all sections of all charts. For vectors it is every vector whose id is divisible by 20.
"""

from __future__ import annotations

from copy import copy
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.engine import CHANNELS, Engine
from chartloom.functions.text import SYNONYMS, TOKEN
from chartloom.operators import answers, evaluation, planning, ranking, search, vector_index
from chartloom.operators.ranking import ANY_CODE, FOLLOW_WORDS, HISTORY_SECTIONS, HISTORY_WORDS, LAB_NAMES, MEDICATION_WORDS
from chartloom.operators.structure import ICD, ROW, SIGNED
from chartloom.plans.chunks import TEXTS
from chartloom.plans.pages import NORM, written_dates_sql
from chartloom.plans.structure import ENC
from chartloom.session import broadcast_if_small, cut, spread_join, table


def TOK(c: str) -> str:
    return f"regexp_extract_all({NORM.format(c)}, '{TOKEN}')"


class Inputs:
    """One retrieval run of the query set over the stored index."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.engine = Engine(spark, sf_dir)
        self.items = self.engine.items
        chunks, medications = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "medications")
        drug = F.lower(F.trim("medication"))
        asked = medications.where((F.col("id") % 20 == 0) & (drug != "")).join(chunks.select("chunk_id", "section", F.col("provider").alias("who")), "chunk_id", "left")
        words = lambda *parts: F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else p for p in parts))
        section, date, kind = F.col("section"), F.col("encounter_date"), F.pmod(F.floor(F.col("id") / 20), F.lit(6))
        text = (
            F.when(kind == 0, words("why", drug, section)).when(kind == 1, words("which dose of", drug, "was started after the lab value on", date))
            .when(kind == 2, words("who signed the note about", drug)).when(kind == 3, words(drug, "taking since", date))
            .when(kind == 4, words("date of birth and allergies with", drug)).otherwise(words("icd code in", section, "for", drug, F.col("who")))
        )
        self.queries = asked.select(F.col("id").alias("query_id"), text.alias("text"), "document_id", F.col("page_start").alias("page"))
        self._plans: DataFrame | None = None
        self._hits: dict[str, DataFrame] = {}
        self._fused: dict[tuple[str, ...], DataFrame] = {}
        self._features: DataFrame | None = None
        self._distinct: Inputs | None = None

    @property
    def distinct(self) -> Inputs:
        """The run of the distinct texts: queries with the same text have the same plan and results, which are found once."""
        if self._distinct is None:
            run = copy(self)
            run._plans, run._hits, run._fused = None, {}, {}
            run.queries = cut(self.queries.select("text").distinct().withColumn("query_id", F.monotonically_increasing_id()).select("query_id", "text"))
            self._distinct = run
        return self._distinct

    def every(self, rows: DataFrame) -> DataFrame:
        """Rows (query_id, ...) of the run of distinct texts, given to all queries with the text."""
        lists = rows.groupBy(F.col("query_id").alias("_text")).agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "query_id"))).alias("_rows"))
        members = spread_join(self.queries.select("query_id", "text"), self.distinct.queries.withColumnRenamed("query_id", "_text"), ["text"], F.col("query_id"))
        return spread_join(members, lists, ["_text"], F.col("query_id")).select("query_id", F.inline("_rows"))

    @property
    def plans(self) -> DataFrame:
        if self._plans is None:
            self._plans = self.engine.plan(self.queries)
        return self._plans

    def hits(self, channel: str) -> DataFrame:
        """A channel's hits, computed once in a run."""
        if channel not in self._hits:
            self._hits[channel] = cut(self.engine.hits(channel, self.plans))
        return self._hits[channel]

    def fused(self, channels: tuple[str, ...] = tuple(CHANNELS)) -> DataFrame:
        """The fusion of some channels, computed once in a run."""
        if channels not in self._fused:
            self._fused[channels] = cut(self.engine.fuse(self.plans, {c: self.hits(c) for c in channels}))
        return self._fused[channels]

    def prepare(self, *channels: tuple[str, ...]) -> None:
        """Read the texts of all candidates of several configurations at once; each pair of query and item is looked at once."""
        pairs = reduce(DataFrame.unionByName, (self.distinct.fused(c).select("query_id", "id") for c in channels)).distinct()
        self._features = cut(ranking.pair_features(pairs, self.items, self.distinct.plans))

    def ranked(self, channels: tuple[str, ...] = tuple(CHANNELS), rerank: bool = True) -> DataFrame:
        """The results of each distinct text, under the ids of that run."""
        return ranking.final_ranking(self.distinct.fused(channels), self.items, self.distinct.plans, ranking.Settings(rerank=rerank), self._features)

    def results(self, channels: tuple[str, ...] = tuple(CHANNELS), rerank: bool = True) -> DataFrame:
        return self.every(self.ranked(channels, rerank))

    def gold(self) -> DataFrame:
        """The section that holds the page of the posting that was asked about."""
        pages = self.items.select("id", "document_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
        return self.queries.select("query_id", "document_id", "page").join(pages, ["document_id", "page"]).select("query_id", "id")

    def first_matches(self, gold: DataFrame) -> DataFrame:
        """``evaluation.first_match`` of the results with gold (query_id, id).

        Results are some of the fused candidates: a text none of whose queries has a gold id there is missed by all of
        them, whatever its ranking, so only the other texts are ranked.
        """
        texts, fused = self.distinct.queries.withColumnRenamed("query_id", "_text"), self.distinct.fused()
        asked = gold.select("query_id", "id").distinct().join(self.queries.select("query_id", "text"), "query_id")
        asked = cut(spread_join(asked, texts, ["text"], F.col("query_id")).select("query_id", "id", "_text"))
        near = fused.join(asked.select(F.col("_text").alias("query_id"), "id").distinct(), ["query_id", "id"], "left_semi").select("query_id").distinct()
        near = broadcast_if_small(near)
        ids = broadcast_if_small(fused.join(near, "query_id", "left_semi").select("id").distinct())
        ranked = ranking.final_ranking(fused, self.items.join(ids, "id", "left_semi"), self.distinct.plans.join(near, "query_id", "left_semi"))
        found = asked.join(ranked.withColumnRenamed("query_id", "_text"), ["_text", "id"]).select("query_id", "id", "rank")
        return evaluation.first_match(found, gold, self.queries)


# --- SQL of the same stages -------------------------------------------------------------------------------------
def _any(words, c: str = "low") -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _all(groups, c: str) -> str:
    return " AND ".join(_any(words, c) for words in groups)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _exists(values: str, test: str) -> str:
    return f"(len(list_filter({values}, lambda v: {test})) > 0)"


_SECTIONS = "list_filter([" + ", ".join(f"CASE WHEN {_any(h)} THEN '{k}' END" for k, h in planning.SECTION_HINTS.items()) + "], lambda x: x IS NOT NULL)"
_TYPES = "list_filter([" + ", ".join(f"CASE WHEN {_any(h)} THEN '{k}' END" for k, h in planning.ENCOUNTER_HINTS.items()) + "], lambda x: x IS NOT NULL)"
_LABS = "list_filter([" + ", ".join(f"CASE WHEN contains(low, '{x.lower()}') THEN '{x}' END" for x in planning.LAB_TERMS) + "], lambda x: x IS NOT NULL)"
_CUES = "flatten([" + ", ".join(f"CASE WHEN {_all(g, 'padded')} THEN {_list(w)} ELSE []::VARCHAR[] END" for g, w in planning.EXPANSIONS) + "])"
_W = "CASE intent " + " ".join(f"WHEN '{k}' THEN [{', '.join(f'{x}::DOUBLE' for x in w)}]" for k, w in planning.WEIGHTS.items()) + " END"
_SYNONYMS = "MAP {" + ", ".join(f"'{k}': {_list(sorted({k, *v}))}" for k, v in SYNONYMS.items()) + "}"
PLANS = rf"""{TEXTS}, {ENC},
q AS (SELECT m.id AS query_id, CASE (m.id // 20) % 6 WHEN 0 THEN concat_ws(' ', 'why', d, c.section)
   WHEN 1 THEN concat_ws(' ', 'which dose of', d, 'was started after the lab value on', m.encounter_date) WHEN 2 THEN concat_ws(' ', 'who signed the note about', d)
   WHEN 3 THEN concat_ws(' ', d, 'taking since', m.encounter_date) WHEN 4 THEN concat_ws(' ', 'date of birth and allergies with', d)
   ELSE concat_ws(' ', 'icd code in', c.section, 'for', d, c.provider) END AS text, m.document_id, m.page_start AS page
  FROM (SELECT *, lower(trim(medication, ' ')) AS d FROM medications) m LEFT JOIN chunks c USING (chunk_id) WHERE m.id % 20 = 0 AND d <> ''),
it0 AS (SELECT t.chunk_id AS id, t.document_id, coalesce(t.encounter_id, 'page_' || t.page_start) AS grp, t.key, lower(t.section) AS section, t.text, t.page_start, t.page_end, c.provider, e.encounter_type,
   CASE WHEN regexp_full_match(c.encounter_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN c.encounter_date END AS day
  FROM texts t JOIN (SELECT DISTINCT chunk_id, provider, encounter_date FROM chunks WHERE chunk_type = 'section') c USING (chunk_id) LEFT JOIN enc e ON e.document_id = t.document_id AND e.encounter_id = t.encounter_id),
items AS MATERIALIZED (SELECT *, {NORM.format('text')} AS norm, {TOK('text')} AS tokens, lower(text) AS body, list_distinct(regexp_extract_all(text, '{ICD}', 1)) AS codes,
   list_distinct(list_concat({written_dates_sql('text')}, CASE WHEN day IS NULL THEN []::VARCHAR[] ELSE [day] END)) AS dates,
   len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{ROW}'))) AS lab_rows, regexp_matches(text, '{SIGNED}') AS signed FROM it0),
s AS (SELECT *, {_SECTIONS} AS sections FROM (SELECT *, lower(text) AS low, ' ' || lower(text) || ' ' AS padded FROM q)),
i AS (SELECT *, CASE WHEN contains(low, 'signed') OR contains(low, 'signature') THEN 'signature_lookup'
  WHEN {_any(("hba1c", "ldl", "lab"))} AND {_any(("medication", "started", "increased", "dose", "initiated", "added"))} THEN 'lab_value_linked_to_medication_change'
  WHEN contains(low, 'icd') OR contains(low, 'diagnosis code') THEN 'icd_code_lookup'
  WHEN contains(low, 'table') OR (contains(low, 'lab') AND contains(low, 'value')) THEN 'table_heavy'
  WHEN len(sections) >= 2 THEN 'multi_part_clinical' WHEN {_any(("why", "rationale", "because", "reason"))} THEN 'clinical_explanation'
  WHEN list_has_any(sections, ['signature', 'demographics', 'medications']) THEN 'metadata_exact' ELSE 'general' END AS intent FROM s),
w0 AS (SELECT *, {_W} AS w, regexp_matches(low, '\b(?:19|20)[0-9]{{2}}\b') OR {_any(planning.MONTHS)} AS dated FROM i),
w1 AS (SELECT *, CASE WHEN dated THEN least(0.45::DOUBLE, w[1] + 0.05::DOUBLE) ELSE w[1] END AS a, w[2] AS b, CASE WHEN dated THEN least(0.45::DOUBLE, w[3] + 0.1::DOUBLE) ELSE w[3] END AS c, w[4] AS d FROM w0),
names AS (SELECT DISTINCT lower(trim(medication, ' ')) AS name FROM medications WHERE trim(medication, ' ') <> ''),
qw AS (SELECT query_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''-]*') AS l FROM q),
grams AS (SELECT DISTINCT query_id, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]), list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]))) AS name FROM qw),
meds AS (SELECT query_id, list_sort(list(name)) AS medications FROM grams JOIN names USING (name) GROUP BY 1),
e0 AS (SELECT w1.*, coalesce(medications, []::VARCHAR[]) AS medications, {written_dates_sql('text')} AS dates, {_LABS} AS labs0,
  list_transform(regexp_extract_all(text, '{planning.PERSON}'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))) AS providers, {_TYPES} AS types,
  regexp_extract_all(text, '{planning.NUMBER}') AS numbers, regexp_extract_all(text, '{planning.CODE}') AS codes, regexp_extract_all(text, '{planning.DOSE}') AS doses, {_CUES} AS cues
  FROM w1 LEFT JOIN meds USING (query_id)),
e1 AS (SELECT *, list_distinct(flatten(list_transform(medications, lambda m: coalesce(({_SYNONYMS})[m], [m])))) AS aliases,
  list_distinct(list_concat(labs0, CASE WHEN contains(low, 'lab') OR contains(low, 'sglt2') THEN ['HbA1c', 'LDL'] ELSE []::VARCHAR[] END)) AS labs FROM e0),
e2 AS (SELECT *, list_distinct(list_transform(list_concat(aliases, labs0, cues), lambda x: lower(x))) AS expansions FROM e1),
plans AS MATERIALIZED (SELECT query_id, text, low, intent, sections, dates, medications, aliases, providers, types, numbers, codes, labs, expansions,
  text || ' ' || array_to_string(expansions, ' ') || ' ' || array_to_string(dates, ' ') AS expanded,
  list_sort(list_distinct(list_filter(list_transform(list_concat(medications, providers, codes, numbers, labs, aliases, list_filter(expansions, lambda x: length(x) >= 4), doses), lambda n: lower(n)), lambda n: length(n) >= 2))) AS needles,
  round(a / (a + b + c + d), 6) AS w_lexical, round(b / (a + b + c + d), 6) AS w_dense, round(c / (a + b + c + d), 6) AS w_structured, round(d / (a + b + c + d), 6) AS w_visual FROM e2)"""
BM25 = rf"""{PLANS},
tok AS (SELECT id, unnest(tokens) AS term FROM items), post AS (SELECT term, id, count(*) AS tf FROM tok GROUP BY 1, 2),
dl AS (SELECT id, len(tokens)::DOUBLE AS dl FROM items), st AS (SELECT (SELECT count(*) FROM items) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM items) AS avgdl),
raw AS (SELECT term, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS r FROM post, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN r < 0 THEN (SELECT avg(r) * 0.25::DOUBLE FROM raw) ELSE r END AS idf FROM raw),
uq AS (SELECT DISTINCT expanded AS q FROM plans), qt AS (SELECT q, term, count(*) AS qtf FROM (SELECT q, unnest({TOK('q')}) AS term FROM uq) GROUP BY 1, 2),
sc AS (SELECT q, id, round(sum(qtf * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score
  FROM post JOIN qt USING (term) JOIN idf USING (term) JOIN dl USING (id), st GROUP BY 1, 2 HAVING score > 0),
bt AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INTEGER AS rank FROM sc QUALIFY rank <= 60),
bm25 AS (SELECT query_id, id, score, rank FROM plans JOIN bt ON bt.q = plans.expanded)"""
EXACT = rf"""{PLANS}, st AS (SELECT count(*) AS n FROM items),
needles AS (SELECT query_id, unnest(needles) AS needle FROM plans), forms AS (SELECT needle, ' ' || array_to_string(t, ' ') || ' ' AS form FROM (SELECT DISTINCT needle, {TOK('needle')} AS t FROM needles) WHERE len(t) > 0),
ef AS MATERIALIZED (SELECT id, needle FROM (SELECT id, ' ' || array_to_string(tokens, ' ') || ' ' AS words FROM items) JOIN forms ON contains(words, form)),
ed AS (SELECT needle, least(1 + sqrt(n::DOUBLE / count(*)), 40) AS weight, count(*) < greatest(80, n * 0.02) AS rare FROM ef, st GROUP BY needle, n),
es AS (SELECT query_id, id, round(sum(weight), 6) + CASE WHEN count(*) FILTER (rare) >= 2 THEN 20 ELSE 0 END AS score FROM ef JOIN ed USING (needle) JOIN needles USING (needle) GROUP BY 1, 2),
exact AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM es QUALIFY rank <= 80)"""
_HINTED = "list_filter([" + ", ".join(f"CASE WHEN contains(section, '{k.replace('_', ' ')}') OR contains(section, '{k}') THEN 'k:{k}' END" for k in planning.SECTION_HINTS) + "], lambda x: x IS NOT NULL)"
STRUCTURED = rf"""{PLANS},
posted AS (SELECT t.id, lower(trim(m.medication, ' ')) AS drug, count(*) AS n FROM medications m JOIN items t ON t.document_id = m.document_id AND m.page_start BETWEEN t.page_start AND t.page_end
  WHERE trim(m.medication, ' ') <> '' GROUP BY 1, 2),
fi AS (SELECT id, unnest({_HINTED}) AS feature, 1.0::DOUBLE AS amount FROM items UNION ALL SELECT id, 'c:' || unnest(codes), 2.5 FROM items
  UNION ALL SELECT id, 'd:' || day, CASE WHEN signed THEN 7 ELSE 3 END FROM items WHERE day IS NOT NULL UNION ALL SELECT id, 'm:' || left(day, 7), 2.5 FROM items WHERE day IS NOT NULL
  UNION ALL SELECT id, 'p:' || lower(provider), 2 FROM items WHERE provider IS NOT NULL UNION ALL SELECT id, 't:signature', 1.5 FROM items WHERE signed
  UNION ALL SELECT id, 't:laboratory_results', lab_rows * 0.8::DOUBLE FROM items WHERE lab_rows > 0 UNION ALL SELECT id, 'x:' || drug, n * 2 FROM posted
  UNION ALL SELECT id, unnest(['t:medications', 't:plan']), sum(n) * 0.5::DOUBLE FROM posted GROUP BY id),
fq AS (SELECT DISTINCT query_id, unnest(list_concat(list_transform(sections, lambda x: 'k:' || x), list_transform(list_filter(sections, lambda x: x IN ('signature', 'laboratory_results', 'medications', 'plan')), lambda x: 't:' || x),
  list_transform(dates, lambda d: CASE WHEN length(d) = 10 THEN 'd:' ELSE 'm:' END || d), list_transform(medications, lambda x: 'x:' || x), list_transform(codes, lambda x: 'c:' || upper(x)), list_transform(providers, lambda x: 'p:' || lower(x)))) AS feature FROM plans),
fs AS (SELECT query_id, id, round(sum(amount), 6) AS score FROM fq JOIN fi USING (feature) GROUP BY 1, 2 HAVING score > 0),
structured AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM fs QUALIFY rank <= 40)"""


def _vector(source: str, key: str, tokens: str, where: str = "") -> str:
    counts = f"SELECT {key}, ('0x' || left(md5(term), 6))::INTEGER % 256 AS slot, count(*) AS tf FROM (SELECT {key}, unnest({tokens}) AS term FROM {source}) {where} GROUP BY 1, 2"
    return f"(SELECT {key}, slot, tf / sqrt(sum(tf * tf) OVER (PARTITION BY {key}))::DOUBLE AS w FROM ({counts}))"


DENSE = rf"""{PLANS}, vi AS {_vector('items', 'id', 'tokens')}, vq AS {_vector('(SELECT DISTINCT expanded AS q FROM plans)', 'q', TOK('q'), "WHERE term IN (SELECT unnest(tokens) FROM items)")},
vs AS (SELECT q, id, round(sum(vi.w * vq.w), 6) AS score FROM vq JOIN vi USING (slot) GROUP BY 1, 2 HAVING score > 0),
vt AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INTEGER AS rank FROM vs QUALIFY rank <= 60),
dense AS (SELECT query_id, id, score, rank FROM plans JOIN vt ON vt.q = plans.expanded)"""
_STAGES = {"bm25": BM25, "exact": EXACT, "structured": STRUCTURED, "dense": DENSE}


def _fused(channels: tuple[str, ...]) -> str:
    column = {"bm25": "w_lexical", "exact": "w_lexical * 1.5::DOUBLE", "structured": "w_structured", "dense": "w_dense"}
    chain = PLANS + "".join(_STAGES[c][len(PLANS):].replace(", st AS (SELECT count(*) AS n FROM items)", "" if "bm25" in channels else ", st AS (SELECT count(*) AS n FROM items)") for c in channels)
    union = " UNION ALL ".join(f"SELECT h.query_id, h.id, {column[c]} / (60 + h.rank) AS part FROM {c} h JOIN plans USING (query_id)" for c in channels)
    return f"""{chain}, parts AS ({union}), ps AS (SELECT query_id, id, round(sum(part), 9) AS score FROM parts GROUP BY 1, 2),
fused AS MATERIALIZED (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ps QUALIFY rank <= 80)"""


def _results(channels: tuple[str, ...] = tuple(CHANNELS), rerank: bool = True) -> str:
    some = lambda values, text: _exists(values, f"contains({text}, lower(v))")
    number = _exists("nn", "contains(norm, v)")
    rr = "CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 50 AND len(qtok) > 0 THEN round(len(list_intersect(qtok, tokens)) / len(qtok), 6) ELSE 0 END" if rerank else "score"
    hits = " + ".join(
        f"coalesce({c}, false)::INTEGER" for c in (
            some("aliases", "body"), f"({some('labs', 'body')} OR ({_any(('lab', 'hba1c', 'ldl'))} AND regexp_matches(body, '{LAB_NAMES}')))",
            f"(list_has_any(qcodes, codes) OR (({_any(('icd', 'diagnosis', 'code'))} OR list_contains(sections, 'assessment')) AND regexp_matches(body, '{ANY_CODE}')))",
            number, some("providers", "body"), f"(list_has_any(sections, ['imaging', 'follow_up']) AND {_any(FOLLOW_WORDS, 'body')})",
        )
    )
    history = ", ".join(f"'{x}'" for x in HISTORY_SECTIONS)
    return f"""{_fused(channels)},
dv AS (SELECT f.*, t.section, t.body, t.norm, t.tokens, t.codes, t.dates, t.encounter_type, p.low, p.sections, p.aliases, p.providers, p.types, p.labs, p.codes AS qcodes, p.dates AS qdates,
   list_transform(p.numbers, lambda v: {NORM.format('v')}) AS nn, list_distinct({TOK('p.text')}) AS qtok
  FROM (SELECT f.*, row_number() OVER (PARTITION BY f.query_id, t.grp ORDER BY f.rank) AS g FROM fused f JOIN items t USING (id) QUALIFY g <= 6) f JOIN items t USING (id) JOIN plans p USING (query_id)),
rr AS (SELECT *, {rr} AS rr, ({hits}) AS hits FROM dv),
me AS (SELECT *, 0.12::DOUBLE * coalesce({_exists('qdates', "CASE WHEN length(v) = 10 THEN list_contains(dates, v) ELSE len(list_filter(dates, lambda x: starts_with(x, v))) > 0 END")}, false)::INTEGER
  + 0.08::DOUBLE * coalesce({_exists('sections', "contains(section, v) OR contains(section, replace(v, '_', ' '))")}, false)::INTEGER
  + 0.08::DOUBLE * CASE WHEN {some('aliases', 'body')} OR {some('providers', 'body')} OR list_has_any(qcodes, codes) THEN 1.0 WHEN {some('labs', 'body')} THEN 0.9
      WHEN {_exists('types', "contains(lower(encounter_type), v)")} THEN 0.8 WHEN {some('types', 'body')} THEN 0.6 ELSE 0 END::DOUBLE
  + 0.1::DOUBLE * {_exists('nn', "contains(norm, v) OR contains(replace(norm, ' ', ''), replace(v, ' ', ''))")}::INTEGER
  + 0.16::DOUBLE * CASE WHEN hits >= 3 THEN 1.0 WHEN hits = 2 THEN 0.7 WHEN hits = 1 THEN 0.25 ELSE 0 END::DOUBLE
  + 0.08::DOUBLE * CASE WHEN {_exists('sections', "contains(section, v)")} OR ({_any(HISTORY_WORDS)} AND coalesce(section IN ({history}), false)) THEN 1.0
      WHEN {_any(MEDICATION_WORDS)} AND coalesce(contains(section, 'med'), false) THEN 0.85 ELSE 0 END::DOUBLE AS meta FROM rr),
mm AS (SELECT *, min(rr) OVER w AS rl, max(rr) OVER w AS rh, min(score) OVER w AS sl, max(score) OVER w AS sh FROM me WINDOW w AS (PARTITION BY query_id)),
fin AS (SELECT query_id, id, left(norm, 180) AS head, round(0.65::DOUBLE * CASE WHEN rh - rl < 1e-9 THEN 1 ELSE (rr - rl) / (rh - rl) END + 0.2::DOUBLE * CASE WHEN sh - sl < 1e-9 THEN 1 ELSE (score - sl) / (sh - sl) END + 0.15::DOUBLE * meta, 6) AS final FROM mm),
un AS (SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY query_id, head ORDER BY final DESC, id) = 1),
results AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id)::INTEGER AS rank, id, final AS score FROM un QUALIFY rank <= 10)"""


def _quality(channels: tuple[str, ...], rerank: bool = True) -> str:
    return f"""{_results(channels, rerank)},
gold AS (SELECT q.query_id, t.id FROM q JOIN items t ON t.document_id = q.document_id AND q.page BETWEEN t.page_start AND t.page_end),
fm AS (SELECT q.query_id, min(r.rank) AS fr FROM q LEFT JOIN (SELECT r.* FROM results r JOIN gold USING (query_id, id)) r USING (query_id) GROUP BY 1)
SELECT count(*) AS queries, {', '.join(f"round(avg(CASE WHEN fr <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_{k}" for k in (1, 3, 5, 10))},
round(avg(CASE WHEN fr <= 10 THEN 1.0::DOUBLE / fr ELSE 0 END), 6) AS mrr_10, round(avg(CASE WHEN fr <= 10 THEN 1.0::DOUBLE / log2(fr + 1) ELSE 0 END), 6) AS ndcg_10,
round(avg(CASE WHEN fr <= 10 THEN 0.1::DOUBLE ELSE 0 END), 6) AS precision_10, round(avg(fr), 6) AS mean_rank, count(*) FILTER (fr IS NULL) AS missed FROM fm"""


_LISTS = ("sections", "medications", "providers", "codes", "numbers", "dates")


def e08_query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent, sections, entities, needles and channel weights of all queries."""
    plans = Inputs(spark, sf_dir).plans
    joined = [F.array_join(c, ",").alias(c) for c in _LISTS]
    extra = [F.array_join(F.array_sort("labs"), ",").alias("labs"), F.array_join(F.array_sort("encounter_types"), ",").alias("encounter_types"), F.array_join("needles", ",").alias("needles")]
    return plans.select("query_id", "text", "intent", *joined, *extra, *(f"w_{c}" for c in planning.CHANNELS))


E08 = f"""WITH {PLANS} SELECT query_id, text, intent, {', '.join(f"array_to_string({c}, ',') AS {c}" for c in _LISTS)}, array_to_string(list_sort(labs), ',') AS labs,
 array_to_string(list_sort(types), ',') AS encounter_types, array_to_string(needles, ',') AS needles, w_lexical, w_dense, w_structured, w_visual FROM plans"""


def e06_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each query gains, one row per expansion."""
    plans = Inputs(spark, sf_dir).plans
    return plans.select("query_id", F.explode(F.transform("expansions", lambda e: F.lower(e))).alias("expansion"))


E06 = f"WITH {PLANS} SELECT query_id, unnest(expansions) AS expansion FROM plans"


_ENTITIES = ("medications", "providers", "encounter_types", "numbers", "codes", "labs", "dates")


def e05_query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of all queries, one row each: medications, providers, types of encounter, numbers, codes, tests, dates."""
    plans = Inputs(spark, sf_dir).plans
    kinds = F.flatten(F.array(*(F.transform(c, _tagged(c)) for c in _ENTITIES)))
    return plans.select("query_id", F.explode(F.array_distinct(kinds)).alias("e")).select("query_id", "e.*")


def _tagged(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))


E05 = f"WITH {PLANS} " + " UNION ALL ".join(f"SELECT DISTINCT query_id, '{c}' AS kind, unnest({'types' if c == 'encounter_types' else c}) AS value FROM plans" for c in _ENTITIES)


def e07_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exact channel looks for, one row per query and needle."""
    return Inputs(spark, sf_dir).plans.select("query_id", F.explode("needles").alias("needle"))


E07 = f"WITH {PLANS} SELECT query_id, unnest(needles) AS needle FROM plans"


def f02_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical channel."""
    return Inputs(spark, sf_dir).hits("bm25")


def f03_hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense channel with hashed term vectors in place of an encoder's."""
    return Inputs(spark, sf_dir).hits("dense")


def f06_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact channel."""
    return Inputs(spark, sf_dir).hits("exact")


def f08_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured channel."""
    return Inputs(spark, sf_dir).hits("structured")


def g01_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of the channels."""
    return Inputs(spark, sf_dir).fused()


def g17_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final results of all queries."""
    return Inputs(spark, sf_dir).results()


def i13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the final results against the sections asked about."""
    run = Inputs(spark, sf_dir)
    return evaluation.quality(run.first_matches(cut(run.gold())))


def i04_evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the final results against an evidence: the first line of 40 characters or more of the section asked about."""
    run = Inputs(spark, sf_dir)
    gold = run.gold().join(run.items.select("id", "text"), "id")
    line = F.get(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 40), F.lit(0))
    evidence = gold.groupBy("query_id").agg(F.min_by(line, "id").alias("evidence"))
    pairs = run.results().join(run.items.select("id", "text"), "id").join(evidence, "query_id")
    held = evaluation.evidence_matches(pairs.select("query_id", "rank", "text", "evidence")).where("matches")
    first = run.queries.select("query_id").distinct().join(held.groupBy("query_id").agg(F.min("rank").alias("first_rank")), "query_id", "left")
    return evaluation.quality(first)


#: The configurations that are compared: channels, and whether results are reranked. There is no visual channel.
CONFIGS = {
    "bm25_only": (("bm25",), True), "dense_only": (("dense",), True), "bm25_dense": (("bm25", "dense"), True),
    "bm25_exact": (("bm25", "exact"), True), "bm25_structured": (("bm25", "structured"), True),
    "full_no_rerank": (tuple(CHANNELS), False), "full_with_rerank": (tuple(CHANNELS), True),
}


def i15_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality with fewer channels and without reranking."""
    run, out = Inputs(spark, sf_dir), None
    gold = cut(run.gold())
    run.prepare(*dict.fromkeys(channels for channels, _ in CONFIGS.values()))
    for name, (channels, rerank) in CONFIGS.items():
        row = evaluation.quality(evaluation.first_match(run.results(channels, rerank), gold, run.queries)).withColumn("config", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


I15 = " UNION ALL BY NAME ".join(f"(SELECT *, '{name}' AS config FROM (WITH {_quality(*ch)}))" for name, ch in CONFIGS.items())


def i14_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of the results' metadata."""
    run = Inputs(spark, sf_dir)
    fields = ["page_start", "encounter_id", "section", "provider"]
    return evaluation.grounding(run.results().join(run.items.select("id", *fields), "id"), fields)


I14 = f"""WITH {_results()}, r AS (SELECT c.page_start, c.encounter_id, c.section, c.provider FROM results r JOIN chunks c ON c.chunk_id = r.id)
""" + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS filled, count(*) AS results, round(count({f}) / count(*), 6) AS share FROM r" for f in ("page_start", "encounter_id", "section", "provider"))


def h04_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive answers with checked citations."""
    run = Inputs(spark, sf_dir)
    found = cut(answers.evidence(run.ranked().join(run.items.select("id", "text"), "id")))
    out = answers.bundles(run.distinct.queries, found)
    return run.every(out.select("query_id", F.md5("answer").alias("digest"), F.coalesce(F.size("evidence"), F.lit(0)).alias("evidence"), F.array_join("citations_used", ",").alias("used"), F.array_join("invalid_citations", ",").alias("invalid"), "grounded"))


H04 = rf"""WITH {_results()}, ev AS (SELECT r.query_id, r.rank, CASE WHEN length(t.text) > 900 THEN left(t.text, 897) || '...' ELSE t.text END AS text, t.id, t.page_start, t.section_written, r.score FROM results r JOIN (SELECT *, regexp_replace(body_text, '^\s+|\s+$', '', 'g') AS text FROM (SELECT i.id, i.page_start, c.section AS section_written, i.text AS body_text FROM items i JOIN (SELECT DISTINCT chunk_id, section FROM chunks) c ON c.chunk_id = i.id)) t USING (id)),
an AS (SELECT query_id, string_agg('[E' || rank || '] ' || left(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 280), chr(10) ORDER BY rank) AS answer, string_agg('E' || rank, ',' ORDER BY rank) AS used FROM ev WHERE rank <= 5 GROUP BY 1),
nu AS (SELECT query_id, count(*)::INTEGER AS n FROM ev GROUP BY 1)
SELECT DISTINCT q.query_id, md5(coalesce(answer, 'The evidence is insufficient.')) AS digest, coalesce(n, 0) AS evidence, coalesce(used, '') AS used, '' AS invalid, used IS NOT NULL AS grounded FROM q LEFT JOIN an USING (query_id) LEFT JOIN nu USING (query_id)"""


def h02_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their evidence for a language model."""
    run = Inputs(spark, sf_dir)
    results = run.ranked().join(run.items.select("id", "text", F.col("page_start").alias("page"), "section"), "id")
    found = answers.evidence(results, also=("page", "section", "score"))
    return run.every(answers.prompts(run.distinct.queries, found).select("query_id", F.md5("prompt").alias("digest"), "prompt_tokens"))


H02 = H04.split("an AS (SELECT")[0] + r"""b AS (SELECT query_id, string_agg('[E' || rank || '] chunk_id=' || id || ' page=' || coalesce(page_start::VARCHAR, 'None') || ' section=' || coalesce(section_written, 'None') || ' score=' || round(score::DECIMAL(18, 6), 4)::DECIMAL(18, 4) || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS body
  FROM ev WHERE rank <= 6 GROUP BY 1),
p AS (SELECT query_id, 'Question: ' || text || chr(10) || chr(10) || 'Evidence:' || chr(10) || body || chr(10) || 'Write the answer with [E#] citations. If evidence is insufficient, say so.' AS prompt FROM q JOIN b USING (query_id))
SELECT query_id, md5(prompt) AS digest, greatest(1, length(prompt) // 4)::INTEGER AS prompt_tokens FROM p"""


def i11_page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the page asked about is among the results' pages."""
    run = Inputs(spark, sf_dir)
    return evaluation.page_hits(run.results().join(run.items.select("id", "document_id", "page_start", "page_end"), "id"), run.queries.select("query_id", "document_id", "page"))


I11 = f"""WITH {_results()}, h AS (SELECT q.query_id, count(r.rank) FILTER (t.document_id = q.document_id AND q.page BETWEEN t.page_start AND t.page_end) AS n FROM q LEFT JOIN results r USING (query_id) LEFT JOIN items t ON t.id = r.id GROUP BY 1)
SELECT count(*) AS queries, round(avg((n > 0)::INTEGER), 6) AS page_hit, round(avg(n / 10), 6) AS page_precision FROM h"""


def a15_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which queries were answered and which missed."""
    run = Inputs(spark, sf_dir)
    results = cut(run.results().join(run.items.select("id", "page_start"), "id"))
    return evaluation.error_rows(evaluation.first_match(results, run.gold(), run.queries), results)


A15 = f"""WITH {_results()}, gold AS (SELECT q.query_id, t.id FROM q JOIN items t ON t.document_id = q.document_id AND q.page BETWEEN t.page_start AND t.page_end),
fm AS (SELECT q.query_id, min(r.rank) AS fr FROM q LEFT JOIN (SELECT r.* FROM results r JOIN gold USING (query_id, id)) r USING (query_id) GROUP BY 1),
tp AS (SELECT query_id, string_agg(t.page_start::VARCHAR, ',' ORDER BY r.rank) AS p FROM results r JOIN items t USING (id) WHERE r.rank <= 3 GROUP BY 1)
SELECT query_id, fr AS first_rank, coalesce(fr <= 10, false)::INTEGER AS hit, CASE WHEN fr <= 10 THEN 'OK' ELSE 'RETRIEVAL_MISS' END AS category,
 CASE WHEN fr <= 10 THEN 'rank=' || fr ELSE 'top_pages=' || coalesce(p, '') END AS notes FROM fm LEFT JOIN tp USING (query_id)"""


def f14_page_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the postings asked about and the pages after them, given to the chunks on them."""
    chunks = table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("id"), "document_id", "page_start", "page_end", F.when(F.col("chunk_type") == "atomic_fact", "atomic").otherwise(F.col("chunk_type")).alias("chunk_type"))
    asked = Inputs(spark, sf_dir).queries.where("page is not null")
    hits = asked.select("query_id", "document_id", F.explode(F.array(F.struct(F.col("page").alias("page_number"), F.lit(1.0).alias("score")), F.struct((F.col("page") + 1).alias("page_number"), F.lit(0.5).alias("score")))).alias("h"))
    return ranking.page_spread(hits.select("query_id", "document_id", "h.*"), chunks)


F14 = """WITH c AS (SELECT chunk_id AS id, document_id, page_start, page_end FROM chunks WHERE chunk_type IN ('atomic_fact', 'section')),
s AS (SELECT id, document_id, unnest(range(page_start, page_end + 1)) AS page FROM c), l AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY id) - 1 AS i FROM s QUALIFY i < 12),
q AS (SELECT id AS query_id, document_id, unnest([page_start, page_start + 1]) AS page, unnest([1.0::DOUBLE, 0.5::DOUBLE]) AS score FROM medications WHERE id % 20 = 0 AND lower(trim(medication, ' ')) <> ''),
h AS (SELECT query_id, l.id, round(max(score / (1 + 0.15::DOUBLE * i)), 6) AS score FROM q JOIN l USING (document_id, page) GROUP BY 1, 2)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM h QUALIFY rank <= 90"""


def f04_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors by dot product."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.dense(v, v.where("id % 20 = 0"))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
F04 = f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_DOT.format('q.embedding', 'v.embedding')}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 10"""


def f05_cell_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors by an inverted-file index over all vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    centres = vector_index.fit_centres(v)
    return vector_index.search_cells(vector_index.assign(v, centres), v.where("id % 20 = 0"), centres, share=0.625)


def f12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of the labels, of length 1, one row per dimension."""
    v = search.pooled(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("vector")), F.col("label"))
    return v.select(F.col("id").alias("label"), F.posexplode("vector").alias("dimension", "value")).select("label", "dimension", F.round("value", 6).alias("value"))


F12 = """WITH u AS (SELECT label, unnest(range(len(embedding)))::INTEGER AS dimension, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, dimension, avg(x) AS m FROM u GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1)
SELECT label, dimension, round(round(m / norm, 9), 6) AS value FROM m JOIN n USING (label)"""


def f11_late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ten vectors by their best-matching vectors."""
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 10).cast("bigint").alias("id"), F.col("vec_id").alias("member"), F.col("embedding").alias("vector"))
    return search.late_interaction(v, v.where("id % 20 = 0"))


F11 = f"""WITH v AS (SELECT vec_id // 10 AS id, vec_id AS member, embedding FROM embeddings), qv AS (SELECT * FROM v WHERE id % 20 = 0),
best AS (SELECT q.id AS query_id, v.id, q.member, max({_DOT.format('q.embedding', 'v.embedding')}) AS b FROM v, qv q GROUP BY 1, 2, 3),
sc AS (SELECT query_id, id, round(sum(b), 6) AS score FROM best GROUP BY 1, 2)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM sc QUALIFY rank <= 10"""

QUERIES = {
    f.__name__: f
    for f in (
        a15_error_rows, e05_query_entities, e06_expansions, e07_needles, e08_query_plans, f02_bm25, f03_hashed_vectors, f04_dense, f05_cell_index, f06_exact, f08_structured, f11_late_interaction, f12_centroids, f14_page_spread,
        g01_fused, g17_results, h02_prompts, h04_answers, i04_evidence_quality, i11_page_hits, i13_quality, i14_grounding, i15_ablation,
    )
}
_HITS = "SELECT query_id, id, score, rank FROM "
SQL = {
    "a15_error_rows": A15, "f11_late_interaction": F11, "f14_page_spread": F14, "h02_prompts": H02, "i11_page_hits": I11, "e05_query_entities": E05, "e06_expansions": E06, "e07_needles": E07, "e08_query_plans": E08, "f02_bm25": f"WITH {BM25} {_HITS} bm25", "f03_hashed_vectors": f"WITH {DENSE} {_HITS} dense", "f04_dense": F04,
    "f06_exact": f"WITH {EXACT} {_HITS} exact", "f08_structured": f"WITH {STRUCTURED} {_HITS} structured", "f12_centroids": F12,
    "g01_fused": f"WITH {_fused(tuple(CHANNELS))} {_HITS} fused", "g17_results": f"WITH {_results()} SELECT query_id, rank, id, score FROM results",
    "h04_answers": H04, "i13_quality": f"WITH {_quality(tuple(CHANNELS))}", "i14_grounding": I14, "i15_ablation": I15,
}
