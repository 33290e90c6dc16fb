"""Fusion and final ranking of hits: reciprocal ranks, diversity, normalised scores, boosts, near duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartloom.functions.text import normalize_text, tokens
from chartloom.session import once


@dataclass(frozen=True)
class Settings:
    """Parameters of the final ranking."""

    rrf_k: int = 60
    fusion_top: int = 80
    per_group: int = 6
    rerank_top: int = 50
    rerank: bool = True
    top: int = 10
    reranker: float = 0.65
    hybrid: float = 0.20
    metadata: float = 0.15
    date: float = 0.12
    section: float = 0.08
    entity: float = 0.08
    numeric: float = 0.10
    cooccurrence: float = 0.16
    structure: float = 0.08


def fuse(channels: dict[str, DataFrame], weights: DataFrame, k: int = 60, top: int = 80) -> DataFrame:
    """Weighted reciprocal rank fusion of channels of hits: (query_id, id, score, rank).

    ``weights`` has (query_id, channel, weight); a channel without weight for a query is left out.
    """
    hits = None
    for name, df in channels.items():
        rows = df.select("query_id", "id", "rank", F.lit(name).alias("channel"))
        hits = rows if hits is None else hits.unionByName(rows)
    # One row of weights per query, so that hits are shuffled once, by their query.
    by_query = weights.where("channel is not null").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "weight"))).alias("w"))
    weighted = hits.join(by_query, "query_id").withColumn("weight", F.try_element_at("w", F.col("channel"))).where("weight is not null")
    fused = weighted.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def page_spread(pages: DataFrame, chunks: DataFrame, most: int = 12, decay: float = 0.15, top: int = 90) -> DataFrame:
    """Hits of pages given to the chunks on them: (query_id, id, score, rank).

    ``pages`` has (query_id, document_id, page_number, score), ``chunks`` (id, document_id, page_start, page_end,
    chunk_type). Of a page the first ``most`` chunks count, registry chunks of the page first, each later one for less; a
    chunk has its best page's score.
    """
    order = F.when(F.col("chunk_type") == "page_visual", 0).when(F.col("chunk_type").isin("atomic", "section", "compound", "page"), 1)
    spread = chunks.where("page_start <= page_end").select("id", "document_id", order.alias("o"), F.explode(F.sequence("page_start", "page_end")).alias("page_number")).where("o is not null")
    first = W.partitionBy("document_id", "page_number").orderBy("o", "id")
    listed = spread.withColumn("i", F.row_number().over(first) - 1).where(F.col("i") < most)
    hits = pages.join(listed, ["document_id", "page_number"]).groupBy("query_id", "id").agg(F.round(F.max(F.col("score") / (1 + decay * F.col("i"))), 6).alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def diversify(fused: DataFrame, most: int = 6) -> DataFrame:
    """At most ``most`` hits of each (query_id, grp), the best ranked."""
    order = W.partitionBy("query_id", "grp").orderBy("rank")
    return fused.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def minmax(score: Column, query: str = "query_id") -> Column:
    """Scores of a query scaled to 0..1; all 1 where they hardly differ."""
    w = W.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-9, F.lit(1.0)).otherwise((score - low) / (high - low))


def overlap(query: Column, text: Column) -> Column:
    """Share of a query's distinct tokens that a text holds, both arrays; 0 for no tokens. The built-in reranker."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, text)) / F.size(q)).otherwise(F.lit(0.0))


def head(norm: Column, characters: int | None = 180) -> Column:
    """What near duplicates have in common: the beginning of the normalised text; all of it for None."""
    return norm if characters is None else F.left(norm, F.lit(characters))


# Which table types answer a section hint.
TABLE_TYPES = {
    "demographics": ["demographics", "allergies", "medical_history", "surgical_history", "family_history"],
    "medications": ["current_medications", "medications", "plan_item", "plan_block"],
    "laboratory_results": ["labs", "laboratory_results", "lab_panel"],
    "signature": ["signature"],
    "referrals": ["referrals"],
    "vitals": ["vitals"],
    "imaging_orders": ["imaging_orders", "imaging"],
    "assessment": ["diagnoses", "diagnoses_set"],
}
# Words of a query that ask for history or medication whatever sections it hints at, and sections of a history.
HISTORY_WORDS = ["allergy", "allergies", "blood type", "family history", "surgical"]
MEDICATION_WORDS = ["medication", "dose", "taking", "started", "initiate"]
HISTORY_SECTIONS = ["allergies", "demographics", "family_history", "surgical_history", "medical_history"]
FOLLOW_WORDS = ["ultrasound", "imaging", "doppler", "follow-up", "follow up", "weeks"]
LAB_NAMES = r"\b(?:hba1c|ldl|hdl|tsh)\b"
ANY_CODE = r"\b[a-z][0-9]{2}(?:\.[0-9]+)?\b"


def _holds(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _some(values: str, text: Column) -> Column:
    """Whether a text holds one of the query's values, in lower case."""
    return F.exists(values, lambda v: text.contains(F.lower(v)))


def _table_types() -> Column:
    return F.create_map(*(x for k, v in TABLE_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def date_match(dates: Column, found: Column) -> Column:
    """1 if a day of ``dates`` is among ``found``, or a month begins one of them; else 0."""
    one = F.exists(dates, lambda d: F.when(F.length(d) == 10, F.array_contains(found, d)).otherwise(F.exists(found, lambda x: x.startswith(d))))
    return F.coalesce(one, F.lit(False)).cast("double")


def section_match(sections: Column, section: Column, table_type: Column, chunk_type: Column) -> Column:
    """1 if a hinted section stands in the item's section or its table type answers the hint, 0.9 for a synthesis of several, else 0."""
    types, table_type = _table_types(), table_type.cast("string")
    named = F.exists(sections, lambda i: section.contains(i) | section.contains(F.replace(i, F.lit("_"), F.lit(" "))))
    typed = F.exists(sections, lambda i: F.array_contains(F.try_element_at(types, i), table_type))
    synthesis = (F.size(sections) >= 2) & chunk_type.isin("compound", "encounter_key_facts")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(named) | yes(typed), 1.0).when(yes(synthesis), 0.9).otherwise(0.0)


def structure_match(low: Column, sections: Column, section: Column, table_type: Column) -> Column:
    """1 where section or table type fit the hints or a wish for history, 0.85 for wording about medication, else 0."""
    types, table_type = _table_types(), table_type.cast("string")
    fits = F.exists(sections, lambda i: F.coalesce(section.contains(i), F.lit(False)) | F.coalesce(F.array_contains(F.try_element_at(types, i), table_type), F.lit(False)))
    history = _holds(low, HISTORY_WORDS) & F.coalesce(table_type.isin(TABLE_TYPES["demographics"]) | section.isin(HISTORY_SECTIONS), F.lit(False))
    drugs = _holds(low, MEDICATION_WORDS) & F.coalesce(table_type.isin(TABLE_TYPES["medications"]) | section.contains("med"), F.lit(False))
    return F.when(fits | history, 1.0).when(drugs, 0.85).otherwise(0.0)


def entity_match(text: Column, codes: Column, encounter_type: Column) -> Column:
    """The best of: medication, provider or code of the query in the text 1, laboratory test 0.9, type of encounter 0.8, in the text only 0.6."""
    whole = _some("aliases", text) | _some("providers", text) | F.arrays_overlap("query_codes", codes)
    kind = F.coalesce(F.exists("encounter_types", lambda e: F.lower(encounter_type).contains(e)), F.lit(False))
    return F.when(whole, 1.0).when(_some("labs", text), 0.9).when(kind, 0.8).when(_some("encounter_types", text), 0.6).otherwise(0.0)


def numeric_match(norm: Column) -> Column:
    """1 if a number of the query (dose, pressure, share, weight) stands in the normalised text, with or without blanks; else 0."""
    bare = F.replace(norm, F.lit(" "), F.lit(""))
    return F.exists("norm_numbers", lambda n: norm.contains(n) | bare.contains(F.replace(n, F.lit(" "), F.lit("")))).cast("double")


def cooccurrence(low: Column, text: Column, norm: Column, codes: Column) -> Column:
    """How many kinds of the query's entities meet in the text (medication, laboratory test, code, number, provider, follow-up): 0, 0.25, 0.7, 1."""
    lab = _some("labs", text) | (_holds(low, ["lab", "hba1c", "ldl"]) & text.rlike(LAB_NAMES))
    asks_code = _holds(low, ["icd", "diagnosis", "code"]) | F.array_contains("sections", "assessment")
    code = F.arrays_overlap("query_codes", codes) | (asks_code & text.rlike(ANY_CODE))
    follow = (F.array_contains("sections", "imaging") | F.array_contains("sections", "follow_up")) & _holds(text, FOLLOW_WORDS)
    number = F.exists("norm_numbers", lambda n: norm.contains(n))
    hits = sum((c.cast("int") for c in (_some("aliases", text), lab, code, number, _some("providers", text), follow)), F.lit(0))
    return F.when(hits >= 3, 1.0).when(hits == 2, 0.7).when(hits == 1, 0.25).otherwise(0.0)


def pair_features(pairs: DataFrame, items: DataFrame, plans: DataFrame, s: Settings = Settings()) -> DataFrame:
    """What the final ranking knows of pairs (query_id, id) of a query and an item: (query_id, id, grp, head, overlap, meta).

    ``items`` has (id, grp, section, chunk_type, table_type, encounter_type, text, norm, tokens, head, dates, codes);
    ``plans`` comes from ``planning.plan``. Texts are read where the items are, and no later step carries them.
    """
    asked = plans.select(
        "query_id", F.lower("text").alias("query_low"), F.array_distinct(tokens(F.col("text"))).alias("query"), "sections", "aliases", "providers", "encounter_types", "labs",
        F.col("codes").alias("query_codes"), F.col("dates").alias("query_dates"), F.transform("numbers", lambda n: normalize_text(n)).alias("norm_numbers"),
    )
    both = pairs.select("query_id", "id").join(asked, "query_id").join(items, "id")
    # Lower case once per pair, not once per value that is looked for.
    both = once(both, low_text=F.lower("text"))
    low, text, norm, section = F.col("query_low"), F.col("low_text"), F.col("norm"), F.lower("section")
    meta = (
        s.date * date_match(F.col("query_dates"), F.col("dates"))
        + s.section * section_match(F.col("sections"), section, F.col("table_type"), F.col("chunk_type"))
        + s.entity * entity_match(text, F.col("codes"), F.col("encounter_type"))
        + s.numeric * numeric_match(norm)
        + s.cooccurrence * cooccurrence(low, text, norm, F.col("codes"))
        + s.structure * structure_match(low, F.col("sections"), section, F.col("table_type"))
    )
    return both.select("query_id", "id", "grp", "head", F.round(overlap(F.col("query"), F.col("tokens")), 6).alias("overlap"), meta.alias("meta"))


def final_ranking(fused: DataFrame, items: DataFrame, plans: DataFrame, s: Settings = Settings(), features: DataFrame | None = None) -> DataFrame:
    """The results of each query: (query_id, rank, id, score).

    ``features`` are the pairs' ``pair_features``, computed from ``items`` and ``plans`` if not given. Candidates beyond the
    rerank cut have a rerank score of 0; of near duplicates (equal beginnings of the normalised text) the best stays.
    """
    features = pair_features(fused, items, plans, s) if features is None else features
    candidates = diversify(fused.join(features, ["query_id", "id"]), s.per_group)
    position = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    # Without a reranker the fused score takes its place.
    reranked = F.when(position <= s.rerank_top, F.col("overlap")).otherwise(0.0) if s.rerank else F.col("score")
    scored = candidates.select("query_id", "id", "score", "head", reranked.alias("rr"), "meta")
    total = F.round(s.reranker * minmax(F.col("rr")) + s.hybrid * minmax(F.col("score")) + s.metadata * F.col("meta"), 6)
    scored = scored.withColumn("final", total)
    first = W.partitionBy("query_id", "head").orderBy(F.desc("final"), "id")
    unique = scored.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1)
    order = W.partitionBy("query_id").orderBy(F.desc("final"), "id")
    return unique.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.top).select("query_id", "rank", "id", F.col("final").alias("score"))
