"""Quality of results and grounding of answers."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartloom.functions.text import normalize_text
from chartloom.session import once


def first_match(results: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, first_rank): the best rank whose id is among the query's gold ids (query_id, id), null for a miss."""
    hits = results.join(gold.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.select("query_id").distinct().join(hits, "query_id", "left")


def quality(matches: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: queries, hit rate at each cut, MRR, nDCG and precision at 10, mean rank of matches, misses."""
    r = F.col("first_rank")
    within = r <= 10
    mean = lambda c: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0)), 6)
    return matches.agg(
        F.count("*").alias("queries"),
        *(mean(F.when(r <= k, 1.0)).alias(f"hit_{k}") for k in cuts),
        mean(F.when(within, 1 / r)).alias("mrr_10"), mean(F.when(within, 1 / F.log2(r + 1))).alias("ndcg_10"),
        mean(F.when(within, 0.1)).alias("precision_10"), F.round(F.avg("first_rank"), 6).alias("mean_rank"), F.count_if(r.isNull()).alias("missed"),
    )


def page_hits(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries, share with an expected page among the first ``k`` results, mean share of those results that show one.

    ``results`` has (query_id, rank, document_id, page_start, page_end), ``expected`` (query_id, document_id, page).
    """
    wanted = expected.where("page is not null").select("query_id", "document_id", "page").distinct()
    pairs = results.where(F.col("rank") <= k).join(wanted, ["query_id", "document_id"])
    shown = pairs.where(F.col("page").between(F.col("page_start"), F.col("page_end"))).groupBy("query_id").agg(F.count_distinct("rank").alias("n"))
    rows = expected.select("query_id").distinct().join(shown, "query_id", "left")
    return rows.agg(
        F.count("*").alias("queries"), F.round(F.coalesce(F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias("page_hit"),
        F.round(F.coalesce(F.avg(F.coalesce(F.col("n"), F.lit(0)) / k), F.lit(0.0)), 6).alias("page_precision"),
    )


def error_rows(matches: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, first_rank, hit, category, notes) of each query: OK with its rank, or RETRIEVAL_MISS with the first three pages."""
    pages = results.where("rank <= 3").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page_start"))).alias("p"))
    top = F.array_join(F.transform("p", lambda x: x["page_start"].cast("string")), ",")
    ok = F.coalesce(F.col("first_rank") <= k, F.lit(False))
    notes = F.when(ok, F.concat(F.lit("rank="), F.col("first_rank").cast("string"))).otherwise(F.concat(F.lit("top_pages="), F.coalesce(top, F.lit(""))))
    return matches.join(pages, "query_id", "left").select("query_id", "first_rank", ok.cast("int").alias("hit"), F.when(ok, "OK").otherwise("RETRIEVAL_MISS").alias("category"), notes.alias("notes"))


def latencies(seconds: DataFrame, value: str = "seconds") -> DataFrame:
    """One row: n, mean, median, 95th percentile by nearest rank, and maximum of a column of seconds."""
    bins = seconds.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    total = bins.agg(F.sum("n").alias("total"))
    # Ranks by running counts over the distinct values, never over the rows.
    order = W.orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    ranked = bins.crossJoin(F.broadcast(total)).withColumn("upto", F.sum("n").over(order))  # one row
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * q), F.col("total") - 1), F.col("x")))
    return ranked.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("x").alias("max"))


def duplicate_ratio(results: DataFrame, characters: int | None = 160) -> DataFrame:
    """(query_id, duplicate_ratio): share of a query's results whose beginning repeats another result's; whole texts for None."""
    head = F.col("text") if characters is None else F.left("text", F.lit(characters))
    return results.groupBy("query_id").agg(
        F.round(1 - F.count_distinct(head) / F.count("*"), 6).alias("duplicate_ratio")
    )


def grounding(results: DataFrame, fields: list[str]) -> DataFrame:
    """Completeness of each metadata field over all results: (field, filled, results, share)."""
    counts = [F.struct(F.lit(f).alias("field"), F.count(F.col(f)).alias("filled")).alias(f) for f in fields]
    wide = results.agg(F.count("*").alias("results"), *counts)
    return wide.select("results", F.explode(F.array(*(F.col(f) for f in fields))).alias("x")).select(
        F.col("x.field").alias("field"), F.col("x.filled").alias("filled"), "results", F.round(F.try_divide("x.filled", "results"), 6).alias("share")
    )


def nearest_rank(values: Column, share: float) -> Column:
    """The element at the 0-based index int(share * n) of the sorted values, the last one at most."""
    n = F.size(values)
    return F.get(F.array_sort(values), F.least(n - 1, F.floor(n * share).cast("int")))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``a`` that ``b`` has; 0 for an ``a`` without words."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.when(F.size(words(a)) > 0, F.size(F.array_intersect(words(a), words(b))) / F.size(words(a))).otherwise(0.0)


def similarities(text: Column, parts: Column) -> Column:
    """Ratcliff-Obershelp ratios of a text with each of an array of texts, which no built-in function computes."""

    @F.pandas_udf("array<double>")
    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[SequenceMatcher(None, q, p or "").ratio() for q in ([] if qs is None else qs)] for p, qs in zip(x, y)])

    return ratios(text, parts)


# What must not be missing from a text that holds an evidence: codes, pressures, shares, doses, and these words.
ANCHOR = (
    r"\b[a-z]\d{2}(?:\.\d+)?\b|\b\d{2,3}/\d{2,3}\b|\b\d+(?:\.\d+)?%|\b\d+(?:\.\d+)?\s*mg\b|"
    r"\b(?:metformin|penicillin|jardiance|empagliflozin|amlodipine|ozempic|semaglutide|chlorthalidone|cardiology|nephrology|"
    r"appendectomy|arthroscopy|hives|a\+|blood type)\b"
)
#: Characters up to which an evidence may miss no anchor; shares of words that do for evidence with all anchors, with most of its
#: dashed parts, and without fuzzy agreement.
SHORT_EVIDENCE, ANCHORED, DASHED, SURE = 160, 0.55, 0.65, 0.85


def _contained(norm: Column, part: Column) -> Column:
    """Whether a normalised text holds a normalised part, for parts of eight characters or more also without regard to blanks."""
    bare = F.replace(part, F.lit(" "), F.lit(""))
    return norm.contains(part) | ((F.length(bare) >= 8) & F.replace(norm, F.lit(" "), F.lit("")).contains(bare))


def evidence_matches(pairs: DataFrame, least_overlap: float = 0.70, least_ratio: float = 0.82) -> DataFrame:
    """Add ``matches`` to (text, evidence): whether the text holds the evidence, all of its clauses (split at semicolons).

    A clause is held if the normalised text contains it; or has all its anchors and most of its words; or all its parts
    between dashes; or enough of its words, and agrees with it as a whole; or if the clause contains the text. A short
    clause with an anchor that the text lacks is not held. Null and blank texts and evidences match nothing.
    """
    low_words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)))
    clauses = F.filter(F.transform(F.split(F.coalesce("evidence", F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")
    rows = once(pairs, _norm=F.coalesce(normalize_text(F.col("text")), F.lit("")))
    rows = once(rows, _clauses=F.transform(clauses, lambda p: F.struct(p.alias("p"), normalize_text(p).alias("n"))))
    norm = F.col("_norm")

    def decide(c: Column) -> Column:
        p, n = c["p"], c["n"]
        overlap, words = token_overlap(p, F.col("text")), F.size(low_words(p))
        anchors = F.regexp_extract_all(n, F.lit(ANCHOR), F.lit(0))
        bare = F.replace(norm, F.lit(" "), F.lit(""))
        missing = F.size(F.filter(anchors, lambda a: ~norm.contains(a) & ~bare.contains(F.replace(a, F.lit(" "), F.lit("")))))
        anchored = F.size(anchors) > 0
        dashed = F.filter(F.transform(F.split(p, "[—-]"), lambda x: normalize_text(x)), lambda x: F.length(x) >= 6)
        hits = F.size(F.filter(dashed, lambda x: _contained(norm, x)))
        enough = (overlap >= least_overlap) & (words >= 5)
        inside = (F.length(norm) > 20) & (F.length(norm) < F.length(n)) & n.contains(norm)
        return (
            F.when(_contained(norm, n), "yes")
            .when(anchored & (missing > 0) & ((F.length(p) < SHORT_EVIDENCE) | (missing > 1)), "no")
            .when(anchored & (missing == 0) & (overlap >= ANCHORED), "yes")
            .when((F.size(dashed) >= 2) & ((hits == F.size(dashed)) | ((hits >= F.size(dashed) * 0.8) & (overlap >= DASHED))), "yes")
            .when(enough & (anchored | (overlap >= SURE)), "yes").when(enough, "fuzzy")
            .otherwise(F.when(inside, "yes").otherwise("no"))
        )

    rows = once(rows, _said=F.transform("_clauses", lambda c: F.struct(c["n"].alias("n"), decide(c).alias("d"))))
    # Only what is left open is compared letter by letter.
    open_clauses = F.transform(F.filter("_said", lambda c: c["d"] == "fuzzy"), lambda c: c["n"])
    ratios = similarities(F.when(F.size(open_clauses) > 0, norm), open_clauses)
    given = (F.trim(norm) != "") & (F.size("_said") > 0)
    held = F.forall("_said", lambda c: c["d"] != "no") & F.forall(F.coalesce(ratios, F.array().cast("array<double>")), lambda r: r >= least_ratio)
    return rows.withColumn("matches", given & held).drop("_norm", "_clauses", "_said")
