"""Text functions on columns: normalisation, tokens, dates, small formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Synonyms of clinical terms, and the months of dates written in words.
SYNONYMS = {
    "jardiance": ["empagliflozin", "sglt2 inhibitor"],
    "empagliflozin": ["jardiance", "sglt2 inhibitor"],
    "ozempic": ["semaglutide", "glp-1", "glp1 receptor agonist"],
    "semaglutide": ["ozempic", "glp-1", "glp1 receptor agonist"],
    "htn": ["hypertension"],
    "hypertension": ["htn"],
    "t2dm": ["type 2 diabetes mellitus", "type 2 diabetes"],
    "type 2 diabetes mellitus": ["t2dm", "type 2 diabetes"],
    "hba1c": ["a1c", "hemoglobin a1c"],
    "twice daily": ["bid"],
    "sc": ["subcutaneous"],
    "subcutaneous": ["sc"],
}
MONTH_NAMES = "January February March April May June July August September October November December".split()
_MONTH = "(?:" + "|".join(MONTH_NAMES) + ")"
# Abbreviations and spellings with their normal form, applied in this order to lower-case text.
REWRITES = [
    (r"(\d)\s*mg\b", "$1 mg"),
    (r"\bb\.?i\.?d\.?\b", "twice daily"),
    (r"\bt\.?i\.?d\.?\b", "three times daily"),
    (r"\bq\.?d\.?\b", "once daily"),
    (r"\ba1c\b", "hba1c"),
    (r"\s\s+|[\t\n\x0B\f\r]", " "),
]
# What the next letters must be where one of these can match, looked at before the border of a word, which takes longer.
_AHEAD = ["", "(?=b)", "(?=t)", "(?=q)", "(?=a1c)", r"(?=\s)"]
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)?"


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Lower case, plain dashes, spaced doses, spelt-out frequencies, single blanks."""
    out = F.lower(text)
    for dash in "—–":
        out = F.replace(out, F.lit(dash), F.lit("-"))
    for (pattern, form), ahead in zip(REWRITES, _AHEAD, strict=True):
        out = F.regexp_replace(out, f"{ahead}(?:{pattern})", form)
    return F.trim(out)


def tokens_of(norm: Column) -> Column:
    """Search tokens of a normalised text, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(norm, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Search tokens of a text, in order; none for null."""
    return tokens_of(normalize_text(text))


def with_synonyms(norm: Column) -> Column:
    """A normalised text followed by the sorted synonyms of the terms it holds as whole words.

    Give the name of a column that holds the normalised text: it is looked at once per term.
    """
    extra = F.array_sort(F.array_distinct(F.flatten(F.array(
        *(F.when(norm.contains(term) & norm.rlike(rf"\b{term}\b"), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for term, names in SYNONYMS.items())
    ))))
    return F.when(F.size(extra) > 0, F.concat_ws(" ", norm, F.array_join(extra, " "))).otherwise(norm)


def synonyms_of(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Synonym closure over one step for a table of terms: (term, synonyms), the term itself included, sorted.

    ``aliases`` has rows (term, alias). Case is ignored in matching; a null term has no row.
    """
    wanted = terms.where("term is not null").select("term", F.lower("term").alias("k")).distinct()
    forward = aliases.select(F.lower("term").alias("k"), F.array("term", "alias").alias("names"))
    groups = aliases.groupBy("term").agg(F.collect_set("alias").alias("all"))
    backward = aliases.join(groups, "term").select(F.lower("alias").alias("k"), F.array_union(F.array("term"), "all").alias("names"))
    found = forward.unionByName(backward).groupBy("k").agg(F.flatten(F.collect_list("names")).alias("names"))
    none = F.array().cast("array<string>")
    return wanted.join(found, "k", "left").select(
        "term", F.array_sort(F.array_distinct(F.concat(F.array("term"), F.coalesce("names", none)))).alias("synonyms")
    )


def written_dates(text: Column) -> Column:
    """Sorted distinct dates of a text: ``yyyy-MM-dd`` for days, ``yyyy-MM`` for months; invalid days are dropped."""
    # Days and months in words are found in one pass: where one stands the other cannot, and neither holds the other.
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?=[jfmasond])\b({_MONTH}\s+(?:\d{{1,2}},\s+\d{{4}}|(?:19|2[0-7])\d{{2}}))\b"), F.lit(1))
    plain = lambda d: F.regexp_replace(d, r"\s+", " ")
    spelt = F.transform(
        found,
        lambda d: F.when(d.contains(","), F.date_format(F.try_to_date(plain(d), "MMMM d, yyyy"), "yyyy-MM-dd"))
        .otherwise(F.date_format(F.try_to_date(F.concat(F.lit("1 "), plain(d)), "d MMMM yyyy"), "yyyy-MM")),
    )
    iso = F.regexp_extract_all(text, F.lit(r"(?=[12])\b((?:19|2[0-7])\d{2}-\d{2}-\d{2})\b"), F.lit(1))
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.concat(spelt, iso)))), F.array().cast("array<string>"))


def long_date(iso: Column) -> Column:
    """``2024-03-05`` as ``March 5, 2024``; other text unchanged; null as ``Unknown``."""
    return F.coalesce(F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "MMMM d, yyyy"), iso, F.lit("Unknown"))


def needs_ocr(text: Column, least: int = 40) -> Column:
    """Whether a page has fewer than ``least`` characters beside white space; null counts as none."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < least


def safe_id(name: Column) -> Column:
    """A file name without directory and extension as an identifier of at most 80 characters."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "^.*/", ""), r"(.)\.[^.]*$", "$1")
    out = F.left(F.btrim(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "-"), F.lit("-._")), F.lit(80))
    return F.when(out == "", F.lit("upload")).otherwise(out)


def page_numbers(text: Column) -> Column:
    """Distinct page numbers of a list such as ``1,2,5-7``; a descending range is empty."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$"))
    first = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int")
    last = lambda p: F.regexp_extract(p, r"(\d+)$", 1).cast("int")
    none = F.array().cast("array<int>")
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.when(first(p) <= last(p), F.sequence(first(p), F.greatest(first(p), last(p)))).otherwise(none))))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("int")


def clip(text: Column, limit: int) -> Column:
    """The trimmed text, cut to ``limit`` characters with an ellipsis if it is longer."""
    t = F.trim(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)
