"""Answers put together from evidence, with checked citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import token_estimate


def evidence(results: DataFrame, most: int = 900, also: tuple[str, ...] = ()) -> DataFrame:
    """Results as numbered evidence: (query_id, rank, evidence_id, id, text cut to ``most``), with the columns ``also`` of the results."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    cut = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)
    return results.select("query_id", F.col("rank").cast("int").alias("rank"), F.concat(F.lit("E"), F.col("rank")).alias("evidence_id"), "id", cut.alias("text"), *also)


def extractive(queries: DataFrame, found: DataFrame, top: int = 5, snippet: int = 280) -> DataFrame:
    """(query_id, answer, evidence): the best pieces of evidence with citations; a fixed sentence where there is none."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    line = F.concat(F.lit("["), F.col("evidence_id"), F.lit("] "), F.substring(flat, 1, snippet))
    answers = (
        found.where(F.col("rank") <= top).groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"), F.count("*").alias("evidence"))
        .select("query_id", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("answer"), "evidence")
    )
    return queries.select("query_id").distinct().join(answers, "query_id", "left").select(
        "query_id", F.coalesce("answer", F.lit("The evidence is insufficient.")).alias("answer"), F.coalesce("evidence", F.lit(0)).alias("evidence")
    )


def citations(answer: Column, valid: Column) -> tuple[Column, Column]:
    """Distinct citation marks of an answer in numeric order, and those that are not among ``valid``."""
    marks = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(E[0-9]+)\]"), F.lit(1)))
    number = lambda x: F.substring(x, 2, 9).cast("int")
    used = F.array_sort(marks, lambda a, b: number(a) - number(b))
    return used, F.array_except(used, valid)


# The frame of a question with its evidence.
QUESTION, EVIDENCE, TASK = "Question: ", "Evidence:", "Write the answer with [E#] citations. If evidence is insufficient, say so."


def prompts(queries: DataFrame, found: DataFrame, top: int = 6) -> DataFrame:
    """(query_id, prompt, prompt_tokens): the question with its evidence for a language model; queries without evidence have none.

    ``queries`` has (query_id, text); ``found`` (query_id, rank, evidence_id, id, text, page, section, score).
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    head = F.concat(F.lit("["), F.col("evidence_id"), F.lit("] chunk_id="), F.col("id"), F.lit(" page="), word("page"), F.lit(" section="), word("section"), F.lit(" score="), F.format_string("%.4f", F.col("score")))
    told = F.concat(head, F.lit("\n"), F.col("text"), F.lit("\n"))
    lists = found.where(F.col("rank") <= top).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", told.alias("t")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["t"]), "\n")
    prompt = F.concat_ws("\n", F.concat(F.lit(QUESTION), F.coalesce("text", F.lit(""))), F.lit(""), F.lit(EVIDENCE), body, F.lit(TASK))
    out = queries.select("query_id", "text").join(lists, "query_id").select("query_id", prompt.alias("prompt"))
    return out.withColumn("prompt_tokens", token_estimate(F.col("prompt")))


def bundles(queries: DataFrame, found: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """Answers with what stands behind them: (query_id, answer, mode, citations_used, invalid_citations, grounded, evidence).

    ``answered`` (query_id, answer) are a model's answers, else they are extractive. An answer is grounded if it cites
    and all it cites is there; marks of evidence that is not there are named at the end of a model's answer.
    """
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "evidence_id", "id", "text"))).alias("evidence"))
    mode, rows = ("extractive", extractive(queries, found).select("query_id", "answer")) if answered is None else ("llm", answered)
    rows = rows.join(lists, "query_id", "left")
    valid = F.coalesce(F.transform("evidence", lambda e: e["evidence_id"]), F.array().cast("array<string>"))
    used, invalid = citations(F.col("answer"), valid)
    rows = rows.select("query_id", "answer", F.lit(mode).alias("mode"), used.alias("citations_used"), invalid.alias("invalid_citations"), "evidence")
    note = F.when((F.size("invalid_citations") > 0) & (F.col("mode") == "llm"), F.concat(F.lit("\n\n[Validation] Dropped/unknown citations: "), F.array_join("invalid_citations", ", "))).otherwise("")
    grounded = (F.size("citations_used") > 0) & (F.size("invalid_citations") == 0)
    return rows.select("query_id", F.concat("answer", note).alias("answer"), "mode", "citations_used", "invalid_citations", grounded.alias("grounded"), "evidence")
