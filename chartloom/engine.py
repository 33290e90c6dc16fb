"""The engine: one object over the tables of a data directory that retrieves, answers and reports for many queries at once."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import answers, evaluation, planning, ranking, search
from chartloom.operators.index import Index, query_features, stored
from chartloom.operators.jobs import state_counts
from chartloom.operators.pages import validation_report
from chartloom.session import cut, table


#: The channels of the hybrid search: which planned weight each has, times a factor.
CHANNELS = {"bm25": ("lexical", 1.0), "exact": ("lexical", 1.5), "structured": ("structured", 1.0), "dense": ("dense", 1.0)}
#: Hits of each channel that reach the fusion.
TOP = {"bm25": 60, "exact": 80, "structured": 40, "dense": 60}


class Engine:
    """Retrieval over the sections of all charts, for many queries at once.

    ``queries`` are tables (query_id, text). Settings are given per call and never shared between calls. The index is
    stored once for a data directory; another one (``index.load``) can be given.
    """

    def __init__(self, spark: SparkSession, data_dir: str, index: Index | None = None):
        self.spark, self.data_dir = spark, data_dir
        self.index = index or stored(spark, data_dir)

    @property
    def items(self) -> DataFrame:
        return self.index.items

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.data_dir, name)

    def plan(self, queries: DataFrame) -> DataFrame:
        return cut(planning.plan(queries, self.table("medications").select(F.col("medication").alias("name"))))

    def hits(self, channel: str, plans: DataFrame) -> DataFrame:
        """A channel's hits (query_id, id, score, rank)."""
        k = TOP[channel]
        if channel == "bm25":
            return search.bm25(self.items.select("id", "tokens"), plans.select("query_id", F.col("expanded").alias("text")), k, self.index.terms)
        if channel == "exact":
            return search.exact(self.items.select("id", "tokens"), plans.select("query_id", F.explode("needles").alias("needle")), k)
        if channel == "structured":
            return search.sparse(self.index.features, search.weighted_features(query_features(plans), "query_id"), k)
        asked = plans.select("query_id", F.col("expanded").alias("text"))
        return search.sparse(self.index.vectors, search.hashed_vectors(asked, "query_id", known=self.index.terms), k)

    def fuse(self, plans: DataFrame, hits: dict[str, DataFrame], settings: ranking.Settings = ranking.Settings()) -> DataFrame:
        weights = planning.channel_weights(plans, {c: CHANNELS[c] for c in hits})
        return ranking.fuse(hits, weights, settings.rrf_k, settings.fusion_top)

    def retrieve(self, queries: DataFrame, settings: ranking.Settings = ranking.Settings(), channels: tuple[str, ...] = tuple(CHANNELS)) -> DataFrame:
        """(query_id, rank, id, score, document_id, section, page_start, page_end, text) of the best sections."""
        plans = self.plan(queries)
        fused = self.fuse(plans, {c: self.hits(c, plans) for c in channels}, settings)
        found = ranking.final_ranking(fused, self.items, plans, settings)
        return found.join(self.items.select("id", "document_id", "section", "page_start", "page_end", "text"), "id")

    def answer(self, queries: DataFrame, settings: ranking.Settings = ranking.Settings()) -> DataFrame:
        """(query_id, answer, evidence, used, invalid): extractive answers with their citations checked."""
        found = cut(answers.evidence(self.retrieve(queries, settings)))
        valid = found.groupBy("query_id").agg(F.collect_set("evidence_id").alias("valid"))
        out = answers.extractive(queries, found).join(valid, "query_id", "left")
        used, invalid = answers.citations(F.col("answer"), F.coalesce("valid", F.array().cast("array<string>")))
        return out.select("query_id", "answer", "evidence", used.alias("used"), invalid.alias("invalid"))

    def evaluate(self, queries: DataFrame, gold: DataFrame) -> DataFrame:
        """One row of quality figures; ``gold`` has (query_id, id)."""
        return evaluation.quality(evaluation.first_match(self.retrieve(queries), gold, queries))

    def status(self) -> DataFrame:
        """Jobs by state."""
        return state_counts(self.table("ingest_jobs"))

    def readability(self) -> DataFrame:
        return validation_report(self.table("page_content"))


def main(args: list[str] | None = None) -> None:
    """``python -m chartloom.engine DIR retrieve|answer|status|readability [--query TEXT]``"""
    parser = argparse.ArgumentParser(prog="chartloom")
    parser.add_argument("data_dir")
    parser.add_argument("command", choices=["retrieve", "answer", "status", "readability"])
    parser.add_argument("--query", action="append", default=[])
    parser.add_argument("--top", type=int, default=10)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("chartloom").getOrCreate()
    engine = Engine(spark, given.data_dir)
    if given.command in ("status", "readability"):
        getattr(engine, given.command)().show(100, truncate=120)
        return
    queries = spark.createDataFrame(list(enumerate(given.query)), "query_id long, text string")
    getattr(engine, given.command)(queries, ranking.Settings(top=given.top)).orderBy("query_id").show(100, truncate=120)


if __name__ == "__main__":
    main()
