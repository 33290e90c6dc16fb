"""The stored index of the searched texts: items with all that channels and ranking read, term counts, vectors, features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.text import normalize_text, tokens_of, written_dates
from chartloom.operators import ranking, search
from chartloom.operators.chunking import section_texts
from chartloom.operators.planning import SECTION_HINTS
from chartloom.operators.structure import ICD, ROW, SIGNED, latest_encounters
from chartloom.session import once, store, table

PARTS = ("items", "terms", "vectors", "features")


class Index:
    """Stored tables of one corpus. Queries join them and never tokenise the corpus again.

    A part is a table, or a function that builds it: such a part is built when it is first asked for.
    """

    def __init__(self, *parts: DataFrame | Callable[[], DataFrame]):
        self._parts = dict(zip(PARTS, parts, strict=True))

    def _part(self, name: str) -> DataFrame:
        if not isinstance(self._parts[name], DataFrame):
            self._parts[name] = self._parts[name]()
        return self._parts[name]

    items = property(lambda self: self._part("items"))
    terms = property(lambda self: self._part("terms"))
    vectors = property(lambda self: self._part("vectors"))
    features = property(lambda self: self._part("features"))

    def built(self) -> list[DataFrame]:
        return [p for p in self._parts.values() if isinstance(p, DataFrame)]


def items_of(chunks: DataFrame, pages: DataFrame, encounters: DataFrame) -> DataFrame:
    """The sections of all charts as items: ids, text in its forms, dates, codes, rows of results, signature."""
    texts = once(section_texts(chunks, pages), norm=normalize_text(F.col("text")))
    kinds = latest_encounters(encounters).select("document_id", "encounter_id", "encounter_type")
    grp = F.coalesce("encounter_id", F.concat(F.lit("page_"), F.col("page_start").cast("string")))
    iso = F.when(F.col("encounter_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.array("encounter_date")).otherwise(F.array().cast("array<string>"))
    return texts.join(kinds, ["document_id", "encounter_id"], "left").select(
        F.col("chunk_id").alias("id"), "document_id", grp.alias("grp"), "key", "section", F.lit("section").alias("chunk_type"), F.lit(None).cast("string").alias("table_type"),
        "page_start", "page_end", "encounter_id", "encounter_type", F.get(iso, F.lit(0)).alias("day"), "provider", "text", "norm", tokens_of(F.col("norm")).alias("tokens"), ranking.head(F.col("norm")).alias("head"),
        F.array_sort(F.array_union(written_dates(F.col("text")), iso)).alias("dates"), F.array_distinct(F.regexp_extract_all("text", F.lit("(?=[A-TV-Z])" + ICD), F.lit(1))).alias("codes"),
        F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(ROW))).alias("lab_rows"), (F.col("text").contains("igned by ") & F.col("text").rlike(SIGNED)).alias("signed"),
    )


def postings_on(items: DataFrame, medications: DataFrame) -> DataFrame:
    """(id, drug, n): postings of a medication on the pages of each item."""
    pages = items.select("id", "document_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    placed = medications.select(F.lower(F.trim("medication")).alias("drug"), "document_id", F.col("page_start").alias("page_number")).where("drug <> ''")
    return placed.join(pages, ["document_id", "page_number"]).groupBy("id", "drug").agg(F.count("*").alias("n"))


def item_features(items: DataFrame, medications: DataFrame) -> DataFrame:
    """What the structured channel knows of an item: (id, feature, amount). Each row of a kind adds its amount."""
    low = F.lower("section")
    sections = F.array_compact(F.array(*(F.when(low.contains(s.replace("_", " ")) | low.contains(s), F.lit(f"k:{s}")) for s in SECTION_HINTS)))
    one = lambda name, amount, when: F.when(when, F.struct(F.lit(name).alias("feature"), amount.cast("double").alias("amount")))
    many = lambda c, amount: F.transform(c, lambda f: F.struct(f.alias("feature"), F.lit(amount).alias("amount")))
    day = F.col("day")
    own = F.flatten(F.array(
        many(sections, 1.0), many(F.transform("codes", lambda c: F.concat(F.lit("c:"), c)), 2.5),
        F.array_compact(F.array(
            F.when(day.isNotNull(), F.struct(F.concat(F.lit("d:"), day).alias("feature"), F.when(F.col("signed"), 7.0).otherwise(3.0).alias("amount"))),
            F.when(day.isNotNull(), F.struct(F.concat(F.lit("m:"), F.substring(day, 1, 7)).alias("feature"), F.lit(2.5).alias("amount"))),
            F.when(F.col("provider").isNotNull(), F.struct(F.concat(F.lit("p:"), F.lower("provider")).alias("feature"), F.lit(2.0).alias("amount"))),
            one("t:signature", F.lit(1.5), F.col("signed")), one("t:laboratory_results", F.col("lab_rows") * 0.8, F.col("lab_rows") > 0),
        )),
    ))
    rows = items.select("id", F.explode(own).alias("f")).select("id", "f.*")
    posted = postings_on(items, medications)
    drugs = posted.select("id", F.concat(F.lit("x:"), "drug").alias("feature"), (F.col("n") * 2.0).alias("amount"))
    kinds = posted.groupBy("id").agg((F.sum("n") * 0.5).alias("amount")).select("id", F.explode(F.array(F.lit("t:medications"), F.lit("t:plan"))).alias("feature"), "amount")
    return rows.unionByName(drugs).unionByName(kinds)


def query_features(plans: DataFrame) -> DataFrame:
    """The features a planned query asks for: (query_id, feature, amount)."""
    tag = lambda name, c: F.transform(c, lambda x: F.concat(F.lit(name), x))
    typed = F.filter("sections", lambda s: s.isin("signature", "laboratory_results", "medications", "plan"))
    dated = F.transform("dates", lambda d: F.concat(F.when(F.length(d) == 10, F.lit("d:")).otherwise(F.lit("m:")), d))
    every = F.array_distinct(F.concat(tag("k:", F.col("sections")), tag("t:", typed), dated, tag("x:", F.col("medications")), tag("c:", F.transform("codes", lambda c: F.upper(c))), tag("p:", F.transform("providers", lambda p: F.lower(p)))))
    return plans.select("query_id", F.explode(every).alias("feature")).withColumn("amount", F.lit(1.0))


def build(spark: SparkSession, data_dir: str) -> Index:
    """The index of a data directory; each of its tables is stored under the session's shared folder when it is first needed."""
    words = lambda: found.items.select("id", "tokens")
    found = Index(
        lambda: store(items_of(*(table(spark, data_dir, t) for t in ("chunks", "page_content", "encounters")))),
        lambda: store(search.term_counts(words())), lambda: store(search.hashed_vectors(words())),
        lambda: store(search.weighted_features(item_features(found.items, table(spark, data_dir, "medications")), "id")),
    )
    return found


def save(index: Index, path: str) -> None:
    """Write an index to a folder; one that is there is replaced."""
    for part in PARTS:
        getattr(index, part).write.mode("overwrite").parquet(f"{path}/{part}")


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{part}") for part in PARTS))


def _state(spark: SparkSession, data_dir: str) -> tuple:
    """Sizes and times of the tables that an index is built from."""
    out = []
    for name in ("chunks", "page_content", "encounters", "medications"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{data_dir}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out.append((fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def _there(spark: SparkSession, index: Index) -> bool:
    """Whether the index's tables still exist: the shared folder may have been cleaned."""
    for part in index.built():
        for file in part.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                return False
    return True


def stored(spark: SparkSession, data_dir: str) -> Index:
    """The index of a data directory, built once in an application for as long as its tables stay the same."""
    kept = spark.sparkContext.__dict__.setdefault("_chartloom_indexes", {})
    key = (data_dir, _state(spark, data_dir))
    if key not in kept or not _there(spark, kept[key]):
        kept[key] = build(spark, data_dir)
    return kept[key]
