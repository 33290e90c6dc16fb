"""Sources and sinks: charts' records as JSON lines, tables of the index, binary files, gold sets, reports."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.session import ship

# Record schemas, as DDL, by the names of the records.
BOX = "page int, x0 double, y0 double, x1 double, y1 double"
BLOCK = "block_id string, text string, bbox array<double>, reading_order int, font_size double, is_bold boolean, block_type string"
REPORT = "filename string, sha256 string, page_count int, is_encrypted boolean, contains_text boolean, ocr_required_pages array<int>, processing_version string, timestamp string, corrupted_pages array<int>"
ENCOUNTER = "encounter_id string, encounter_number int, encounter_type string, encounter_date string, provider string, facility string, start_page int, end_page int"
SECTION = f"section string, section_heading string, encounter_id string, start_page int, end_page int, text string, char_start int, char_end int, bbox struct<{BOX.replace(' ', ':').replace(',:', ', ')}>"
CHUNK = "chunk_id string, document_id string, encounter_id string, chunk_type string, table_type string, section string, page_start int, page_end int, raw_text string, retrieval_text string, previous_id string, next_id string"
RESULT = "query_id string, rank int, chunk_id string, score double, content string"
PAGE = "document_id string, page_number int, width double, height double, text string, clean_text string, char_count int, ocr_required boolean"
GOLD = "query_id string, query string, expected_pages string, ground_truth_evidence string, category string, source_document string"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines with a fixed schema; broken lines give rows of nulls."""
    return spark.read.schema(schema).json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A gold set kept as one JSON array."""
    return spark.read.schema(GOLD).option("multiLine", True).json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records kept as one JSON array; a missing file gives an empty table."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Rows (term, alias) of a lexicon, a JSON file {"aliases": {term: [alias, ...]}}; a missing file gives none."""
    pairs = [(term, alias) for term, names in (read_settings(path).get("aliases") or {}).items() for alias in names or []]
    return spark.createDataFrame(pairs, "term string, alias string")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV files with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_postings(df: DataFrame, path: str, kind: str = "kind") -> None:
    """Postings partitioned by their kind, so that a reader of one kind reads its files only."""
    df.write.mode("overwrite").partitionBy(kind).parquet(path)


def read_postings(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("kind") == kind)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Binary files with their digest: (path, length, modified, sha256, content)."""
    ship(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")


def extract(contents: DataFrame, provider: Callable[[bytes], list[dict]]) -> DataFrame:
    """Pages of binary files by a provider: bytes -> page records (page_number, width, height, text).

    A file that the provider cannot read gives one row with page_number 0 and null text, so that it is not lost.
    """

    def pages(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    found = provider(content)
                except Exception:
                    found = [{"page_number": 0, "text": None}]
                rows += [(path, int(p["page_number"]), p.get("width"), p.get("height"), p.get("text")) for p in found]
            yield pd.DataFrame(rows, columns=["path", "page_number", "width", "height", "text"])

    return contents.select("path", "content").mapInPandas(pages, "path string, page_number int, width double, height double, text string")


def plain_text_pages(content: bytes) -> list[dict]:
    """The built-in provider: UTF-8 text with form feeds between pages."""
    return [{"page_number": i + 1, "text": t} for i, t in enumerate(content.decode("utf-8").split("\f"))]


def read_settings(path: str) -> dict:
    """Settings from a JSON file; a missing one gives none."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {}
