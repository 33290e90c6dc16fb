"""Registered queries of the text-preparation operators, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.encode import encode_corpus
from chartloom.llm.mixing import mixture, mixture_shares
from chartloom.llm.pii import lexicon_names, pages_with_items, redacted
from chartloom.llm.repeats import repeated_lines, repeated_spans, without_repeats
from chartloom.llm.scans import repaired_pages, scan_traces
from chartloom.llm.splitting import split_sections
from chartloom.llm.truncation import truncated_texts, truncation_by_source
from chartloom.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with personal information, by kind."""
    return pages_with_items(*(table(spark, sf_dir, t) for t in ("page_content", "text_blocks", "name_lexicon")))


def p5_redacted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with placeholders in clean_text."""
    names = lexicon_names(table(spark, sf_dir, "name_lexicon"))
    return table(spark, sf_dir, "page_content").select("document_id", "page_number", redacted(F.col("clean_text"), names).alias("redacted"))


def p5_redacted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text blocks with placeholders."""
    names = lexicon_names(table(spark, sf_dir, "name_lexicon"))
    return table(spark, sf_dir, "text_blocks").select("document_id", "page_number", "block_id", redacted(F.col("text"), names).alias("redacted"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with traces of scanning."""
    return scan_traces(table(spark, sf_dir, "page_content")).select("document_id", "page_number")


def p1_repaired_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as continuous paragraphs."""
    return repaired_pages(table(spark, sf_dir, "page_content"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section rows whose text had to be split."""
    return split_sections(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "page_content")).where("piece_no = 2").select("chunk_id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized sections."""
    return split_sections(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "page_content"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that one chart repeats on at least a third of its pages."""
    return repeated_lines(table(spark, sf_dir, "text_blocks"), table(spark, sf_dir, "page_content"))


def p4_clean_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks without the lines that their chart repeats."""
    return without_repeats(table(spark, sf_dir, "text_blocks"), table(spark, sf_dir, "page_content"))


def p4_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of text that one chart repeats, whatever lines they begin and end in."""
    return repeated_spans(table(spark, sf_dir, "text_blocks"), table(spark, sf_dir, "page_content"))


def p7_mix_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    return mixture_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mix_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document in the mix."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncated_texts(table(spark, sf_dir, "documents")).where("cut").select("doc_id").distinct()


def p8_cut_share_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its texts."""
    return truncation_by_source(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_repaired_pages, p2_found, p2_pieces, p4_found, p4_clean_blocks, p4_repeated_spans, p5_found, p5_redacted_pages, p5_redacted_blocks, p6_ids, p7_mix_shares, p7_mix_copies, p8_found, p8_cut_share_by_source)}


#: Length of each section's text, by SQL.
P2_SQL = """
WITH pages AS (SELECT document_id, page_number, max(clean_text) AS clean_text FROM page_content WHERE clean_text <> '' GROUP BY 1, 2)
SELECT c.chunk_id FROM chunks c JOIN pages p ON p.document_id = c.document_id AND p.page_number BETWEEN c.page_start AND c.page_end
WHERE c.chunk_type = 'section' GROUP BY c.chunk_id HAVING sum(length(p.clean_text)) + count(*) - 1 > 2200
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL}
