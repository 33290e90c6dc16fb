"""Page operators: latest copies, validation report, running lines, cleaning, block types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import needs_ocr

# Lines that are furniture on any page, in lower case; the last two are those of the charts of this project.
ALWAYS_FURNITURE = [
    r"^patient:\s*.+\|\s*id:\s*pt-\d+",
    r"^synthetic data",
    r"^confidential",
    r"^generated:\s*\d{4}-\d{2}-\d{2}",
    r"^page\s+\d+\s*(?:of\s+\d+)?$",
    r"^-\s*\d+\s*-$",
    r"^printed\s+\d{4}-\d{2}-\d{2}.*$",
]


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row per page: the copy loaded last (ties by text). Pages without chart or number are left out."""
    keys = ["document_id", "page_number"]
    rest = [c for c in pages.columns if c not in (*keys, "loaded_at")]
    newest = F.struct(F.col("loaded_at"), F.coalesce("clean_text", F.lit("")).alias("t"))
    return (
        pages.where("document_id is not null and page_number is not null")
        .groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("p")).select(*keys, "p.*")
    )


def validation_report(pages: DataFrame, least: int = 40) -> DataFrame:
    """Per chart: pages, pages with text, numbers of the pages that need recognition, and of unreadable (null) pages."""
    poor = needs_ocr(F.col("text"), least)
    return latest_pages(pages).groupBy("document_id").agg(
        F.count("*").alias("page_count"),
        F.count_if(~poor).alias("pages_with_text"),
        F.sort_array(F.collect_list(F.when(poor, F.col("page_number")))).alias("ocr_pages"),
        F.sort_array(F.collect_list(F.when(F.col("text").isNull(), F.col("page_number")))).alias("unreadable_pages"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"),
    )


def ingest_summary(pages: DataFrame, blocks: DataFrame, chunks: DataFrame, encounters: DataFrame, least: int = 40) -> DataFrame:
    """One row of counts over all charts: charts, pages, pages that need recognition, encounters, sections, chunks, blocks with a box."""
    own = latest_pages(pages).agg(F.count_distinct("document_id").alias("charts"), F.count("*").alias("pages"), F.count_if(needs_ocr(F.col("text"), least)).alias("ocr_needed"))
    visits = encounters.where("document_id is not null and encounter_id is not null").select("document_id", "encounter_id").distinct().agg(F.count("*").alias("encounters"))
    parts = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("chunk_type") == "section").alias("sections"))
    boxes = blocks.agg(F.count("*").alias("blocks"), F.count_if(F.size("bbox") >= 4).alias("blocks_with_box"))
    return own.crossJoin(visits).crossJoin(parts).crossJoin(boxes)  # one row each


def masked_line(line: Column) -> Column:
    """Lower case, digit runs as #, single blanks."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"\d+", "#"), r"\s+", " ")))


def edge_lines(text: Column, head: int = 6, tail: int = 4) -> Column:
    """The first and last lines of a page that are not blank; a short page gives its lines twice."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.concat(F.slice(lines, 1, head), F.slice(lines, F.greatest(F.lit(1), F.size(lines) - tail + 1), tail))


def repeated_edge_lines(pages: DataFrame, share: float = 0.2) -> DataFrame:
    """(document_id, line, copies): masked edge lines standing on at least ``share`` of the chart's pages."""
    own = latest_pages(pages).select("document_id", "page_number", "text")
    sizes = own.groupBy("document_id").agg(F.count("*").alias("pages"))
    counts = (
        own.select("document_id", F.explode(edge_lines(F.col("text"))).alias("x")).select("document_id", masked_line(F.col("x")).alias("line"))
        .groupBy("document_id", "line").agg(F.count("*").alias("copies"))
    )
    return counts.join(sizes, "document_id").where(F.col("copies") / F.col("pages") >= share).select("document_id", "line", "copies")


def is_always_furniture(line: Column) -> Column:
    """Whether a trimmed line is a page number or notice wherever it stands."""
    out = F.lit(False)
    for pattern in ALWAYS_FURNITURE:
        out = out | F.lower(F.trim(line)).rlike(pattern)
    return out


def clean_pages(pages: DataFrame, share: float = 0.2) -> DataFrame:
    """(document_id, page_number, cleaned): page text without furniture, blank runs as one, trimmed at the ends.

    Pages with null text have an empty ``cleaned``.
    """
    own = latest_pages(pages).select("document_id", "page_number", "text")
    repeated = repeated_edge_lines(pages, share).groupBy("document_id").agg(F.collect_set("line").alias("repeated"))
    kept = F.filter(
        F.split(F.coalesce("text", F.lit("")), "\n"),
        lambda x: (F.trim(x) == "") | ~(is_always_furniture(x) | F.coalesce(F.array_contains("repeated", masked_line(x)), F.lit(False))),
    )
    joined = F.array_join(F.transform(kept, lambda x: F.rtrim(x)), "\n")
    return own.join(repeated, "document_id", "left").select(
        "document_id", "page_number", F.btrim(F.regexp_replace(joined, r"\n{3,}", "\n\n"), F.lit(" \n")).alias("cleaned")
    )


def block_kinds(blocks: DataFrame, pages: DataFrame, share: float = 0.2, top: float = 0.15) -> DataFrame:
    """Blocks whose first line is furniture: header if they start in the top ``top`` of the page, else footer.

    (document_id, page_number, block_id, kind). Blocks without a box count as footers; null texts give no row.
    """
    repeated = repeated_edge_lines(pages, share).select("document_id", "line", F.lit(True).alias("repeated"))
    heights = latest_pages(pages).select("document_id", "page_number", "height")
    first = F.trim(F.substring_index(F.col("text"), "\n", 1))
    own = blocks.where(F.col("text").isNotNull()).select("document_id", "page_number", "block_id", "bbox", first.alias("first")).withColumn("line", masked_line(F.col("first")))
    return (
        own.join(repeated, ["document_id", "line"], "left")
        .where((F.col("first") != "") & (F.col("repeated") | is_always_furniture(F.col("first"))))
        .join(heights, ["document_id", "page_number"], "left")
        .select("document_id", "page_number", "block_id", F.when(F.get("bbox", F.lit(1)) < F.col("height") * top, "header").otherwise("footer").alias("kind"))
        .distinct()
    )


def block_profile(blocks: DataFrame) -> DataFrame:
    """Per chart and written type: blocks, mean font size, bold blocks, lines."""
    return blocks.groupBy("document_id", F.coalesce("block_type", F.lit("unknown")).alias("block_type")).agg(
        F.count("*").alias("blocks"),
        F.round(F.avg("font_size"), 6).alias("mean_font_size"),
        F.count_if("is_bold").alias("bold_blocks"),
        F.coalesce(F.sum(F.size(F.split("text", "\n"))), F.lit(0)).cast("bigint").alias("lines"),
    )
