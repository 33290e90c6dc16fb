"""Chunks of charts: texts, fixed-size pieces, compounds, headers, neighbours, deduplication, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartloom.functions.text import clip, long_date
from chartloom.operators.order import ordinals
from chartloom.operators.pages import latest_pages
from chartloom.operators.facts import section_facts
from chartloom.operators.structure import HEADINGS, encounter_of_page, latest_encounters
from chartloom.session import cut

# The sections of an encounter's key facts in the order in which they are told, with their budgets, and the
# sections of the three compounds with theirs.
KEY_FACTS = [
    ("vitals", 400), ("laboratory_results", 600), ("assessment", 700), ("plan", 1100), ("imaging_orders", 700), ("laboratory_orders", 600),
    ("referrals", 400), ("follow_up", 500), ("signature", 200), ("clinical_notes", 350), ("subjective", 250), ("objective", 250),
]
LAB_COMPOUND = {"laboratory_results": 700, "assessment": 700, "plan": 1600}
IMAGING_COMPOUND = {"imaging_orders": 900, "follow_up": 700, "plan": 500}
ORDER_COMPOUND = {"plan": 1400, "laboratory_orders": 900}
SUMMARY, SECTION, OVERLAP, PAGE_LEAST, VISUAL = 4500, 2200, 180, 80, 800


def canonical_key(section: Column) -> Column:
    """The key of a section's name: that of its heading where it is a known one, else the name in snake case."""
    plain = F.regexp_replace(F.lower(F.trim(section)), r"\s+", " ")
    known = F.create_map(*(F.lit(x) for key, heading in HEADINGS for x in (heading, key)))
    return F.coalesce(F.try_element_at(known, plain), F.replace(plain, F.lit(" "), F.lit("_")))


def pieces(text: Column, most: int = 1200, overlap: int = 120) -> Column:
    """A text in pieces of at most ``most`` characters that overlap, cut after a line or sentence in the last 60 %.

    Pieces are trimmed and empty ones dropped; null and blank texts give none. Sequential by nature, so it is an
    aggregate over the array of possible steps, inside the JVM.
    """
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    steps = F.greatest(F.lit(1), F.ceil(size / (most * 0.4 - overlap)).cast("int"))
    last = lambda s, mark: F.when(F.instr(s, mark) > 0, F.length(s) - F.locate(mark[::-1], F.reverse(s)) - len(mark) + 1).otherwise(-1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        rest = size - acc["at"]
        window = F.substring(text, acc["at"] + 1, F.lit(most))
        cut = F.greatest(last(window, "\n"), last(window, ". "))
        end = F.when((rest > most) & (cut > most * 0.4), acc["at"] + cut + 1).otherwise(F.least(size, acc["at"] + most))
        piece = F.regexp_replace(F.substring(text, acc["at"] + 1, end - acc["at"]), r"^\s+|\s+$", "")
        return F.when(acc["done"], acc).otherwise(
            F.struct(
                F.greatest(F.lit(0), end - overlap).cast("int").alias("at"), (end >= size).alias("done"),
                F.when(piece != "", F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
            )
        )

    if most * 0.4 <= overlap:
        raise ValueError("the overlap must be less than 0.4 of the piece size")
    return F.aggregate(F.sequence(F.lit(1), steps), start, step)["out"]


def section_texts(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Section rows with ``text`` (their pages' clean_text joined by line breaks) and ``key``, the section's canonical key."""
    own = chunks.where("chunk_type = 'section' and page_start <= page_end")
    spread = own.select("chunk_id", "document_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    texts = latest_pages(pages.select("document_id", "page_number", "clean_text", "loaded_at")).where("clean_text <> ''")
    joined = (
        spread.join(texts, ["document_id", "page_number"]).groupBy("chunk_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "clean_text"))), lambda s: s["clean_text"]), "\n").alias("text"))
    )
    key = canonical_key(F.col("section"))
    return own.join(joined, "chunk_id").select(
        "chunk_id", "document_id", "encounter_id", "section", key.alias("key"), "page_start", "page_end", "encounter_date", "provider", "text"
    )


def longest_sections(texts: DataFrame) -> DataFrame:
    """The longest section of each (document_id, encounter_id, key); the lowest chunk_id of equals."""
    best = F.struct(F.col("text").alias("text"), F.col("chunk_id").alias("c"), F.col("page_start").alias("a"), F.col("page_end").alias("b"), F.col("section").alias("section"))
    order = F.struct((-F.length("text")).alias("n"), F.col("chunk_id"))
    return (
        texts.where("key is not null and encounter_id is not null").groupBy("document_id", "encounter_id", "key").agg(F.min_by(best, order).alias("s"))
        .select("document_id", "encounter_id", "key", F.col("s.c").alias("chunk_id"), F.col("s.a").alias("page_start"), F.col("s.b").alias("page_end"), F.col("s.section").alias("section"), F.col("s.text").alias("text"))
    )


def compounds(texts: DataFrame, parts: dict[str, int], least: int = 2, needed: list[list[str]] | None = None, about: DataFrame | None = None) -> DataFrame:
    """One text per encounter from its sections ``parts`` (key -> character limit), each under its heading.

    At least ``least`` of the parts must exist, and of each group in ``needed`` one. With ``about`` (encounters) the text
    begins with the encounter's id, type, date and provider.
    """
    best = longest_sections(texts).where(F.col("key").isin(*parts))
    told = F.concat(F.lit("["), F.coalesce("section", "key"), F.lit("]\n"), F.coalesce(*(F.when(F.col("key") == k, clip(F.col("text"), n)) for k, n in parts.items())))
    order = F.coalesce(*(F.when(F.col("key") == k, i) for i, k in enumerate(parts)))
    wide = best.groupBy("document_id", "encounter_id").agg(
        F.count("*").alias("parts"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), told.alias("t")))).alias("told"), F.collect_set("key").alias("keys"),
    )
    wide = wide.where(F.col("parts") >= least)
    for group in needed or []:
        wide = wide.where(F.arrays_overlap("keys", F.array(*map(F.lit, group))))
    lines = F.transform("told", lambda t: t["t"])
    if about is not None:
        who = latest_encounters(about).select("document_id", "encounter_id", "encounter_type", "encounter_date", "provider")
        head = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("Unknown")))
        wide = wide.join(who, ["document_id", "encounter_id"], "left")
        lines = F.concat(F.array(F.concat(F.lit("Encounter "), F.col("encounter_id")), head("Type", F.col("encounter_type")), head("Date", F.col("encounter_date")), head("Provider", F.col("provider"))), lines)
    return wide.select("document_id", "encounter_id", "parts", "page_start", "page_end", F.array_join(lines, "\n\n").alias("text"))


def key_facts(texts: DataFrame, encounters: DataFrame, most: int = SUMMARY) -> DataFrame:
    """The key facts of each encounter: what it is, then its sections in a fixed order, each within its budget, ``most`` characters in all."""
    facts = compounds(texts, dict(KEY_FACTS), least=1, about=encounters)
    return facts.withColumn("text", F.substring("text", 1, most))


def combined_history(facts: DataFrame, least: int = 2, first_pages: int = 3) -> DataFrame:
    """The surgical history of a chart in one text, from the facts on its first pages, where there are ``least`` or more."""
    own = facts.where((F.col("table_type") == "surgical_history") & (F.col("page_start") <= first_pages))
    told = F.array_sort(F.collect_list(F.struct("page_start", "chunk_id", "fact_no", "raw_text")))
    return own.groupBy("document_id").agg(told.alias("told"), F.count("*").alias("parts")).where(F.col("parts") >= least).select(
        "document_id", F.array_join(F.transform("told", lambda t: t["raw_text"]), "; ").alias("text"), "parts"
    )


def build_chunks(chunks: DataFrame, pages: DataFrame, encounters: DataFrame) -> DataFrame:
    """All chunks of all charts, from their sections, pages and encounters, numbered and linked.

    Columns: chunk_id, document_id, encounter_id, chunk_type (atomic, section, compound, encounter_key_facts, page,
    page_visual), table_type, section, page_start, page_end, raw_text, retrieval_text (its context lines and the text),
    previous_id, next_id. Of chunks of a chart with the same first page and first 500 characters the first one stays.
    """
    texts = section_texts(chunks, pages)
    facts = cut(section_facts(texts))
    none = F.lit(None).cast("string")

    def branch(rows: DataFrame, rank: int, kind: str, section: Column, text: Column, prefix: str, table_type: Column = none, order: Column = F.lit("")) -> DataFrame:
        return rows.select(
            "document_id", "encounter_id", F.lit(rank).alias("branch"), F.lit(kind).alias("chunk_type"), table_type.alias("table_type"), section.alias("section"),
            F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"), order.alias("order"), text.alias("raw_text"), F.lit(prefix).alias("prefix"),
        )

    at = lambda *c: F.concat_ws("/", *(F.lpad(F.col(x).cast("string"), 12, "0") for x in c))
    longer = F.when(F.length("search_text") >= F.length("raw_text"), F.col("search_text")).otherwise(F.col("raw_text"))
    atomic = branch(facts, 0, "atomic", F.col("key"), longer, "ATOMIC", F.col("table_type"), at("chunk_id", "fact_no"))
    history = combined_history(facts).withColumns({"encounter_id": none, "page_start": F.lit(2), "page_end": F.lit(2)})
    history = branch(history, 1, "atomic", F.lit("surgical_history"), F.col("text"), "ATOMIC", F.lit("surgical_history"))
    cut_up = texts.select("document_id", "encounter_id", "chunk_id", "section", "page_start", "page_end", F.posexplode(pieces(F.col("text"), SECTION, OVERLAP)).alias("pos", "piece"))
    sections = branch(cut_up, 2, "section", F.col("section"), F.col("piece"), "SECTION", order=at("chunk_id", "pos"))
    made = (
        ("lab_assessment_plan", compounds(texts, LAB_COMPOUND, 2, about=encounters)),
        ("imaging_followup", compounds(texts, IMAGING_COMPOUND, 2, [["imaging_orders"], ["follow_up", "plan"]], encounters)),
        ("plan_lab_orders", compounds(texts, ORDER_COMPOUND, 2, about=encounters)),
    )
    grouped = [branch(rows, 3 + i, "compound", F.lit(name), F.col("text"), "COMPOUND", order=F.col("encounter_id")) for i, (name, rows) in enumerate(made)]
    summary = branch(key_facts(texts, encounters), 6, "encounter_key_facts", F.lit("encounter_key_facts"), F.col("text"), "ENCKEY", order=F.col("encounter_id"))
    every = latest_pages(pages).where("clean_text is not null").join(encounter_of_page(pages, encounters), ["document_id", "page_number"], "left")
    every = every.select("document_id", "encounter_id", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), "clean_text")
    covered = atomic.unionByName(sections).unionByName(summary)
    for rows in grouped:
        covered = covered.unionByName(rows)
    covered = covered.select("document_id", F.explode(F.sequence("page_start", "page_end")).alias("page_start")).distinct()
    bare = every.where(F.length("clean_text") >= PAGE_LEAST).join(covered, ["document_id", "page_start"], "left_anti")
    bare = bare.select("document_id", "encounter_id", "page_start", "page_end", F.posexplode(pieces(F.col("clean_text"), SECTION, OVERLAP)).alias("pos", "piece"))
    fallback = branch(bare, 7, "page", F.lit("page"), F.col("piece"), "PAGE", order=at("page_start", "pos"))
    visual = branch(every, 8, "page_visual", F.lit("page_visual"), F.left("clean_text", F.lit(VISUAL)), "VISUAL", order=at("page_start"))
    out = atomic
    for rows in (history, sections, *grouped, summary, fallback, visual):
        out = out.unionByName(rows)
    first = ["branch", "order", "page_start"]
    out = out.where("document_id is not null and raw_text <> ''").groupBy("document_id", "page_start", F.substring("raw_text", 1, 500).alias("_head")).agg(
        F.min_by(F.struct(*(c for c in out.columns if c not in ("document_id", "page_start"))), F.struct(*first)).alias("c")
    ).select("document_id", "page_start", "c.*")
    numbered = cut(ordinals(out, ["document_id"], [*first, "chunk_type"]))
    code = F.concat_ws("_", F.replace("document_id", F.lit("-"), F.lit("")), F.col("prefix"), F.lpad(F.col("ordinal").cast("string"), 5, "0"))
    numbered = numbered.withColumn("chunk_id", code)
    side = lambda by, name: numbered.select("document_id", (F.col("ordinal") + by).alias("ordinal"), F.col("chunk_id").alias(name))
    linked = numbered.join(side(1, "previous_id"), ["document_id", "ordinal"], "left").join(side(-1, "next_id"), ["document_id", "ordinal"], "left")
    linked = linked.withColumn("provider", none)
    return linked.join(headers(linked, encounters), "chunk_id").select(
        "chunk_id", "document_id", "encounter_id", "chunk_type", "table_type", "section", "page_start", "page_end", "raw_text",
        F.concat_ws("\n\n", "header", "raw_text").alias("retrieval_text"), "previous_id", "next_id",
    )


def uncovered_pages(chunks: DataFrame, pages: DataFrame, least: int = 80) -> DataFrame:
    """Pages with at least ``least`` characters that no chunk of the chart covers."""
    covered = chunks.where("page_start <= page_end").select("document_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number")).distinct()
    own = latest_pages(pages).where(F.length("clean_text") >= least)
    return own.join(covered, ["document_id", "page_number"], "left_anti").select("document_id", "page_number", F.length("clean_text").alias("characters"))


def neighbours(chunks: DataFrame) -> DataFrame:
    """Each chunk with the ids before and after it in build order: (chunk_id, previous_id, next_id)."""
    own = chunks.where("document_id is not null").select("document_id", "chunk_id", F.coalesce(F.regexp_extract("chunk_id", r"([0-9]+)$", 1).try_cast("bigint"), F.lit(0)).alias("n"))
    own = ordinals(own, ["document_id"], ["n", "chunk_id"])
    side = lambda by, name: own.select("document_id", (F.col("ordinal") + by).alias("ordinal"), F.col("chunk_id").alias(name))
    return (
        own.join(side(1, "previous_id"), ["document_id", "ordinal"], "left").join(side(-1, "next_id"), ["document_id", "ordinal"], "left")
        .select("chunk_id", "previous_id", "next_id")
    )


def unique_chunks(texts: DataFrame, characters: int | None = 500) -> DataFrame:
    """The first chunk of those with the same beginning, first page and chart; the whole texts are compared for None."""
    head = F.col("text") if characters is None else F.left("text", F.lit(characters))
    return texts.groupBy("document_id", "page_start", head.alias("head")).agg(
        F.min("chunk_id").alias("chunk_id"), F.count("*").alias("copies")
    ).select("chunk_id", "document_id", "page_start", "copies")


def headers(chunks: DataFrame, encounters: DataFrame) -> DataFrame:
    """The context lines of each chunk: encounter, type, date, provider, section, pages. Missing ones are left out."""
    enc = latest_encounters(encounters).select(
        "document_id", "encounter_id", "encounter_type", F.col("encounter_date").alias("enc_date"), F.col("provider").alias("enc_provider"), "facility"
    )
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c))
    span = F.when(F.col("page_start") == F.col("page_end"), F.concat(F.lit("Page: "), F.col("page_start").cast("string"))).otherwise(
        F.concat(F.lit("Pages: "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"))
    )
    text = F.concat_ws(
        "\n", line("Encounter", F.col("encounter_id")), line("Type", F.col("encounter_type")), F.concat(F.lit("Date: "), long_date(F.col("enc_date"))),
        line("Provider", F.coalesce("provider", "enc_provider")), line("Facility", F.col("facility")), line("Section", F.col("section")), span,
    )
    return chunks.join(enc, ["document_id", "encounter_id"], "left").select("chunk_id", text.alias("header"))


def chunk_boxes(texts: DataFrame, blocks: DataFrame, pages: DataFrame, most: int = 8, lines: int = 12, least: int = 12) -> DataFrame:
    """Where a chunk's text (chunk_id, document_id, page_start, page_end, text) stands: (chunk_id, box_no, page_number, box).

    A block fits if it holds one of the first ``lines`` lines of ``least`` characters or more, or the first 40 characters
    of a longer one, or is held by it; the first ``most`` distinct boxes (rounded to tenths) count, by line, page and
    reading order. Without any, the three largest blocks of the first page; without blocks, the whole first page.
    """
    wanted = texts.where("text is not null and document_id is not null")
    plain = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    needles = F.slice(F.filter(F.transform(F.split("text", "\n"), lambda x: F.lower(plain(x))), lambda x: F.length(x) >= least), 1, lines)
    needles = F.when(F.size(needles) > 0, needles).when(plain(F.col("text")) != "", F.array(F.lower(F.left(plain(F.col("text")), F.lit(80))))).otherwise(F.array().cast("array<string>"))
    wanted = wanted.select("chunk_id", "document_id", "page_start", "page_end", needles.alias("needles"))
    on = F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page_number")
    boxed = blocks.where("text <> '' and size(bbox) >= 4").select(
        "document_id", "page_number", "reading_order", F.lower("text").alias("low"), F.array_join(F.transform(F.slice("bbox", 1, 4), lambda x: F.format_string("%.1f", x)), ",").alias("box")
    )
    pairs = wanted.select("chunk_id", "document_id", "needles", on).join(boxed, ["document_id", "page_number"])
    low = F.col("low")
    fits = F.transform("needles", lambda n: low.contains(n) | n.contains(low) | ((F.length(n) > 20) & low.contains(F.left(n, F.lit(40)))))
    hits = pairs.withColumn("needle", F.array_position(fits, True)).where("needle > 0")
    hits = hits.groupBy("chunk_id", "page_number", "box").agg(F.min(F.struct("needle", "page_number", "reading_order")).alias("o"))
    order = W.partitionBy("chunk_id").orderBy("o", "box")
    found = hits.withColumn("box_no", F.row_number().over(order)).where(F.col("box_no") <= most).select("chunk_id", "box_no", "page_number", "box")
    missed = wanted.join(found.select("chunk_id").distinct(), "chunk_id", "left_anti")
    largest = missed.select("chunk_id", "document_id", F.col("page_start").alias("page_number")).join(boxed, ["document_id", "page_number"])
    size = W.partitionBy("chunk_id").orderBy(F.desc(F.length("low")), "reading_order", "box")
    largest = largest.withColumn("box_no", F.row_number().over(size)).where("box_no <= 3").select("chunk_id", "box_no", "page_number", "box")
    shape = latest_pages(pages).select("document_id", "page_number", F.format_string("0.0,0.0,%.1f,%.1f", F.coalesce("width", F.lit(0.0)), F.coalesce("height", F.lit(0.0))).alias("box"))
    boxless = missed.join(boxed.select("document_id", F.col("page_number").alias("page_start")).distinct(), ["document_id", "page_start"], "left_anti")
    whole = boxless.select("chunk_id", "document_id", F.col("page_start").alias("page_number")).join(shape, ["document_id", "page_number"]).select("chunk_id", F.lit(1).alias("box_no"), "page_number", "box")
    return found.unionByName(largest).unionByName(whole)
