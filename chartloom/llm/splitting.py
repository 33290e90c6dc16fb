"""Splitting of oversized sections at natural boundaries (problem 2).

Sections are put together from their pages in blocks of bounded length, so no task holds more than a block however
long a section is; the seam between two blocks lies at a valley that both find in the same text. Inside a block, the similarity of the words before and after each sentence end gives a curve
whose valleys are topic boundaries; each piece ends at the deepest valley its size window allows, and the next one
starts a fixed overlap earlier.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.session import broadcast_if_small, cut

LIMIT, OVERLAP = 2200, 180
#: Characters of a section that one call cuts; a section's pages are grouped so that a block exceeds it by a page at most.
BLOCK = 60_000
#: Sentences on either side of a boundary whose words are compared.
SIDE = 4
_BOUNDARY = re.compile(r"\n\s*\n|\n|(?<=[.!?])[ \t]+(?=[^\s])|;[ \t]+")
_WORD = re.compile(r"[^\W\d_]{3,}")


def _boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets at which a piece may end, and their rank: 0 paragraph, 1 line or sentence, 2 clause."""
    at, rank = [], []
    for m in _BOUNDARY.finditer(text):
        mark = m.group()
        at.append(m.end())
        rank.append(0 if mark.count("\n") > 1 else 2 if mark[0] == ";" else 1)
    return np.array(at, dtype=np.int64), np.array(rank, dtype=np.int64)


def _depths(text: str, at: np.ndarray) -> np.ndarray:
    """Depth of the similarity valley at each boundary: how far both neighbouring peaks rise above it.

    Two windows of SIDE sentences slide along the text; a word that enters or leaves one changes the dot product of
    the two and their norms, so no vector of the whole vocabulary is built.
    """
    n = len(at)
    if n == 0:
        return np.zeros(0)
    lower = text.lower()
    words: list[list[str]] = [[] for _ in range(n + 1)]
    k = 0
    for m in _WORD.finditer(lower if len(lower) == len(text) else text):
        while k < n and m.start() >= at[k]:
            k += 1
        words[k].append(m.group())
    before: dict[str, int] = {}
    after: dict[str, int] = {}
    dot = size_before = size_after = 0
    similarity = np.zeros(n)
    for w in (w for i in range(1, min(SIDE, n) + 1) for w in words[i - 1]):
        c = after.get(w, 0)
        size_after += 2 * c + 1
        after[w] = c + 1
    for i in range(n):  # the boundary after sentence i
        for w in words[i]:
            c, d = after[w], before.get(w, 0)
            dot += c - 1 - d  # (c - 1) * (d + 1) - c * d
            size_after -= 2 * c - 1
            size_before += 2 * d + 1
            after[w], before[w] = c - 1, d + 1
        if i >= SIDE:
            for w in words[i - SIDE]:
                d = before[w]
                dot -= after.get(w, 0)
                size_before -= 2 * d - 1
                before[w] = d - 1
        if i + SIDE <= n:
            for w in words[i + SIDE]:
                c = after.get(w, 0)
                dot += before.get(w, 0)
                size_after += 2 * c + 1
                after[w] = c + 1
        if size_before and size_after:
            similarity[i] = dot / (size_before * size_after) ** 0.5
    left, right = similarity.copy(), similarity.copy()
    for d in range(1, SIDE + 1):  # the highest value within reach on either side
        left[d:] = np.maximum(left[d:], similarity[:-d])
        right[:-d] = np.maximum(right[:-d], similarity[d:])
    return left + right - 2 * similarity


def _scored(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets at which a piece may end and how well each suits: deep valleys, and paragraphs before clauses."""
    at, rank = _boundaries(text)
    return at, np.round(_depths(text, at) - 0.15 * rank, 6) if len(at) else np.zeros(0)


def _best(text: str, at: np.ndarray, score: np.ndarray, low: int, high: int) -> int:
    """The best end in (low, high]: the deepest valley, the later of equal ones; else after white space, else ``high``."""
    low = max(low, 0)
    lo, hi = np.searchsorted(at, (low + 1, high + 1))
    if lo < hi:
        return int(at[lo:hi][np.lexsort((-at[lo:hi], -score[lo:hi]))[0]])
    space = max(text.rfind(" ", low, high), text.rfind("\t", low, high))
    return space + 1 if space >= low else high


def seam(text: str, reach: int) -> int:
    """Where the last ``reach`` characters of a block's text are cut from the next block, by the text of the block alone.

    Both neighbours find the same place from the same last ``2 * reach`` characters.
    """
    tail = text[-2 * reach :]
    return len(text) - len(tail) + _best(tail, *_scored(tail), len(tail) - reach, len(tail))


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP, lead: int = 0) -> list[int]:
    """Ends of the pieces of a text, the last at its end; ``lead`` characters precede the text in its first piece."""
    n, (at, score) = len(text), _scored(text)
    ends, start = [], 0
    while True:
        room = limit - (overlap if start else lead)
        if n - start <= room:
            return [*ends, n]
        start = _best(text, at, score, start + room // 2 - 1, start + room)
        ends.append(start)


def placed_pages(chunks: DataFrame, pages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Where each page of an oversized section starts and ends in the section's text, without the text itself.

    Columns: chunk_id, document_id, section, page_number, copy (hash of the text that counts), start, end, length.
    """
    sections = (
        chunks.where("chunk_type = 'section' and chunk_id is not null").groupBy("chunk_id")
        # One whole row of those that share an id.
        .agg(F.max_by(F.struct("document_id", "section", "page_start", "page_end"), F.struct("page_start", "page_end", "document_id", "section")).alias("s"))
        .select("chunk_id", "s.*").where("document_id is not null and page_start <= page_end")
        .select("chunk_id", "document_id", "section", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    )
    # Only sizes travel here; the text is attached at the end.
    sizes = (
        pages.where("clean_text <> ''")
        .select("document_id", "page_number", F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), F.xxhash64("clean_text").alias("copy"), F.length("clean_text").alias("size"))
        .groupBy("document_id", "page_number").agg(F.max_by(F.struct("copy", "size"), F.struct("at", "copy")).alias("p"))
        .select("document_id", "page_number", "p.*")
    )
    rows = sections.join(sizes, ["document_id", "page_number"])
    # Offsets by prefix sums in two levels, so that one section of very many pages is no single window.
    group = F.floor(F.col("page_number") / 256)
    sums = rows.groupBy("chunk_id", group.alias("g")).agg(F.sum(F.col("size") + 1).alias("group_size"))
    whole = W.partitionBy("chunk_id").orderBy("g")
    base = sums.select(
        "chunk_id", "g", F.coalesce(F.sum("group_size").over(whole.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        (F.sum("group_size").over(W.partitionBy("chunk_id")) - 1).alias("length"),
    ).where(F.col("length") > limit)
    inner = W.partitionBy("chunk_id", "g").orderBy("page_number")
    return (
        rows.withColumn("g", group).join(base, ["chunk_id", "g"])
        .withColumn("end", F.col("base") + F.sum(F.col("size") + 1).over(inner) - 1)
        .withColumn("start", F.col("end") - F.col("size"))
        .select("chunk_id", "document_id", "section", "page_number", "copy", "start", "end", "length")
    )


def _in_blocks(placed: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pages by blocks of about BLOCK characters; the pages that a block needs of the one before come along (``own`` false)."""
    least = 4 * limit
    rows = placed.withColumn("block", F.floor(F.col("start") / BLOCK))
    sizes = rows.groupBy("chunk_id", "block").agg(F.max("end").alias("last"), F.min("start").alias("first"))
    order = W.partitionBy("chunk_id").orderBy("block")  # one row per block
    # A block too short for a seam joins the one before it.
    joined = F.coalesce(F.last(F.when(F.col("last") - F.col("first") >= least, F.col("block")), ignorenulls=True).over(order), F.min("block").over(W.partitionBy("chunk_id")))
    named = sizes.withColumn("into", joined)
    bounds = named.groupBy("chunk_id", "into").agg(F.max("last").alias("block_end")).withColumn("next_block", F.lead("into").over(W.partitionBy("chunk_id").orderBy("into")))
    named = named.select("chunk_id", "block", "into").join(bounds, ["chunk_id", "into"])
    rows = rows.join(named, ["chunk_id", "block"]).drop("block").withColumnRenamed("into", "block")
    own = rows.withColumn("own", F.lit(True))
    lead = rows.where(F.col("next_block").isNotNull() & (F.col("block_end") - F.col("end") <= 2 * limit + overlap)).withColumns({"own": F.lit(False), "block": F.col("next_block")})
    return own.unionByName(lead).withColumn("last_block", F.col("own") & F.col("next_block").isNull()).drop("block_end", "next_block")


_PIECES = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("document_id", T.StringType()), T.StructField("section", T.StringType()),
    T.StructField("block", T.LongType()), T.StructField("piece_no", T.IntegerType()), T.StructField("page_start", T.IntegerType()), T.StructField("page_end", T.IntegerType()),
    T.StructField("piece_start", T.LongType()), T.StructField("piece", T.StringType()),
])


def _cut_blocks(blocks: DataFrame, pages: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pieces of each block, numbered after its ``base``."""
    texts = pages.where("clean_text <> ''").select("document_id", "page_number", F.xxhash64("clean_text").alias("copy"), F.col("clean_text").alias("text"))
    keys = ["chunk_id", "document_id", "section", "block", "base"]
    # A page stored twice with one text comes twice; the set keeps it once.
    parts = blocks.join(texts, ["document_id", "page_number", "copy"]).groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct("start", "end", "page_number", "own", "text"))).alias("parts"), F.max("last_block").alias("last_block")
    )

    def pieces(frames):
        for frame in frames:
            out = []
            for chunk_id, document_id, section, block, base, parts, last_block in frame.itertuples(index=False):
                first, text = parts[0]["start"], "\n".join(p["text"] for p in parts)
                owned = next(i for i, p in enumerate(parts) if p["own"])
                begin, end = parts[owned]["start"], len(text)
                lead = 0
                if owned:  # the block starts where the one before it ends; the line break between their pages comes along
                    begin = first + seam(text[: parts[owned]["start"] - 1 - first], limit)
                    lead = overlap
                if not last_block:
                    tail = begin - first
                    end = tail + seam(text[tail:], limit)
                start_at, end_at = [p["start"] for p in parts], [p["end"] for p in parts]
                last = begin - first
                for k, e in enumerate(cut_points(text[last:end], limit, overlap, lead)):
                    e += begin - first
                    a, before = last - (overlap if k else lead), last
                    at = first + a
                    i = min(int(np.searchsorted(end_at, at, side="right")), len(parts) - 1)
                    j = int(np.searchsorted(start_at, first + max(e - 1, before), side="right")) - 1
                    out.append((chunk_id, document_id, section, block, base + k + 1, int(parts[i]["page_number"]), int(parts[max(i, j)]["page_number"]), at, text[a:e]))
                    last = e
            yield pd.DataFrame(out, columns=[f.name for f in _PIECES])

    return parts.select(*keys, "parts", "last_block").mapInPandas(pieces, _PIECES)


def split_sections(chunks: DataFrame, pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the section rows whose text is longer than ``limit``.

    Columns: chunk_id, document_id, section, piece_no (from 1), page_start, page_end, piece_start (offset in the
    section's text), piece. A piece has at most ``limit`` characters and begins with the last ``overlap`` of the
    piece before. Pages with null or empty text are left out, a page stored twice counts once (the later copy), and
    a chunk_id that stands in several rows keeps one. Sections within the limit give no rows. A section longer than
    BLOCK is cut in several tasks, whose seams lie at valleys like all other cuts.
    """
    if not 0 <= overlap < limit // 4:
        raise ValueError("the overlap must be less than a quarter of the limit")
    placed = cut(_in_blocks(placed_pages(chunks, pages, limit), limit, overlap))
    # Pieces of sections of several blocks are numbered on after those of the blocks before.
    several = placed.where("own and not last_block").select("chunk_id").distinct()
    long = placed.join(several, "chunk_id", "left_semi").withColumn("base", F.lit(0))
    if long.isEmpty():
        base = placed.select("chunk_id", "block").limit(0).withColumn("base", F.lit(0))
    else:
        counts = _cut_blocks(long, pages, limit, overlap).groupBy("chunk_id", "block").agg(F.count("*").alias("n"))
        base = counts.select("chunk_id", "block", F.coalesce(F.sum("n").over(W.partitionBy("chunk_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("base"))
    based = placed.join(broadcast_if_small(base), ["chunk_id", "block"], "left").withColumn("base", F.coalesce("base", F.lit(0)))
    return _cut_blocks(based, pages, limit, overlap).drop("block")
