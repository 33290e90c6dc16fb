"""Repair of text extracted from scanned pages (problem 1).

Words are grouped by a skeleton that glyphs easily confused share. A rare form is a misreading of that far more
frequent form of its group which the neighbouring words support best. Running headers and page numbers are the lines
at page edges that a chart repeats once digits are masked. Lines are reflowed into paragraphs with SQL windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartloom.llm.repeats import chunk_hashes, line_key, with_matches
from chartloom.session import cut, once, spread_join, store

#: Letters and figures are listed before their classes, which are slower to test.
_ASCII = "abcdefghijklmnopqrstuvwxyz"
TOKEN = rf"[0123456789$†|\p{{N}}]*+[{_ASCII}\p{{L}}][{_ASCII}0123456789$†|\p{{L}}\p{{N}}]*+"
#: A word of at least this share of all words is known; there can be no more than its inverse of them.
KNOWN_SHARE = 1e-5
#: How much more frequent the right form must be than its misreading.
TIMES = 15
#: Hyphens that only scanning leaves at a line's end.
SOFT_HYPHENS = "‐¬­"
BROKEN = r"(?<!\p{L})(\p{L}++)([-‐¬\x{AD}])[ \t]*\r?\n[ \t]*(\p{Ll}[\p{L}$†]*)"
SPACED = r"(?<![\p{L}\p{N}])\p{L}(?: \p{L}){3,}(?![\p{L}\p{N}])"
STRAY = r"(?m)^[ \t]*[·»¦~`'|†‡\\][ \t]+(?=\S)|(?<=\S)[ \t]+[·»¦~`'|†‡\;.][ \t\r]*$"
LIGATURES = "[ﬀ-ﬆ]"
#: Non-blank lines at the top and at the bottom of a page where running lines are looked for; beyond OUTER of them a line
#: counts only if all lines between it and the edge are running lines too.
EDGE, OUTER = 8, 3
#: Cheaper tests that hold wherever SPACED or STRAY match; few texts pass them.
MAYBE_SPACED = r" \p{L} \p{L} \p{L}(?![\p{L}\p{N}])"
MAYBE_STRAY = r"(?:^|[ \t\n])[·»¦~`'|†‡\\;.](?:[ \t\r\n]|$)"

#: Glyphs that recognition confuses, each written as the strokes it shares with its lookalikes.
SINGLE_FROM, SINGLE_TO = "ecil1|!hb8gqt†s$5o0", "eeiiiiihhhggttsssoo"
STROKES = {"d": "ei", "u": "ii", "n": "ri", "w": "vv", "m": "rri"}
LIGATURE_LETTERS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _without_ligatures(text: Column) -> Column:
    out = text
    for glyph, letters in LIGATURE_LETTERS.items():
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    return F.when(text.rlike(LIGATURES), out).otherwise(text)


def skeleton(word: Column) -> Column:
    """A form equal for words that differ in easily confused glyphs only, such as rn and m or cl and d."""
    out = F.translate(F.lower(_without_ligatures(word)), SINGLE_FROM, SINGLE_TO)
    for glyph, strokes in STROKES.items():
        out = F.replace(out, F.lit(glyph), F.lit(strokes))
    return out


#: Few pages break words, so a cheap test guards the expressions that look for broken words.
HYPHEN_END = r"[-‐¬\x{AD}][ \t]*\r?\n"


def _joined(text: Column) -> Column:
    """Text with words that a line end breaks put together."""
    whole = F.regexp_replace(text, r"(?<=\p{L})[-‐¬\x{AD}][ \t]*\r?\n[ \t]*(?=\p{Ll})", "")
    return F.when(text.rlike(HYPHEN_END), whole).otherwise(text)


def _unbroken(text: Column) -> Column:
    """Text without the words that line ends break, so that fragments and false wholes aren't learnt."""
    apart = F.regexp_replace(text, r"(?<!\p{L})\p{L}++[-‐¬\x{AD}][ \t]*\r?\n[ \t]*\p{Ll}[\p{L}$†]*", "\n")
    return F.when(text.rlike(HYPHEN_END), apart).otherwise(text)


def _token_rows(pages: DataFrame, read=None) -> DataFrame:
    words = F.regexp_extract_all(F.lower((read or _joined)(F.col("clean_text"))), F.lit(TOKEN), F.lit(0))
    pages = once(pages.select("document_id", "page_number", "clean_text"), w=words)
    # Shifted arrays side by side: built-in functions in generated code, one match per text.
    prev, after = F.concat(F.array(F.lit(None).cast("string")), F.col("w")), F.slice("w", F.lit(2), F.greatest(F.lit(1), F.size("w")))
    rows = pages.select("document_id", "page_number", F.inline(F.arrays_zip(prev.alias("prev"), F.col("w").alias("word"), after.alias("next"))))
    return rows.where("word is not null")


class Lexicon:
    """What the corpus says about its words: known words, pairs of neighbours, and the right form of misreadings."""

    def __init__(self, pages: DataFrame):
        self.pairs = cut(_token_rows(pages, _unbroken).groupBy("prev", "word").agg(F.count("*").alias("n")))
        counts = self.pairs.groupBy("word").agg(F.sum("n").alias("n"))
        total = self.pairs.agg(F.sum("n")).first()[0] or 0
        counts = cut(counts.withColumn("skeleton", skeleton(F.col("word"))))
        least = max(2.0, KNOWN_SHARE * total)
        frequent = counts.where(F.col("n") >= least)
        # Right forms are words of letters: all frequent ones of a skeleton stand for choice.
        heads = cut(
            frequent.where(F.col("word").rlike(r"^\p{L}+$") & (F.length("word") >= 3)).select("skeleton", F.col("word").alias("right"), F.col("n").alias("right_n"))
        )
        self.misread = cut(
            counts.join(F.broadcast(heads), "skeleton")
            .where((F.col("word") != F.col("right")) & (F.col("right_n") >= TIMES * F.col("n")))
            .select("word", "right", "right_n")
        )
        # At most 1 / KNOWN_SHARE rows, so broadcasting it is safe at any corpus size. The share is a rate, so the same
        # words are known however long the corpus is.
        self.known = cut(frequent.select("word", "n").join(self.misread.select("word").distinct(), "word", "left_anti"))


def _rare(pages: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Tokens that are no known words, with their neighbours."""
    return _token_rows(pages).join(F.broadcast(lexicon.known.select("word")), "word", "left_anti")


def misread_words(rare: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Misread tokens with their right form: the one whose pairs with the neighbours are the most frequent.

    A form counts as supported by a neighbour if its pair with it occurs twice or more, and more often than the
    written form's own pair. Without support, a form that holds a glyph no word has is read as its most frequent
    candidate, and any other form is left as it is.
    """
    suspects = rare.join(lexicon.misread.select("word").distinct(), "word", "left_semi")
    places = ["document_id", "page_number", "prev", "word", "next"]
    left = suspects.groupBy("prev", "word").agg(F.count("*").alias("own_before"))
    right = suspects.groupBy("word", "next").agg(F.count("*").alias("own_after"))
    # Candidates are weighed once per context, however many pages show it.
    contexts = suspects.groupBy("prev", "word", "next").agg(F.lit(1).alias("one")).drop("one")
    contexts = contexts.join(left, ["prev", "word"], "left").join(right, ["word", "next"], "left").join(lexicon.misread, "word")
    support = lexicon.pairs.where("n >= 2")
    before = support.select("prev", F.col("word").alias("right"), F.col("n").alias("before"))
    after = support.select(F.col("prev").alias("right"), F.col("word").alias("next"), F.col("n").alias("after"))
    contexts = contexts.join(before, ["prev", "right"], "left").join(after, ["right", "next"], "left")
    held = lambda n, own: F.when(F.col(n) > F.coalesce(F.col(own), F.lit(0)), F.col(n)).otherwise(0)
    odd = F.col("word").rlike(r"[\p{N}$†|]")
    chosen = (
        contexts.withColumn("support", held("before", "own_before") + held("after", "own_after"))
        .groupBy("prev", "word", "next").agg(F.max_by(F.struct("right", "support"), F.struct("support", "right_n", "right")).alias("c"))
        .where((F.col("c.support") > 0) | odd)
        .select(F.col("prev").alias("p"), F.col("word").alias("w"), F.col("next").alias("x"), F.col("c.right").alias("right"))
    )
    same = (F.col("word") == F.col("w")) & F.col("prev").eqNullSafe(F.col("p")) & F.col("next").eqNullSafe(F.col("x"))
    return suspects.join(chosen, same).select(*places, "right")


def apart_words(rare: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Fragments that are a known word together with the token before or after them."""
    known = lexicon.known.where((F.col("n") >= 4) & (F.length("word") >= 5)).select(F.col("word").alias("whole"), F.col("n").alias("whole_n"))
    sides = rare.where(F.col("word").rlike(r"^\p{L}+$")).select(
        "document_id", "page_number",
        F.explode(F.array(
            F.struct(F.concat("prev", "word").alias("whole"), F.col("prev").alias("left"), F.col("word").alias("right")),
            F.struct(F.concat("word", "next").alias("whole"), F.col("word").alias("left"), F.col("next").alias("right")),
        )).alias("s"),
    ).select("document_id", "page_number", "s.*").where("whole is not null")
    return sides.join(F.broadcast(known), "whole")


def _edge_lines(pages: DataFrame, text: Column, first: int = 1, last: int = OUTER) -> DataFrame:
    """The ``first`` to ``last`` non-blank lines from each edge of a page: (document_id, page_number, i, side, pos, key)."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.btrim(s["x"], F.lit(" \t\r")) != "")
    side = lambda order, name: F.transform(F.slice(order, first, last - first + 1), lambda s, k: F.struct(s["i"].alias("i"), F.lit(name).alias("side"), (k + first).alias("pos"), s["x"].alias("x")))
    rows = pages.where("document_id is not null and page_number is not null").select("document_id", "page_number", lines.alias("lines"))
    rows = rows.select("document_id", "page_number", F.explode(F.concat(side(F.col("lines"), "top"), side(F.reverse("lines"), "bottom"))).alias("e"))
    return rows.select("document_id", "page_number", "e.i", "e.side", "e.pos", line_key(F.col("e.x")).alias("key")).where("key <> ''")


def furniture(pages: DataFrame, share: float = 1 / 3, least: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Running lines: per chart an array of keys (its size is bounded by the lines of a page's edges), keys of many charts,
    and the charts whose running lines may go beyond the OUTER lines of an edge."""
    salt = F.pmod("page_number", F.lit(16)).alias("salt")
    size = pages.groupBy("document_id", salt, "page_number").agg(F.lit(1).alias("one")).groupBy("document_id").agg(F.count("*").alias("pages"))
    running = (F.col("n") >= least) & (F.col("n") >= F.col("pages") * share)

    def counted(edge: DataFrame) -> DataFrame:
        seen = (
            edge.groupBy("document_id", "key", salt, "page_number").agg(F.min(F.struct("pos", "side")).alias("at"))
            .groupBy("document_id", "key", "salt").agg(F.count("*").alias("n"), F.min("at").alias("at"))
            .groupBy("document_id", "key").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
        )
        return cut(seen.join(size, "document_id").select("document_id", "key", "n", "pages", F.col("at.pos").alias("pos"), F.col("at.side").alias("side"), running.alias("running")))

    text = F.coalesce("text", "clean_text")
    seen = counted(_edge_lines(pages, text))
    # Only where running lines fill the outer lines of one edge can there be more of them further in.
    deep = cut(seen.where("running").groupBy("document_id", "side").agg(F.count_distinct("pos").alias("n")).where(F.col("n") >= OUTER).select("document_id").distinct())
    if not deep.isEmpty():
        inner = counted(_edge_lines(spread_join(pages, deep, ["document_id"], F.col("page_number"), "left_semi"), text, OUTER + 1, EDGE))
        seen = seen.unionByName(inner.join(seen.where("running").select("document_id", "key"), ["document_id", "key"], "left_anti"))
    own = (
        seen.where("running").select("document_id", "key", chunk_hashes("key").alias("own"))
        .groupBy("document_id").agg(F.collect_list(F.struct("key", "own")).alias("anchors"))
    )
    # Charts of few pages borrow the keys that run through other charts wherever they appear often enough.
    common = (
        seen.where(F.col("pos") <= OUTER).groupBy("key").agg(F.count_if("running").alias("running"), F.count_if(F.col("pages") >= least * 2).alias("charts"))
        .where("running >= 2 and running >= 0.2 * charts").select("key")
    )
    return own, cut(common), deep


def running_lines(pages: DataFrame) -> DataFrame:
    """Edge lines of ``clean_text`` that are running headers, footers or page numbers: (document_id, page_number, i).

    ``i`` is the line's index in the text split at line feeds.
    """
    own, common, deep = furniture(pages)
    texts = pages.where("clean_text is not null")
    edge = _edge_lines(texts, F.col("clean_text"))
    if not deep.isEmpty():
        edge = edge.unionByName(_edge_lines(spread_join(texts, deep, ["document_id"], F.col("page_number"), "left_semi"), F.col("clean_text"), OUTER + 1, EDGE))
    edge = store(edge)
    # Each distinct key of a chart is compared once; a damaged copy still shares chunks with the running line.
    keys = edge.groupBy("document_id", "key").agg(F.lit(1).alias("one")).withColumn("own", chunk_hashes("key"))
    keys = spread_join(keys, own, ["document_id"], F.col("key")).where(F.exists("anchors", lambda a: F.arrays_overlap(a["own"], F.col("own"))))
    keys = with_matches(keys).where(F.size("matched") > 0).select("document_id", "key", F.lit(True).alias("running"))
    rows = spread_join(edge, keys, ["document_id", "key"], F.col("page_number"), "left")
    rows = spread_join(rows, common.withColumn("common", F.lit(True)), ["key"], F.col("page_number"), "left").where("running or common")
    sides = rows.groupBy("document_id", "page_number", "side").agg(F.collect_set(F.struct("pos", "i")).alias("e"))
    reached = F.filter("e", lambda x: (x["pos"] <= OUTER) | (F.size(F.array_distinct(F.transform(F.filter("e", lambda y: y["pos"] < x["pos"]), lambda y: y["pos"]))) == x["pos"] - 1))
    return sides.select("document_id", "page_number", F.explode(reached).alias("x")).select("document_id", "page_number", "x.i").distinct()


def _broken(text: Column) -> Column:
    """Words broken over line ends, as structs (left, mark, right)."""
    return F.transform(
        F.when(text.rlike(HYPHEN_END), F.regexp_extract_all(text, F.lit(BROKEN), F.lit(0))),
        lambda x: F.struct(*(F.regexp_extract(x, BROKEN, i).alias(n) for i, n in ((1, "left"), (2, "mark"), (3, "right")))),
    )


def broken_words(pages: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Words that a line end breaks: (document_id, page_number, left, mark, right), without correct compounds."""
    rows = pages.select("document_id", "page_number", F.explode(_broken(F.col("clean_text"))).alias("b")).select("document_id", "page_number", "b.*")
    low = lambda c: F.lower(F.col(c))
    known = F.broadcast(lexicon.known)
    rows = (
        rows.join(known.select(F.col("word").alias("whole"), F.lit(True).alias("whole_known")), F.concat(low("left"), low("right")) == F.col("whole"), "left")
        .join(known.select(F.col("word").alias("lw"), F.lit(True).alias("left_known")), low("left") == F.col("lw"), "left")
        .join(known.select(F.col("word").alias("rw"), F.lit(True).alias("right_known")), low("right") == F.col("rw"), "left")
    )
    hard = F.col("mark") == "-"
    fragments = F.col("left_known").isNull() & F.col("right_known").isNull()
    return rows.where(~hard | F.col("whole_known") | fragments).select("document_id", "page_number", "left", "mark", "right")


def scan_traces(pages: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Pages with traces of scanning: (document_id, page_number, kinds).

    ``kinds`` is the sorted set of broken_word, misread, apart, stray and running_line. A page without a trace, or
    with a null or empty clean_text, has no row; a page stored twice has one.
    """
    pages = pages.select("document_id", "page_number", "text", "clean_text").where("document_id is not null and page_number is not null")
    lexicon = lexicon or Lexicon(pages.where("clean_text is not null"))
    text = F.col("clean_text")
    rare = cut(_rare(pages.where("clean_text is not null"), lexicon))
    direct = F.filter(
        F.array(
            F.when((text.rlike(MAYBE_STRAY) & text.rlike(STRAY)) | text.rlike(LIGATURES), F.lit("stray")),
            F.when(text.rlike(MAYBE_SPACED) & text.rlike(SPACED), F.lit("apart")),
            F.when(text.rlike(rf"[‐¬\x{{AD}}][ \t]*(?:\r?\n|$)"), F.lit("broken_word")),
        ),
        lambda x: x.isNotNull(),
    )
    found = pages.select("document_id", "page_number", F.explode(direct).alias("kind"))
    for rows, kind in (
        (misread_words(rare, lexicon), "misread"),
        (apart_words(rare, lexicon), "apart"),
        (broken_words(pages, lexicon), "broken_word"),
        (running_lines(pages), "running_line"),
    ):
        found = found.unionByName(rows.select("document_id", "page_number", F.lit(kind).alias("kind")))
    return found.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


#: A line that starts a paragraph of its own: list item, table row, heading without a full stop.
OWN_LINE = r"^\s*(?:[-*•]|\d+[.)])\s|\t| \| |; .*;|  \S+  "


def repaired_pages(pages: DataFrame) -> DataFrame:
    """One row per page with ``paragraphs``: the repaired text as continuous paragraphs, and ``repaired`` joined by blank lines.

    Running lines and stray characters are gone, broken and pulled-apart words are whole, misread words corrected.
    Of a page stored twice the later copy counts. Null and empty texts give no paragraphs and a null ``repaired``;
    pages without chart or number are left out.
    """
    pages = (
        pages.where("document_id is not null and page_number is not null")
        .groupBy("document_id", "page_number")
        .agg(F.max_by(F.struct("text", "clean_text"), F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp_ntz"))).alias("p"))
        .select("document_id", "page_number", "p.*")
    )
    pages = cut(pages)
    texts = pages.where("clean_text is not null")
    lexicon = Lexicon(texts)
    key = ["document_id", "page_number"]
    gone = running_lines(pages).groupBy(*key).agg(F.collect_set("i").alias("gone"))
    rare = cut(_rare(texts, lexicon))
    fixes = (
        misread_words(rare, lexicon).select(*key, F.struct(F.col("word").alias("bad"), F.col("right").alias("good")).alias("fix"))
        .unionByName(apart_words(rare, lexicon).select(*key, F.struct(F.concat_ws(" ", "left", "right").alias("bad"), F.col("whole").alias("good")).alias("fix")))
        .groupBy(*key).agg(F.sort_array(F.collect_set("fix"), asc=False).alias("fixes"))
    )
    broken = broken_words(pages, lexicon).groupBy(*key).agg(F.collect_set(F.concat("left", "mark", "right")).alias("broken"))
    plain = _without_ligatures(F.regexp_replace(F.col("line"), STRAY, ""))
    lines = (
        texts.select(*key, F.posexplode(F.split("clean_text", r"\r?\n")).alias("i", "line"))
        .join(gone, key, "left")
        .where(~F.coalesce(F.array_contains("gone", F.col("i")), F.lit(False)))
        .withColumn("line", F.rtrim(plain))
        .join(broken, key, "left")
    )
    page = W.partitionBy(*key).orderBy("i")
    left = F.regexp_extract("line", r"(\p{L}+)[-‐¬\x{AD}]$", 1)
    lines = (
        lines.withColumn("next", F.lead("line").over(page))
        .withColumn("rest", F.regexp_extract(F.coalesce("next", F.lit("")), r"^[ \t]*(\p{Ll}[\p{L}$†]*[^\s]*)", 1))
        .withColumn("mark", F.regexp_extract("line", r"([-‐¬\x{AD}])$", 1))
        .withColumn(
            "glue",
            F.when(
                (F.col("mark") != "") & (F.col("rest") != ""),
                F.coalesce(F.array_contains("broken", F.concat(left, F.col("mark"), F.regexp_extract("rest", r"^[\p{L}$†]+", 0))), F.lit(False)),
            ).otherwise(F.lit(False)),
        )
        .withColumn("taken", F.when(F.lag("glue").over(page), F.lag("rest").over(page)))
        .withColumn("line", F.when(F.col("taken").isNotNull(), F.ltrim(F.substring(F.ltrim("line"), F.length("taken") + 1, F.length("line")))).otherwise(F.col("line")))
        .withColumn("line", F.when(F.col("glue"), F.concat(F.regexp_replace("line", r"[-‐¬\x{AD}]$", ""), F.col("rest"))).otherwise(F.col("line")))
    )
    blank = F.trim("line") == ""
    own = F.col("line").rlike(OWN_LINE) | F.regexp_replace("line", SPACED, "").rlike(r"^\s*$") | ((F.length("line") <= 40) & F.col("line").rlike(r"^\p{Lu}") & ~F.col("line").rlike(r"[.,;:!?]$") & F.coalesce(F.trim("next") == "", F.lit(True)))
    lines = (
        lines.withColumn("own", own).withColumn("blank", blank)
        .withColumn("starts", F.col("own") | F.coalesce(F.lag("own").over(page), F.lit(True)) | F.coalesce(F.lag("blank").over(page), F.lit(True)))
        .withColumn("para", F.sum(F.col("starts").cast("int")).over(page))
        .where(~F.col("blank"))
    )
    paragraphs = (
        lines.groupBy(*key, "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.trim("line").alias("line")))), lambda s: s["line"]), " ").alias("p"))
        .groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("para", "p"))), lambda s: s["p"]).alias("paragraphs"))
    )
    edge_before, edge_after = r"(?<![\p{L}\p{N}$†|])", r"(?![\p{L}\p{N}$†|])"

    def fix(p: Column) -> Column:
        def one(acc: Column, f: Column) -> Column:
            def written(bad: Column, flag: str = "") -> Column:
                bad = F.regexp_replace(F.regexp_replace(bad, r"([$|])", r"\\\\$1"), " ", "\\\\s+")
                return F.concat(F.lit(flag + edge_before), bad, F.lit(edge_after))

            # As it is written: small letters, capitals, else a capital first.
            low = F.regexp_replace(acc, written(f["bad"]), f["good"])
            high = F.regexp_replace(low, written(F.upper(f["bad"])), F.upper(f["good"]))
            return F.regexp_replace(high, written(f["bad"], "(?iu)"), F.initcap(f["good"]))

        return F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<bad:string,good:string>>")), p, one)

    closed = lambda p: F.regexp_replace(p, r"(?<![\p{L}\p{N}])(\p{L})(?: (?=\p{L}(?: \p{L}|(?![\p{L}\p{N}]))))", "$1")
    spaced = lambda p: F.when(p.rlike(SPACED), F.regexp_replace(closed(F.regexp_replace(p, r" {2,}", " \u0001 ")), " ?\u0001 ?", " ")).otherwise(p)
    out = pages.select(*key).join(paragraphs, key, "left").join(fixes, key, "left")
    out = out.withColumn("paragraphs", F.transform("paragraphs", lambda p: spaced(fix(p))))
    return out.select(*key, "paragraphs", F.array_join("paragraphs", "\n\n").alias("repaired"))
