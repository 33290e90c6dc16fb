"""Texts that stop before their end (problem 8).

One pass over the texts counts their tokens, and how often each ends a line of prose or of a list. The distinct words
form a vocabulary and their proper prefixes a trie kept as a table. A text is cut only on evidence:

* ``mark``: a mark or debris that a cut leaves;
* ``prefix``: the final token is no known word but a proper prefix of known words;
* ``phrase``: the final token is known, but in lines of its kind other tokens follow it, so it is the inner node of a
  line and not its end;
* ``length``: the texts of the source pile up at this length, in characters or bytes.

Lines known to end texts (filing lines, codes, whole list rows) and sentence ends speak against a cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chartloom.session import broadcast_if_small, cut, once, spread_join

#: Marks and debris that a cut leaves at the end; none is longer than TAIL characters.
MARK = r"(?:\[(?:cut|more|truncated|continued|\.\.\.)\]|\((?:cut|more|truncated)\)|…|\.\.\.|\\u[0-9A-Fa-f]{0,3}|&[A-Za-z#][A-Za-z0-9]{0,7}|<[^<>\s]{0,20})$"
TAIL = 32
BLANKS = " \t\n\x0b\f\r\u00a0"
#: A sentence's end, with what may close it.
PROPER_END = r"[.!?。！？।؟…][\"'”’»)\]]*$"
WORD = r"\p{L}[\p{L}\p{M}'’]*"
LIST_LINE = r"^\s*(?:[-*•·]|\d+[.)])\s+\S"
TABLE_LINE = r"\t| \| |; .*; "
FILING_LINE = r"^\p{L}[\p{L} ]{1,40}(?:: \S.*|, \d{1,2}:\d{2})$"
CODE_LINE = r"^\p{L}[\p{L} ]*: (?:[A-Z]\d[0-9A-Z]*(?:\.[0-9A-Z]+)?(?:, )?)+$"
#: Letters of a word up to which the trie has a node for each prefix; below its deepest nodes hang the longer words.
TRIE_DEPTH = 24
#: Rates, which do not move with the number of texts. A line is whole if another line follows this share of its copies,
WHOLE_SHARE = 0.25
#: a token may end a line of its kind if it ends this share of the lines it stands in,
END_SHARE = 0.3
#: and a filing line closes more than these shares of the other texts, of the corpus or of its source.
CLOSING_SHARE, SOURCE_CLOSING_SHARE = 0.002, 0.01


def _mask(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), "[0-9]+", "#"))


def _tokens(masked: Column) -> Column:
    return F.split(masked, "[\\s\\x{00A0}]+")


def _is_row(line: Column) -> Column:
    """Whether a line is the row of a list or table; the cheap tests come first."""
    return F.contains(line, F.lit("\t")) | F.contains(line, F.lit(" | ")) | line.rlike(LIST_LINE) | (F.contains(line, F.lit("; ")) & line.rlike(TABLE_LINE))


def _core(text: Column) -> Column:
    """The text without blanks, marks and debris at its end. Only its last characters are searched for marks."""
    bare = F.rtrim(F.rtrim(F.rtrim(text, F.lit(BLANKS)), F.lit("\ufffd")), F.lit(BLANKS))
    mark = F.length(F.regexp_extract(F.right(bare, F.lit(TAIL)), MARK, 0))
    return F.rtrim(F.left(bare, F.length(bare) - mark), F.lit(BLANKS))


def _limits(sized: DataFrame, length: str, least: int = 5, share: float = 0.25) -> DataFrame:
    """Lengths at which a source's texts pile up: ``share`` of its texts of this length or more have exactly it."""
    hist = sized.groupBy("source_key", F.col(length).alias("n")).agg(F.count("*").alias("texts"))
    # One row per length of a source, so a window holds at most as many rows as the longest text has characters.
    longer = W.partitionBy("source_key").orderBy(F.desc("n"))
    return (
        hist.withColumn("longer", F.sum("texts").over(longer))
        .where((F.col("texts") >= least) & (F.col("texts") >= F.col("longer") * share) & (F.col("n") >= 32))
        .select("source_key", F.col("n").alias(length), F.lit(True).alias(f"{length}_limit"))
    )


def _counts(given: DataFrame) -> DataFrame:
    """Tokens and lines of all texts in one pass: (kind, key, row, inside, at_end, n).

    Kind t: a masked token, ``inside`` and ``at_end`` of lines that another line follows, and ``n`` in all lines, each
    without the final token of its text. Kind l: the hash of a masked line that another line follows.
    """
    lines = given.select(F.posexplode(F.split("core", "\n")).alias("i", "line"), F.col("line_count"))
    lines = once(lines.where("trim(line) <> ''"), masked=_mask(F.col("line"))).withColumn("inner", F.col("i") < F.col("line_count") - 1)
    lines = once(lines.withColumn("row", _is_row(F.col("line"))), tokens=_tokens(F.col("masked")))
    # The line's own key comes first, then its tokens.
    keys = F.posexplode(F.concat(F.array(F.xxhash64("masked").cast("string")), F.col("tokens"))).alias("at", "key")
    rows = lines.select("row", "inner", F.size("tokens").alias("last"), keys)
    line, final = F.col("at") == 0, F.col("at") == F.col("last")
    rows = rows.where(F.col("inner") | ~(line | final))
    return (
        rows.groupBy(F.when(line, "l").otherwise("t").alias("kind"), "key", F.when(~line, F.col("row")).alias("row"))
        .agg(F.count_if(~line & F.col("inner") & ~final).alias("inside"), F.count_if(~line & F.col("inner") & final).alias("at_end"), F.count("*").alias("n"))
    )


def _beginnings(wanted: DataFrame, words: DataFrame) -> DataFrame:
    """For each wanted string that is a proper prefix of known words: (wanted, prefix_of, begins), by the trie of the words.

    Up to TRIE_DEPTH letters each prefix is a node; a longer string is looked up at that depth and compared with the
    words below its node.
    """
    at = F.substring("wanted", 1, TRIE_DEPTH)
    nodes = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(TRIE_DEPTH)))).alias("depth"))
    nodes = nodes.select(F.substring("word", F.lit(1), F.col("depth")).alias("node"), "word", "n").where((F.col("node") != F.col("word")) | (F.length("node") == TRIE_DEPTH))
    shallow = nodes.groupBy("node").agg(F.sum("n").alias("begins"), F.max_by("word", F.struct("n", "word")).alias("prefix_of"))
    short = wanted.where(F.length("wanted") < TRIE_DEPTH).join(shallow, F.col("wanted") == F.col("node")).select("wanted", "prefix_of", "begins")
    long = (
        wanted.where(F.length("wanted") >= TRIE_DEPTH)
        .join(nodes.where(F.length("node") == TRIE_DEPTH), at == F.col("node"))
        .where(F.col("word").startswith(F.col("wanted")) & (F.col("word") != F.col("wanted")))
        .groupBy("wanted").agg(F.max_by("word", F.struct("n", "word")).alias("prefix_of"), F.sum("n").alias("begins"))
    )
    return short.unionByName(long)


def truncated_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per text: marked, final_word, prefix_of (a known word it begins), at_limit, evidence and ``cut``.

    ``evidence`` is the array of mark, prefix, phrase and length that hold; it is empty for a text that is not cut.
    Null, empty and blank texts are never cut. A null source is a source of its own. Repeated rows are kept.
    """
    text = F.col("text")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    given = once(docs.where("text is not null"), core=_core(text)).withColumn("line_count", F.size(F.split("core", "\n")))
    counts = cut(_counts(given.where("core <> ''")))
    tokens = counts.where("kind = 't'").groupBy(F.col("key").alias("token")).agg(F.sum("n").alias("n"))
    words = tokens.select("n", F.explode(F.regexp_extract_all("token", F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.sum("n").alias("n"))

    last_line = F.regexp_replace(F.substring_index("core", "\n", -1), r"\r", "")
    final = F.substring_index(F.translate("last_masked", BLANKS, " " * len(BLANKS)), " ", -1)
    ends = cut(
        once(once(given, last_line=last_line), last_masked=_mask(F.col("last_line")))
        .withColumn("marked", F.length("core") < F.length(F.rtrim(text, F.lit(BLANKS))))
        .withColumn("open_end", (F.col("core") != "") & ~F.right("core", F.lit(TAIL)).rlike(PROPER_END))
        .withColumn("decimal_end", F.right("core", F.lit(TAIL)).rlike(r"\s\d+\.$"))
        .withColumn("final_word", F.nullif(F.lower(F.regexp_extract(F.when(F.col("open_end"), F.substring_index(F.col("last_line"), " ", -1)), f"({WORD})$", 1)), F.lit("")))
        .withColumn("final_token", F.when(F.col("open_end"), final))
        .withColumn("is_row", _is_row(F.col("last_line")))
        .withColumn("codes", F.col("last_line").rlike(CODE_LINE)).withColumn("filing", F.col("last_line").rlike(FILING_LINE))
        .select(
            "id", "source", F.coalesce("source", F.lit("")).alias("source_key"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"),
            "marked", "open_end", "decimal_end", "is_row", "codes", "filing", F.when(F.col("open_end"), F.xxhash64("last_masked")).alias("form"),
            F.xxhash64("text").alias("text_hash"), "final_token", "final_word",
        )
    )
    # How often a line closes texts, against how often another line follows it. Texts stored twice count once.
    sizes = ends.select("source_key", "text_hash").distinct().groupBy("source_key").agg(F.count("*").alias("of_source"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("of_source").alias("of_all"))))  # one row
    inner = counts.where("kind = 'l'").select(F.col("key").cast("bigint").alias("form"), F.col("n").alias("inner"))
    same = W.partitionBy("form")  # at most one row per source
    closes, closes_all = F.col("closes"), F.col("closes_all")
    forms = (
        ends.where("open_end").groupBy("form", "source_key", "text_hash").agg(F.max("filing").alias("filing"))
        .groupBy("form", "source_key").agg(F.count("*").alias("closes"), F.max("filing").alias("filing"))
        .withColumn("closes_all", F.sum("closes").over(same)).withColumn("filing", F.max("filing").over(same))
        .join(inner, "form", "left").withColumn("inner", F.coalesce("inner", F.lit(0)))
        .join(broadcast_if_small(sizes), "source_key")
        .select(
            "form", "source_key",
            ((F.col("inner") > 0) & (F.col("inner") >= (F.col("inner") + closes_all) * WHOLE_SHARE)).alias("whole"),
            (F.col("filing") & (closes_all >= F.col("inner")) & (
                (closes_all - 1 > (F.col("of_all") - 1) * CLOSING_SHARE) | (closes - 1 > (F.col("of_source") - 1) * SOURCE_CLOSING_SHARE)
            )).alias("closing"),
        ).where("whole or closing")
    )

    # What the corpus says about each distinct final word and token.
    open_ends = ends.where("open_end")
    final_words = open_ends.where("final_word is not null").select(F.col("final_word").alias("wanted")).distinct()
    unknown = cut(final_words.join(words.select(F.col("word").alias("wanted")), "wanted", "left_anti"))
    by_word = _beginnings(unknown, words).select(F.col("wanted").alias("final_word"), "prefix_of")
    final_tokens = open_ends.select(F.col("final_token").alias("wanted")).distinct()
    strange = cut(final_tokens.join(tokens.select(F.col("token").alias("wanted")), "wanted", "left_anti"))
    token_words = tokens.select(F.col("token").alias("word"), "n")
    by_token = _beginnings(strange, token_words).select(F.col("wanted").alias("final_token"), F.lit(True).alias("token_begins"))
    held = (
        counts.where("kind = 't'").select(F.col("key").alias("final_token"), F.col("row").alias("is_row"), "inside", "at_end")
        .join(final_tokens.withColumnRenamed("wanted", "final_token"), "final_token", "left_semi")
        .select("final_token", "is_row", (F.col("at_end") >= (F.col("inside") + F.col("at_end")) * END_SHARE).alias("may_end"), (F.col("inside") > 0).alias("continues"))
        .where("continues or may_end")
    )
    joined = ends
    for small, on in ((by_word, ["final_word"]), (by_token, ["final_token"]), (held, ["final_token", "is_row"]), (forms, ["form", "source_key"]), (_limits(ends, "chars"), ["source_key", "chars"]), (_limits(ends, "bytes"), ["source_key", "bytes"])):
        joined = spread_join(joined, small, on, F.col("id"), "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    at_limit = yes("chars_limit") | yes("bytes_limit")
    prefix = F.col("prefix_of").isNotNull()
    phrase = (yes("continues") & ~yes("may_end")) | yes("token_begins")
    whole_end = yes("closing") | F.col("codes") | yes("whole") | (F.col("is_row") & yes("may_end"))
    mark_cut = F.col("open_end") & F.col("marked")
    word_cut = F.col("open_end") & prefix
    phrase_cut = F.col("open_end") & ~whole_end & ~prefix & phrase
    length_cut = at_limit & (
        F.when(~F.col("open_end"), F.col("decimal_end") & ~F.col("marked"))  # '12.' of a decimal at the field's end
        .when(whole_end, ~F.col("is_row") & ~yes("closing") & ~F.col("codes"))
        .otherwise(True)
    )
    evidence = F.array_compact(F.array(F.when(mark_cut, F.lit("mark")), F.when(word_cut, F.lit("prefix")), F.when(phrase_cut, F.lit("phrase")), F.when(length_cut, F.lit("length"))))
    out = joined.select("id", "source", "marked", "final_word", "prefix_of", at_limit.alias("at_limit"), evidence.alias("evidence"))
    none = docs.where("text is null").select("id", "source", F.lit(False).alias("marked"), F.lit(None).cast("string").alias("final_word"), F.lit(None).cast("string").alias("prefix_of"), F.lit(False).alias("at_limit"), F.array().cast("array<string>").alias("evidence"))
    return out.unionByName(none).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "marked", "final_word", "prefix_of", "at_limit", "evidence", (F.size("evidence") > 0).alias("cut"))


def truncation_by_source(docs: DataFrame, **columns: str) -> DataFrame:
    """Per source: texts, cut texts and the share of cut texts. A null source is reported as null."""
    source = columns.get("source_col", "source")
    return truncated_texts(docs, **columns).groupBy(source).agg(
        F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"), F.round(F.avg(F.col("cut").cast("int")), 6).alias("cut_share")
    )
