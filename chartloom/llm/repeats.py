"""Removal of text that one chart repeats on many of its pages (problem 4).

The text of a block is read as a running string of its letters, without digits, case, spacing, punctuation and line
breaks. Content-defined chunking cuts it where a rolling hash of the last letters says so, so a repeated passage gives
the same chunks wherever it stands and however it is wrapped. A chunk that stands on many distinct pages of its chart
marks the lines and the runs of text that hold it; damage inside a passage changes one or two of its chunks only.
Lines are then decided by an exact check: edit distance to the chart's frequent keys. Runs of repeated chunks inside
longer lines are given as spans whose ends are chunk borders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.session import cut, once, spread_join, store

WINDOW, MEAN_CHUNK = 3, 6
#: A line of fewer letters has too few chunks of its own, so chunks begin and end with it; all others run over line breaks.
SHORT_LINE = 32
#: A line is looked at if this share of its chunks is repeated.
MARKED_SHARE = 0.2
#: Letters of the shortest repeated run of text.
SPAN = 40
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def line_key(line: Column) -> Column:
    """Lower-case letters of a line with each run of digits as one ``#``."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "#"), r"[^a-z#\p{L}]+", "")


def _chunks(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and hashes of the chunks of strings that lie end to end in ``data``."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        values = data.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
        roll = np.zeros(n, dtype=np.uint64)
        for k in range(WINDOW):
            roll[k:] += values[: n - k] * np.uint64(pow(31, k))
        mixed = (roll ^ (roll >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        last = ((mixed >> np.uint64(33)) % np.uint64(MEAN_CHUNK)) == 0
        # A window that reaches back over the start of its string must not cut.
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        for k in range(WINDOW - 1):
            at = starts + k
            last[at[at < n]] = False
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        ends = np.flatnonzero(last) + 1
        begins = np.concatenate(([0], ends[:-1]))
        powers = np.full(n, _BASE, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * powers, dtype=np.uint64)))
        inverse = np.full(n, _INVERSE, dtype=np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        h = (sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ends, (h ^ (h >> np.uint64(30))).view(np.int64)


def _bytes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the strings of an array, from 0 on."""
    keys = pa.concat_arrays([pc.fill_null(keys.cast(pa.large_string()), "")])
    if not len(keys):
        return np.zeros(1, dtype=np.int64), np.zeros(0, np.uint8)
    buffers = keys.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[keys.offset : keys.offset + len(keys) + 1]
    return offsets - offsets[0], np.frombuffer(buffers[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]


@F.arrow_udf(T.ArrayType(T.LongType()))
def chunk_hashes(keys: pa.Array) -> pa.Array:
    """Hashes of the content-defined chunks of each key; none for an empty or null key."""
    offsets, data = _bytes(keys)
    ends, hashes = _chunks(offsets, data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(ends, offsets, side="right"), pa.int32()), pa.array(hashes, pa.int64()))


def _units(blocks: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Where chunking starts anew: at each block, and before and after each short line."""
    short = np.flatnonzero(np.diff(lines) < SHORT_LINE)
    return np.unique(np.concatenate((lines[blocks], lines[short], lines[short + 1])))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.LongType())))
def running_chunks(lines: pa.Array) -> pa.Array:
    """For each block, given as the keys of its lines: for each line the hashes of the chunks that it takes part in."""
    lines = pa.concat_arrays([lines])
    blocks = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    offsets, data = _bytes(lines.flatten())
    ends, hashes = _chunks(_units(blocks, offsets), data)
    first = np.searchsorted(ends, offsets[:-1], side="right")
    after = np.where(offsets[1:] > offsets[:-1], np.searchsorted(ends, offsets[1:], side="left") + 1, first)
    sizes = after - first
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first, sizes)
    inner = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes[at], pa.int64()))
    return pa.ListArray.from_arrays(pa.array(blocks, pa.int32()), inner)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _hot_runs(texts: pa.Array, lines: pa.Array, held: pa.Array) -> pa.Array:
    """Runs of repeated chunks of at least SPAN letters, as offsets in the text (``end`` excluded).

    ``lines`` are the keys of a text's lines and ``held`` those of its chunks that are repeated. The texts are chunked
    together; only those with a run are looked at letter by letter.
    """
    lines, held = pa.concat_arrays([lines]), pa.concat_arrays([held])
    blocks = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    offsets, data = _bytes(lines.flatten())
    ends, hashes = _chunks(_units(blocks, offsets), data)
    first = np.searchsorted(ends, offsets[blocks], side="right")
    bounds, wanted = held.offsets.to_numpy(), held.values.to_numpy(zero_copy_only=False)
    out: list[list[dict]] = []
    for n in range(len(texts)):
        at, base = ends[first[n] : first[n + 1]], offsets[blocks[n]]
        mask = np.concatenate(([False], np.isin(hashes[first[n] : first[n + 1]], wanted[bounds[n] : bounds[n + 1]]), [False]))
        edges = np.flatnonzero(mask[1:] != mask[:-1]).reshape(-1, 2)
        spans = [(int(at[i - 1] - base) if i else 0, int(at[j - 1] - base)) for i, j in edges]
        spans = [s for s in spans if s[1] - s[0] >= SPAN]
        runs: list[dict] = []
        if spans:
            text = texts[n].as_py()
            # The place in the text of each byte of the running key.
            places = [m.start() for m in _KEPT.finditer(text) for _ in ("#" if m.group()[0].isdigit() else m.group().lower()).encode()]
            runs = [{"start": places[min(i, len(places) - 1)], "end": places[j] if j < len(places) else len(text)} for i, j in spans]
        out.append(runs)
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


_KEPT = regex.compile(r"[0-9]+|\p{L}")


def _keyed(blocks: DataFrame) -> DataFrame:
    """Blocks with the keys of their lines; without those that have no text, chart or page."""
    return blocks.where("text <> '' and document_id is not null and page_number is not null").select(
        "document_id", "page_number", "block_id", F.transform(F.split("text", "\n"), line_key).alias("keys")
    )


def _pages_with(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct pages of each group; salted by page, so no task holds all rows of one group."""
    salt = F.pmod("page_number", F.lit(16))
    return (
        df.groupBy(*keys, salt.alias("salt"), "page_number").agg(F.lit(1).alias("one"))
        .groupBy(*keys, "salt").agg(F.count("*").alias("pages"))
        .groupBy(*keys).agg(F.sum("pages").alias("pages"))
    )


def _tolerance(length: Column) -> Column:
    """Edits allowed to a key of this length: none under 5 letters, else one and one more for every 8."""
    return F.when(length < 5, F.lit(0)).otherwise(F.lit(1) + F.floor(length / 8)).cast("int")


def _near(a: Column, b: Column) -> Column:
    """Whether ``a`` is ``b`` with a few edits."""
    close = F.abs(F.length(a) - F.length(b)) <= _tolerance(F.length(b))
    # The bound 16 of the first test spares most of the work; only keys of more than 120 letters need the whole distance.
    few = F.levenshtein(a, b, 16)
    return (a == b) | (close & F.when(_tolerance(F.length(b)) <= 16, (few >= 0) & (few <= _tolerance(F.length(b)))).otherwise(F.levenshtein(a, b) <= _tolerance(F.length(b))))


def with_matches(keys: DataFrame) -> DataFrame:
    """Add ``matched`` to rows with ``key``, ``own`` (its chunks) and ``anchors`` (structs of key and own).

    These are the anchors that the key equals up to small damage, else those of which two make it up, one of them
    sharing a chunk with it.
    """
    key = F.col("key")
    akin = F.transform(F.filter("anchors", lambda a: F.arrays_overlap(a["own"], F.col("own"))), lambda a: a["key"])
    keys = once(keys, _akin=akin, _all=F.transform("anchors", lambda a: a["key"]))
    near = lambda anchors: F.filter(anchors, lambda a: _near(key, a))
    beside = lambda a, b: (F.abs(F.length(key) - F.length(a) - F.length(b)) <= 6) & (
        (_near(F.substring(key, F.lit(1), F.length(a)), a) & _near(F.substring(key, F.length(a) + 1, F.length(key)), b))
        | (_near(F.substring(key, F.lit(1), F.length(b)), b) & _near(F.substring(key, F.length(b) + 1, F.length(key)), a))
    )
    pairs = F.transform(F.filter("_akin", lambda a: F.length(key) > F.length(a)), lambda a: F.struct(a.alias("a"), F.filter("_all", lambda b: beside(a, b)).alias("bs")))
    together = F.array_distinct(F.flatten(F.transform(F.filter(pairs, lambda p: F.size(p["bs"]) > 0), lambda p: F.array_append(p["bs"], p["a"]))))
    # One after the other: most keys equal an anchor that shares a chunk.
    keys = once(keys, matched=near("_akin"))
    keys = once(keys, matched=F.when(F.size("matched") > 0, F.col("matched")).otherwise(near("_all")))
    return once(keys, matched=F.when(F.size("matched") > 0, F.col("matched")).otherwise(together)).drop("_akin", "_all")


def _need(pages: DataFrame, share: float, least: int) -> DataFrame:
    """Pages on which a chart must show a line or chunk for it to count as repeated."""
    n = _pages_with(pages.where("document_id is not null and page_number is not null").select("document_id", "page_number"), "document_id")
    return n.select("document_id", F.greatest(F.lit(float(least)), F.col("pages") * share).alias("need"))


def hot_chunks(blocks: DataFrame, pages: DataFrame, share: float, least: int, lines_share: float, pages_share: float) -> DataFrame:
    """One row per chart: ``need`` and the chunks (``hot``) that stand on at least ``pages_share`` of the needed pages.

    A chart has at most (chunks of a page / (pages_share * share)) of them, whatever its number of pages. One bit for
    each page of a run of 64 counts distinct pages exactly in pre-aggregated shuffles, so no task holds a whole chart.
    """
    need = _need(pages, share, least)
    chunks = _keyed(blocks).select(F.xxhash64("document_id").alias("chart"), "page_number", F.explode(F.array_distinct(F.flatten(running_chunks("keys")))).alias("chunk"))
    run = F.floor(F.col("page_number") / 64)
    hot = (
        chunks.groupBy("chart", "chunk", run.alias("run"))
        .agg(F.count("*").alias("blocks"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, cast(pmod(page_number, 64) as int))"))).alias("pages"))
        .groupBy("chart", "chunk").agg(F.sum("blocks").alias("blocks"), F.sum("pages").alias("on_pages"))
        .where(F.col("blocks") >= least * lines_share)
        .join(need.withColumn("chart", F.xxhash64("document_id")), "chart")
        .where((F.col("blocks") >= F.col("need") * lines_share) & (F.col("on_pages") >= F.col("need") * pages_share))
    )
    return hot.groupBy("document_id").agg(F.collect_set("chunk").alias("hot"), F.first("need").alias("need"))


def _marked(blocks: DataFrame, pages: DataFrame, share: float, least: int) -> DataFrame:
    """Lines with repeated chunks: (document_id, page_number, block_id, line_no, key, need)."""
    # Looser than the rule, because damage may hide a copy: the exact check decides.
    hot = hot_chunks(blocks, pages, share, least, 0.75, 0.6)
    rows = spread_join(_keyed(blocks), hot, ["document_id"], F.col("page_number"))
    rows = rows.withColumn("chunks", running_chunks("keys"))
    lines = F.filter(
        F.transform(F.arrays_zip("keys", "chunks"), lambda x, i: F.struct((i + 1).alias("line_no"), x["keys"].alias("key"), F.array_distinct(x["chunks"]).alias("own"))),
        lambda x: (x["key"] != "") & (F.size(F.array_intersect(x["own"], F.col("hot"))) >= F.size(x["own"]) * MARKED_SHARE),
    )
    return rows.select("document_id", "page_number", "block_id", "need", F.explode(lines).alias("l")).select("document_id", "page_number", "block_id", "need", "l.line_no", "l.key")


def repeated_lines(blocks: DataFrame, pages: DataFrame, share: float = 1 / 3, least: int = 4) -> DataFrame:
    """Lines ``(document_id, page_number, block_id, line_no)`` that stand on at least ``share`` of the chart's pages.

    ``least`` is the fewest pages that count as repetition. The pages of a chart are those of ``pages``. Lines
    without letters and digits, blocks with null text, chart or page, and charts without pages give no rows; rows
    stored twice give one row. Extra columns are ignored.
    """
    marked = store(_marked(blocks, pages, share, least))
    # From here on each distinct key of a chart is looked at once, however many lines have it.
    keys = store(_pages_with(marked, "document_id", "key", "need").withColumn("own", chunk_hashes("key")))
    anchors = (
        keys.where(F.col("pages") >= F.col("need") * 0.5)
        .groupBy("document_id").agg(F.collect_list(F.struct("key", "own")).alias("anchors"))
    )
    matched = with_matches(spread_join(keys, anchors, ["document_id"], F.col("key")))
    matched = cut(matched.where(F.size("matched") > 0).select("document_id", "key", "need", "matched"))
    standing = spread_join(marked.select("document_id", "key", "page_number"), matched, ["document_id", "key"], F.col("page_number"))
    enough = (
        _pages_with(standing.select("document_id", "page_number", "need", F.explode("matched").alias("anchor")), "document_id", "anchor", "need")
        .where(F.col("pages") >= F.col("need"))
        .groupBy("document_id").agg(F.collect_set("anchor").alias("enough"))
    )
    found = spread_join(matched, enough, ["document_id"], F.col("key")).where(F.arrays_overlap("matched", "enough")).select("document_id", "key")
    return spread_join(marked, found, ["document_id", "key"], F.col("page_number")).select("document_id", "page_number", "block_id", "line_no").distinct()


def repeated_spans(blocks: DataFrame, pages: DataFrame, share: float = 1 / 3, least: int = 4) -> DataFrame:
    """Runs of running text, of SPAN letters or more, whose chunks each stand on at least ``share`` of the chart's pages.

    Columns: document_id, page_number, block_id, start, end (offsets in the text), whatever lines the run begins and
    ends in. The cuts lie at chunk borders, so up to a chunk of the repeated passage may stay at either end. Blocks
    with null or empty text, chart or page give no rows; rows stored twice give one.
    """
    hot = hot_chunks(blocks, pages, share, least, 1.0, 1.0)
    rows = blocks.where("text <> '' and document_id is not null and page_number is not null").select("document_id", "page_number", "block_id", "text")
    rows = spread_join(rows, hot, ["document_id"], F.col("page_number")).withColumn("keys", F.transform(F.split("text", "\n"), line_key))
    held = F.array_intersect(F.array_distinct(F.flatten(running_chunks("keys"))), F.col("hot"))
    rows = once(rows.select("document_id", "page_number", "block_id", "text", "keys", held.alias("held")), held=F.col("held")).where(F.size("held") > 0)
    return rows.select("document_id", "page_number", "block_id", F.explode(_hot_runs("text", "keys", "held")).alias("s")).select("document_id", "page_number", "block_id", "s.*").distinct()


def without_repeats(blocks: DataFrame, pages: DataFrame, **limits) -> DataFrame:
    """The blocks with ``kept_text``: the text without the chart's repeated lines, all other lines in order.

    ``removed`` counts the lines taken out. A null text stays null; a block of repeated lines only gets ''.
    """
    found = repeated_lines(blocks, pages, **limits)
    key = ["document_id", "page_number", "block_id"]
    gone = found.groupBy(*key).agg(F.collect_set("line_no").alias("gone"))
    kept = F.array_join(
        F.transform(
            F.filter(
                F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x"))),
                lambda s: ~F.coalesce(F.array_contains(F.col("gone"), s["n"]), F.lit(False)),
            ),
            lambda s: s["x"],
        ),
        "\n",
    )
    own = blocks.select(*key, "text", "block_type")
    return own.join(gone, key, "left").select(
        *key, "block_type", kept.alias("kept_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed")
    )
