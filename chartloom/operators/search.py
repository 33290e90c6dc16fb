"""Search channels over tables of texts and vectors: BM25, exact terms, structured facts, dense vectors, late interaction.

Every channel takes a table of queries and returns hits (query_id, id, score, rank). Scores are rounded to six places
before ranking and ties go to the lower id, so that results don't depend on partitioning.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.text import tokens
from chartloom.session import cut, once, spread_join

K1, B, EPSILON = 1.5, 0.75, 0.25


def top(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The ``k`` best rows of each query with their rank; the window is pruned before the shuffle."""
    order = W.partitionBy(by).orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _tokens(texts: DataFrame) -> Column:
    """The texts' column ``tokens`` where they have one, else their tokens computed now."""
    return F.col("tokens") if "tokens" in texts.columns else tokens(F.col("text"))


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, df): in how many of the texts (id, text) or (id, tokens) a term stands."""
    return texts.select(F.explode(F.array_distinct(_tokens(texts))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _packed(rows: DataFrame, key: str, size: int, prefix: str) -> DataFrame:
    """Sparse rows (key, terms, weights, rare) put together in blocks of about ``size``, along the partitions without a shuffle."""
    kind = rows.schema[key].dataType
    schema = T.StructType([
        T.StructField(prefix + "no", T.LongType()), T.StructField(prefix + "ids", T.ArrayType(kind)), T.StructField(prefix + "sizes", T.ArrayType(T.IntegerType())),
        T.StructField(prefix + "terms", T.ArrayType(T.LongType())), T.StructField(prefix + "weights", T.ArrayType(T.DoubleType())),
    ])
    flat = [c for c in ("terms", "weights", "rare") if c in rows.columns]
    if "rare" in flat:
        schema.add(prefix + "rare", T.ArrayType(T.DoubleType()))

    def pack(frames):
        no = TaskContext.get().partitionId() << 32
        for frame in frames:
            for at in range(0, len(frame), size):
                part, no = frame.iloc[at : at + size], no + 1
                yield pd.DataFrame(dict(zip(schema.names, ([no], [part[key].to_numpy()], [part["terms"].map(len).to_numpy(dtype=np.int32)], *([np.concatenate([np.asarray(x) for x in part[c]])] for c in flat)))))

    return rows.select(key, *flat).mapInPandas(pack, schema)


#: From this share of its pairs of queries and items a term is multiplied as part of a matrix, below it pair by pair.
DENSE_SHARE = 0.004


class _Best:
    """The ``k`` best items so far of each query of one block; blocks of items are added one after another.

    Once a query has k items, only those that beat the last of them are kept. Blocks that come in the order of their ids
    need not be looked at for ties, which lose to the lower ids that are there; in any other order the result is the same.
    """

    def __init__(self, ids, sizes, terms, weights, rare, k: int, bonus: float):
        self.queries, self.k, self.bonus, n = np.asarray(ids), k, bonus, len(ids)
        self.columns, col = np.unique(terms, return_inverse=True)
        order = np.argsort(col, kind="stable")
        self.col, self.row, self.weight = col[order], np.repeat(np.arange(n), sizes)[order], np.asarray(weights)[order]
        rare = np.asarray(rare)[order] > 0
        self.pairs = rare & (np.bincount(self.row, weights=rare, minlength=n) >= 2)[self.row]
        self.asked = np.bincount(self.col, minlength=len(self.columns))
        self.least, self.ids, self.count, self.ordered, self.fresh = np.zeros(n), [], 0, True, 0
        self.found = [(np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64))]

    def _meet(self, chosen, held, starts):
        """For the chosen terms of queries all terms of items that meet them: places in both lists."""
        entry = np.flatnonzero(chosen & (held[self.col] > 0))
        n = held[self.col[entry]]
        first = starts[self.col[entry]] - (np.cumsum(n) - n)
        return np.repeat(entry, n), np.arange(n.sum()) + np.repeat(first, n)

    def add(self, ids, sizes, terms, weights) -> None:
        ids, n = np.asarray(ids), len(self.queries)
        m, place = len(ids), np.arange(len(ids))
        if not (ids[1:] > ids[:-1]).all():
            order = np.argsort(ids, kind="stable")
            ids, place[order] = ids[order], np.arange(m)
        if self.ids and not ids[0] > self.ids[-1][-1]:
            self.ordered = False
        at = np.minimum(np.searchsorted(self.columns, terms), len(self.columns) - 1)
        known = np.flatnonzero(self.columns[at] == terms)
        known = known[np.argsort(at[known], kind="stable")]
        item, col, weight = np.repeat(place, sizes)[known], at[known], np.asarray(weights)[known]
        held = np.bincount(col, minlength=len(self.columns))
        starts = np.cumsum(held) - held
        whole = held * self.asked > DENSE_SHARE * n * m
        if whole.any():
            to = np.cumsum(whole) - 1
            q, d = np.zeros((n, to[-1] + 1)), np.zeros((to[-1] + 1, m))
            e, f = whole[self.col], whole[col]
            q[self.row[e], to[self.col[e]]] = self.weight[e]
            d[to[col[f]], item[f]] = weight[f]
            s = q @ d
        else:
            s = np.zeros((n, m))
        a, b = self._meet(~whole[self.col], held, starts)
        np.add.at(s.reshape(-1), self.row[a] * m + item[b], self.weight[a] * weight[b])
        if self.bonus and self.pairs.any():
            a, b = self._meet(self.pairs, held, starts)
            both = np.zeros(n * m, dtype=np.int16)
            np.add.at(both, self.row[a] * m + item[b], (weight[b] > 0).astype(np.int16))
            s = np.round(s, 6)
            s.reshape(-1)[both >= 2] += self.bonus
        self._keep(s)
        self.ids.append(ids)
        self.count += m
        if self.fresh > n * max(8, self.k // 8):
            self._compact()

    def _keep(self, s) -> None:
        """Hand on the scores that may be among the best; scores are rounded, but for a bonus added to a rounded one."""
        m, tight = s.shape[1], 0.0 if self.bonus else 6e-7
        row, col = np.divmod(np.flatnonzero(s > (self.least - tight)[:, None] if self.ordered else s >= (self.least - tight)[:, None]), m)
        if len(row) > 2 * self.k * len(s) and m > self.k:
            s = s if self.bonus else np.round(s, 6)
            last = np.partition(s, m - self.k, axis=1)[:, m - self.k][:, None]
            over, tied = s > last, s == last
            row, col = np.nonzero(over | (tied & (np.cumsum(tied, axis=1) <= self.k - over.sum(axis=1)[:, None])))
        score = s[row, col] if self.bonus else np.round(s[row, col], 6)
        good = (score > 0) & ((score > self.least[row]) if self.ordered else (score >= self.least[row]))
        self.found.append((row[good], score[good], col[good] + self.count))
        self.fresh += int(good.sum())

    def _compact(self) -> None:
        row, score, place = (np.concatenate(x) for x in zip(*self.found))
        by = place if self.ordered else np.argsort(np.argsort(np.concatenate(self.ids), kind="stable"), kind="stable")[place]
        order = np.lexsort((by, -score, row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kept = order[nth < self.k]
        full = nth == self.k - 1
        self.least[row[full]] = score[order[full]]
        self.found, self.fresh = [(row[nth < self.k], score[kept], place[kept])], 0

    def rows(self) -> pd.DataFrame:
        self._compact()
        row, score, place = self.found[0]
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, dtype=object)
        return pd.DataFrame({"g": self.queries[row], "id": ids[place], "score": score})


def sparse(items: DataFrame, queries: DataFrame, k: int, bonus: float = 0.0, block: int = 1024, asked: int = 1024, share: int = 65536, total: int | None = None) -> DataFrame:
    """Dot products of sparse rows: the ``k`` best items of each query with a positive score (query_id, id, score, rank).

    ``items`` is (id, terms, weights) and ``queries`` (query_id, terms, weights), with terms as 64-bit keys, distinct in a
    row. A query's ``rare`` holds 1.0 for its rare terms; an item with two of them gains ``bonus``. Queries with equal
    rows are scored once. A task meets one block of queries with a slice of about ``share`` items (of ``total``, counted
    if not given), block by block, and hands on the k best of each query: no term is a join key, so a term that every row
    has costs no more than another, and what is shuffled is bounded by k rows per query and slice.
    """
    rare = F.col("rare") if "rare" in queries.columns else F.transform("weights", lambda w: F.lit(0.0))
    wanted = queries.where(F.size("terms") > 0).select("query_id", "terms", "weights", rare.alias("rare"))
    wanted = cut(wanted.withColumn("g", F.md5(F.to_json(F.struct("terms", "weights", "rare")))))
    groups = cut(wanted.groupBy("g").agg(*(F.first(c).alias(c) for c in ("terms", "weights", "rare")), F.ceil(F.count("*") / 4096).cast("int").alias("parts")))
    columns = math.ceil(groups.count() / asked) or 1
    total = items.count() if total is None else total
    slices = max(1, math.ceil(total / share), min(math.ceil(total / 8192), math.ceil(16 / columns)))
    left = cut(_packed(items.where(F.size("terms") > 0).select("id", "terms", "weights").repartition(slices, "id").sortWithinPartitions("id"), "id", block, ""))
    right = cut(_packed(groups.select("g", "terms", "weights", "rare").repartition(columns, "g"), "g", 2 * asked, "q"))
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("id", items.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def products(frames):
        best: dict[int, _Best] = {}
        for frame in frames:
            for _, ids, sizes, terms, weights, no, *asking in frame.itertuples(index=False):
                if no not in best:
                    best[no] = _Best(*asking, k, bonus)
                best[no].add(ids, sizes, terms, weights)
        for x in best.values():
            yield x.rows()

    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    found = top(pairs.mapInPandas(products, schema), k, "g").select("g", "id", "score", "rank")
    # The hits of a row that very many queries ask are repeated for parts of these.
    parts = groups.select("g", "parts")
    spread = found.join(parts, "g").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    members = spread_join(wanted.select("query_id", "g"), parts, ["g"], F.col("query_id")).withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
    return members.join(spread, ["g", "_part"]).select("query_id", "id", "score", "rank")


def _rows(terms: DataFrame, key: str, term: Column, weight: Column, rare: Column | None = None) -> DataFrame:
    """Sparse rows from (key, term, weight), one per key; the terms of a row are distinct."""
    columns = [F.xxhash64(term).alias("t"), weight.cast("double").alias("w"), (F.lit(0.0) if rare is None else rare.cast("double")).alias("r")]
    lists = terms.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("x"))
    part = lambda name: F.transform("x", lambda s: s[name])
    return lists.select(key, part("t").alias("terms"), part("w").alias("weights"), part("r").alias("rare"))


def weighted_features(features: DataFrame, key: str) -> DataFrame:
    """Sparse rows from (key, feature, amount); the amounts of a repeated feature add up."""
    summed = features.where("feature is not null").groupBy(key, "feature").agg(F.sum("amount").alias("amount"))
    return _rows(summed, key, F.col("feature"), F.col("amount"))


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """The second column of a batch, lists: the row of each element, and the elements."""
    lists = batch.column(1)
    return np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()


def _batch(batch: pa.RecordBatch, key: str, row: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    """Sparse rows from the elements of all rows, in the order of the rows."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32))
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (terms.astype(np.int64), weights.astype(np.float64)))], [key, "terms", "weights"])


def _sparse_schema(rows: DataFrame, key: str) -> T.StructType:
    return T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])


#: Most distinct query terms that are sent to the tasks; with more, a text's row keeps all its terms.
SENT_TERMS = 1 << 22


def bm25(texts: DataFrame, queries: DataFrame, k: int = 60, terms: DataFrame | None = None) -> DataFrame:
    """Okapi BM25 of (query_id, text) against (id, text) or (id, tokens), both with unique ids; only positive scores are hits.

    The idf is ln(N - df + 0.5) - ln(df + 0.5); a negative one is replaced by a quarter of the mean idf of the
    vocabulary. Repeated query terms count repeatedly. Queries with the same words are scored once. ``terms`` are the
    stored counts of the texts' terms (term, df), else they are counted.
    """
    texts = texts.select("id", _tokens(texts).alias("tokens"))
    stats = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total")).first()  # one row
    n, mean = stats["n"], stats["total"] / max(1, stats["n"])
    df = (term_counts(texts) if terms is None else terms).withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = df.agg((F.avg("raw") * EPSILON).alias("floor"))  # one row
    wanted = cut(queries.where("text is not null").select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")))
    words = cut(wanted.select("term").distinct())
    idf = df.join(words, "term", "left_semi").crossJoin(F.broadcast(floor)).select("term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    # Of a text only the terms that some query has.
    sent = words.count() <= SENT_TERMS
    keys = np.sort(words.select(F.xxhash64("term").alias("t")).toPandas()["t"].to_numpy(dtype=np.int64)) if sent else None

    def rows(batches):
        for batch in batches:
            row, terms = _lists(batch)
            terms = terms.to_numpy(zero_copy_only=False)
            lengths = np.bincount(row, minlength=batch.num_rows)
            known = np.unique(terms) if keys is None else keys
            if len(known):
                at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                there = known[at] == terms
                pairs, tf = np.unique(row[there] * len(known) + at[there], return_counts=True)
                row, at = np.divmod(pairs, len(known))
                yield _batch(batch, "id", row, known[at], tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / mean)))

    found = texts.select("id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("t")).mapInArrow(rows, _sparse_schema(texts, "id"))
    asked = spread_join(wanted, idf, ["term"], F.col("query_id"))
    return sparse(found, _rows(asked, "query_id", F.col("term"), F.col("qtf") * F.col("idf")), k, total=n)


def exact(texts: DataFrame, needles: DataFrame, k: int = 80) -> DataFrame:
    """Hits of needles (query_id, needle): the sum of min(1 + sqrt(N / df), 40), 20 more for two rare ones.

    A needle is one word or several; a text holds it if its search tokens stand in the text's in a row. It is rare if
    fewer than max(80, 2 % of all texts) hold it.
    """
    texts = texts.select("id", _tokens(texts).alias("tokens"))
    joined = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    wanted = needles.where("needle is not null").select("query_id", "needle").distinct()
    forms = wanted.select("needle").distinct().select("needle", tokens(F.col("needle")).alias("t")).where(F.size("t") > 0)
    # Looked up by its longest word; one of several words is then compared as a whole, with a text put together once.
    word = F.array_max(F.transform("t", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    forms = cut(forms.select(word.alias("word"), F.struct("needle", joined("t").alias("form"), (F.size("t") == 1).alias("whole")).alias("f")).groupBy("word").agg(F.collect_list("f").alias("forms")))
    rows = once(texts, body=joined("tokens")).select("id", "body", F.explode(F.array_distinct("tokens")).alias("word"))
    there = F.filter("forms", lambda f: f["whole"] | F.col("body").contains(f["form"]))
    found = cut(spread_join(rows, forms, ["word"], F.col("id")).select("id", F.explode(F.transform(there, lambda f: f["needle"])).alias("needle")))
    size = texts.agg(F.count("*").alias("n"))  # one row
    df = found.groupBy("needle").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size)).select(
        "needle", F.least(1 + F.sqrt(F.col("n") / F.col("df")), F.lit(40.0)).alias("weight"), (F.col("df") < F.greatest(F.lit(80.0), F.col("n") * 0.02)).alias("rare")
    )
    asked = spread_join(wanted, df, ["needle"], F.col("query_id"))
    return sparse(_rows(found, "id", F.col("needle"), F.lit(1.0)), _rows(asked, "query_id", F.col("needle"), F.col("weight"), F.col("rare")), k, bonus=20.0)


def hashed_vectors(texts: DataFrame, key: str = "id", size: int = 256, known: DataFrame | None = None) -> DataFrame:
    """Term counts of (key, text) or (key, tokens) hashed to ``size`` dimensions, of length 1, as sparse rows.

    The built-in stand-in for an encoder; any other table of sparse or dense vectors takes its place. With ``known``
    (term, ...) only those terms count, so that a query of unknown words is near to nothing.
    """
    rows = texts.select(F.col(key), _tokens(texts).alias("tokens"))
    if known is not None:
        words = rows.select(key, F.explode("tokens").alias("term"))
        there = spread_join(known.select("term"), words.select("term").distinct(), ["term"], F.col("term"))
        rows = spread_join(words, there, ["term"], F.col(key)).groupBy(key).agg(F.collect_list("term").alias("tokens"))

    def hashed(batches):
        for batch in batches:
            row, words = _lists(batch)
            words = words.dictionary_encode()
            slots = np.array([int(md5(w.encode()).hexdigest()[:6], 16) % size for w in words.dictionary.to_pylist()], dtype=np.int64)
            if len(slots):
                counts = np.bincount(row * size + slots[words.indices.to_numpy(zero_copy_only=False)], minlength=batch.num_rows * size).reshape(-1, size)
                norm = np.sqrt((counts * counts).sum(axis=1))
                row, at = np.nonzero(counts)
                yield _batch(batch, key, row, at, counts[row, at] / norm[row])

    return rows.where(F.size("tokens") > 0).mapInArrow(hashed, _sparse_schema(rows, key))


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows (ids, values) of about ``size`` vectors each, cut along the scan's partitions without a shuffle."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def pack(frames):
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                yield pd.DataFrame({"ids": [part["id"].to_numpy()], "values": [np.concatenate([np.asarray(v, dtype=np.float64) for v in part["vector"]])]})

    return vectors.where("vector is not null and id is not null").select("id", "vector").mapInPandas(pack, schema)


_SCORED = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """Dot products of all query vectors with all vectors, the ``k`` best of each query; both tables are (id, vector).

    Query and vector blocks meet pairwise; a pair keeps the k best of each of its queries, so what is shuffled is
    bounded by k rows per query and block.
    """

    def products(frames):
        for frame in frames:
            for ids, values, qids, qvalues in zip(frame["ids"], frame["values"], frame["qids"], frame["qvalues"]):
                q = np.asarray(qvalues).reshape(len(qids), -1)
                s = np.round(q @ np.asarray(values).reshape(len(ids), -1).T, 6)
                ids = np.asarray(ids)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(qids), order.shape[1]), "id": ids[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    asked = _blocks(queries, 256).toDF("qids", "qvalues")
    pairs = _blocks(vectors, block).join(asked)
    return top(pairs.mapInPandas(products, _SCORED), k)


def pooled(vectors: DataFrame, group: Column) -> DataFrame:
    """The mean of each group's vectors with length 1: (id, vector)."""
    rows = vectors.where("vector is not null").select(group.alias("id"), F.posexplode("vector").alias("i", "x"))
    mean = rows.groupBy("id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    lists = mean.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return lists.select("id", F.transform("v", lambda s: F.round(s["m"] / F.col("norm"), 9)).alias("vector"))


def _grouped(rows: DataFrame, prefix: str, members: int = 1024, block: int = 256) -> DataFrame:
    """Blocks of whole groups: (ids, sizes, values, parts). A group of more than ``members`` vectors comes in several parts."""
    rows = rows.where("vector is not null and id is not null").select("id", "member", F.col("vector").cast("array<double>").alias("vector"))
    parts = rows.groupBy("id").agg(F.ceil(F.count("*") / members).cast("int").alias("parts"))
    salted = spread_join(rows, parts, ["id"], F.col("member")).withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")))
    lists = salted.groupBy("id", "part", "parts").agg(F.flatten(F.collect_list("vector")).alias("values"), F.count("*").cast("int").alias("size")).select("id", "parts", "values", "size")
    schema = f"{prefix}ids array<bigint>, {prefix}sizes array<int>, {prefix}values array<double>, {prefix}parts array<int>"

    def pack(frames):
        for frame in frames:
            for at in range(0, len(frame), block):
                part = frame.iloc[at : at + block]
                yield pd.DataFrame({prefix + "ids": [part["id"].to_numpy()], prefix + "sizes": [part["size"].to_numpy()], prefix + "values": [np.concatenate([np.asarray(v) for v in part["values"]])], prefix + "parts": [part["parts"].to_numpy()]})

    return lists.mapInPandas(pack, schema)


def late_interaction(groups: DataFrame, queries: DataFrame, k: int = 10, coarse: int | None = None) -> DataFrame:
    """Sum over a query's vectors of the best dot product within a group; the ``k`` best groups of each query.

    Both tables are (id, member, vector) with several vectors per id. Blocks of groups are multiplied with blocks of
    queries, and a pair of blocks keeps k groups per query. With ``coarse`` only that many groups nearest by their mean
    are compared, which is faster and not exact; the README gives its recall.
    """
    if coarse:
        near = dense(pooled(groups, F.col("id")), pooled(queries, F.col("id")), coarse).select("query_id", "id")
        asked = queries.select(F.col("id").alias("query_id"), F.col("member").alias("q"), F.col("vector").alias("qv"))
        dot = F.aggregate(F.zip_with("qv", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
        best = near.join(groups, "id").join(asked, "query_id").groupBy("query_id", "id", "q").agg(F.max(dot).alias("best"))
        return top(best.groupBy("query_id", "id").agg(F.round(F.sum("best"), 6).alias("score")), k)

    def products(frames):
        for frame in frames:
            for ids, sizes, values, parts, qids, qsizes, qvalues, _ in frame.itertuples(index=False):
                s = np.asarray(qvalues).reshape(int(np.sum(qsizes)), -1) @ np.asarray(values).reshape(int(np.sum(sizes)), -1).T
                starts, qstarts = (np.concatenate(([0], np.cumsum(x)[:-1])).astype(np.int64) for x in (sizes, qsizes))
                best = np.maximum.reduceat(s, starts, axis=1)
                ids, qids, whole = np.asarray(ids), np.asarray(qids), np.asarray(parts) == 1
                # Of a group in several parts each vector's best so far is handed on.
                row, col = np.nonzero(np.broadcast_to(~whole, best.shape))
                yield pd.DataFrame({"query_id": np.repeat(qids, qsizes)[row], "id": ids[col], "q": (row - np.repeat(qstarts, qsizes)[row]).astype("int32"), "score": best[row, col]})
                if whole.any():
                    score, own = np.round(np.add.reduceat(best[:, whole], qstarts, axis=0), 6), ids[whole]
                    order = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :k]
                    yield pd.DataFrame({"query_id": np.repeat(qids, order.shape[1]), "id": own[order].ravel(), "q": np.full(order.size, -1, dtype="int32"), "score": np.take_along_axis(score, order, 1).ravel()})

    # A query's vectors stay together; they are few.
    pairs = _grouped(groups, "").crossJoin(_grouped(queries, "q", members=1 << 30, block=32))
    scored = cut(pairs.mapInPandas(products, "query_id long, id long, q int, score double"))
    parted = scored.where("q >= 0").groupBy("query_id", "id", "q").agg(F.max("score").alias("best")).groupBy("query_id", "id").agg(F.round(F.sum("best"), 6).alias("score"))
    return top(scored.where("q < 0").select("query_id", "id", "score").unionByName(parted), k)
