"""An inverted-file index over vectors: cells around centres, searched by probing the cells nearest to a query."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.operators.search import top


def cells_for(vectors: DataFrame, least: int = 32) -> int:
    """The number of cells for a table of vectors: the root of their number, ``least`` at least."""
    return max(least, math.isqrt(max(0, vectors.where("vector is not null").count() - 1)) + 1)


def fit_centres(vectors: DataFrame, cells: int | None = None, sample: int = 50_000, steps: int = 12, seed: int = 7) -> np.ndarray:
    """Centres by k-means on at most ``sample`` vectors, taken by the hash of their id; the rest of the work covers all rows.

    Without ``cells`` their number grows with the root of the number of vectors, up to a sixteenth of the sample.
    """
    cells = min(cells or cells_for(vectors), max(1, sample // 16))
    rows = vectors.where("vector is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    x = np.array([r.vector for r in rows], dtype=np.float64)
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(steps):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def assign(vectors: DataFrame, centres: np.ndarray, cells: int = 1) -> DataFrame:
    """(id, vector, cell): each vector in its ``cells`` nearest cells. All rows are assigned, in Arrow batches."""
    half = 0.5 * (centres**2).sum(1)

    def nearest(frames):
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in frame["vector"]])
            order = np.argsort(half - x @ centres.T, axis=1)[:, :cells]
            yield pd.DataFrame({"id": np.repeat(frame["id"].to_numpy(), order.shape[1]), "vector": np.repeat(frame["vector"].to_numpy(), order.shape[1]), "cell": order.ravel().astype("int32")})

    return vectors.where("vector is not null and id is not null").select("id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(nearest, "id long, vector array<double>, cell int")


def search_cells(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 10, share: float = 0.25, block: int = 1024) -> DataFrame:
    """The ``k`` best dot products of each query within its nearest cells, a ``share`` of all: (query_id, id, score, rank).

    A cell's vectors are put into blocks of about ``block`` and multiplied with blocks of the queries that probe the cell;
    a pair of blocks keeps k rows per query. So a cell that holds a third of all vectors is many tasks' work.
    """
    if not len(centres):
        return top(index.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0), k)
    probes = max(1, math.ceil(share * len(centres)))

    def blocks(rows: DataFrame, prefix: str, size: int) -> DataFrame:
        parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))  # one row per cell
        rows = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        lists = rows.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "vector")).alias("x"))
        return lists.select("cell", F.transform("x", lambda s: s["id"]).alias(prefix + "ids"), F.flatten(F.transform("x", lambda s: s["vector"])).alias(prefix + "values"))

    def products(frames):
        for frame in frames:
            for ids, values, qids, qvalues in zip(frame["ids"], frame["values"], frame["qids"], frame["qvalues"]):
                ids, qids = np.asarray(ids), np.asarray(qids)
                s = np.round(np.asarray(qvalues).reshape(len(qids), -1) @ np.asarray(values).reshape(len(ids), -1).T, 6)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(qids, order.shape[1]), "id": ids[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    pairs = blocks(index, "", block).join(blocks(assign(queries, centres, probes), "q", 256), "cell")
    return top(pairs.mapInPandas(products, "query_id long, id long, score double"), k)
