"""Session helpers: reading the given tables and cutting lineage through shared storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per Spark context, whatever their import path is."""
    sc = spark.sparkContext
    if getattr(sc, "_chartloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="chartloom-"), "chartloom"), "zip", os.path.dirname(here), "chartloom")
    sc.addPyFile(archive)
    sc._chartloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of the data directory (a file or a directory of parquet files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder. On a local master without one (tests) a temporary folder is made; a
    cluster without one is an error, because a folder of one machine would lose data with that machine."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="chartloom-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder; an executor lost later costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a compressed table under the shared checkpoint folder and read it back.

    For wide intermediate tables of which later steps read some columns only. The tables of an application lie in one
    folder, which goes when its session ends in order.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if folder not in _STORED:
        _STORED.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STORED: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone: the folder stays for the cluster's own cleaning
        pass


#: Most bytes of a table that is broadcast, by the length of its rows as JSON.
BROADCAST_BYTES = 32 << 20


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table has at most ``most`` bytes."""
    size = F.octet_length(F.to_json(F.struct(*(F.col(c) for c in df.columns))))
    return (df.agg(F.sum(size)).first()[0] or 0) <= most


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise ``df`` and mark it for broadcast if it has at most ``most`` bytes; else it is joined by shuffle."""
    df = cut(df)
    return F.broadcast(df) if is_small(df, most) else df


def spread_join(large: DataFrame, small: DataFrame, on: list[str], salt: Column, how: str = "inner", parts: int = 16, most: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``large`` with a table that has one row per key, whatever share of ``large`` one key holds.

    A small table is broadcast. A larger one is repeated once per salt and joined by shuffle, so a hot key is spread
    over ``parts`` tasks.
    """
    small = cut(small)
    if is_small(small, most):
        return large.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return large.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def once(df: DataFrame, **columns) -> DataFrame:
    """Add costly columns that are computed once per row, however often later expressions and filters use them.

    Catalyst copies a projected expression into each filter and expression above it, but never a generated column.
    """
    for name, c in columns.items():
        df = df.select(*[x for x in df.columns if x != name], F.explode(F.array(c)).alias(name))
    return df
