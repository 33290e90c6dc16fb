"""Streaming twins of the job operators: events arrive as files, state is kept per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from chartloom.session import ship


def job_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of job events from parquet files that appear in ``path``."""
    ship(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_jobs_stream(events: DataFrame) -> DataFrame:
    """The last event of each job as a streaming aggregate, to be written in update or complete mode.

    The state of a job is one row, whatever the number of its events; late and repeated events change nothing.
    """
    rest = [c for c in events.columns if c != "job_id"]
    return (
        events.where("job_id is not null").groupBy("job_id")
        .agg(F.max_by(F.struct(*rest), F.struct("updated_at", "attempts", "status")).alias("e")).select("job_id", "e.*")
    )


def windowed_counts(events: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events by hour and status with a watermark: (window_start, status, events); later events are dropped."""
    timed = events.withColumn("at", F.timestamp_seconds("updated_at")).withWatermark("at", delay)
    counted = timed.groupBy(F.window("at", window).alias("w"), "status").agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), "status", "events")


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; a later call goes on from the checkpoint."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.outputMode("append").format("parquet").option("path", sink).start()
    # Read back with ``read_versions``: each batch's changed rows replace the sink's rows of the same job in a table of versions, newest batch wins.
    return writer.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{sink}/batch={n}")).start()


def read_versions(spark: SparkSession, sink: str, key: str = "job_id") -> DataFrame:
    """What an update stream wrote with ``run_once``: of each key the row of the newest batch."""
    rows = spark.read.parquet(sink)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("e")).select(key, "e.*")
