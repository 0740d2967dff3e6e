"""The review log and the event table as streams: deduplication, current state, windows, a first-in-first-out queue.

Late data is dropped only beyond the watermark, which is a parameter. State is keyed and kept by Spark's state store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(events: DataFrame, key: str = "id", at: str = "ingested_at", watermark: str = "10 days") -> DataFrame:
    """Each key once, if its copies arrive within the watermark of one another."""
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])


def current_state(events: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The latest value of each key, in update or complete mode; order ends in a unique column."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(order[0]).alias("last_at"))


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], value: str, watermark: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, watermark).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,6)")).alias("total")).select("w.start", "w.end", *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], watermark: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, watermark).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *keys, "n")


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs over what is there and ends: a batch that remembers how far it came."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def upsert_state(state: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Changed keys of each micro-batch, for a sink that merges them. The sink sees a batch again after a failure: it must be idempotent."""
    return state.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def claim_fifo(jobs: DataFrame, per_worker: int, worker: str = "worker") -> DataFrame:
    """The first waiting jobs of each worker by creation and id, marked as running."""
    w = W.partitionBy(worker).orderBy("created_at", "id")
    return jobs.where(F.col("status") == "pending").withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_worker).drop("turn").withColumn("status", F.lit("running"))


def run_jobs(jobs: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], failed: Callable[[DataFrame, str], None]) -> StreamingQuery:
    """Each micro-batch of jobs to a handler; an error goes to `failed` with its text and ends no stream."""
    def each(batch: DataFrame, number: int) -> None:
        try:
            handle(batch, number)
        except Exception as e:  # noqa: BLE001
            failed(batch, str(e)[:500])

    return jobs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
