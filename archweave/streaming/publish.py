"""The event pipeline on streams: the same Column functions as on tables, and keyed state for read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave.contract import Contract
from archweave.operators.events import buffer_status, publish_pipeline

EVENT = "event_id long, occurred_at timestamp, correlation_id string, value double, payload string, intent string, source string, event_version string"


def stream_events(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", max_files).parquet(path)


def published(events: DataFrame, contract: Contract) -> DataFrame:
    """Stateless: no shuffle, no watermark."""
    return publish_pipeline(events, contract)


def write_published(events: DataFrame, accepted: str, rejected: str, checkpoint: str):
    """Accepted and rejected events to two tables. A batch that is written again replaces its own partition."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        for path, kept in ((accepted, "reject is null"), (rejected, "reject is not null")):
            batch.where(kept).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def stream_buffer_status(changes: DataFrame) -> DataFrame:
    """Current status of each buffered event; update mode, one row of state an id."""
    return buffer_status(changes)


def stream_projection(events: DataFrame, late: str, every: str) -> DataFrame:
    """Counts by intent and window of event time; rows later than ``late`` are dropped, so state is bounded."""
    return events.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", every), "intent").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
