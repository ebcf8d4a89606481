"""Registered queries of stream operators: derived facts arrive file by file, the current rows are read back; with their SQL.

The files, the stream's checkpoint and its table are in a folder of their own in spark.checkpoint.dir.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave.derive import facts, with_views
from archweave.lineage import checkpoint_dir
from archweave.streaming import state

Query = Callable[[SparkSession, str], DataFrame]


def _streamed(rows: DataFrame, build: Callable[[DataFrame], DataFrame], keys: list[str], number: str, files: int = 2) -> DataFrame:
    """The current rows after a stream over ``rows``: first those of an even ``number``, then, started anew from its checkpoint, the others."""
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4()}"
    for half in range(2):
        rows.where(F.pmod(number, F.lit(2)) == half).repartition(files).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
        state.write_latest(build(stream), f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state.latest(spark.read.parquet(f"{folder}/out"), keys)


#: All rows have the same event time, so that none is late.
_NOW = "timestamp '2026-01-01 00:00:00'"


def stream_workflows(spark: SparkSession, sf: str) -> DataFrame:
    steps = facts(spark, sf, "workflow_steps").withColumns({"timeout_ms": F.lit(None).cast("long"), "at": F.expr(_NOW)})
    return _streamed(steps, state.stream_workflows, ["workflow_id"], "seq").drop("error")


def _fold(held: dict, event: dict) -> dict:
    values = [x for x in (held["best"], event["value"]) if x is not None]
    return {"n_orders": held["n_orders"] + (event["intent"] == "Domain.Order.Placed"), "best": max(values, default=None)}


def stream_read_model(spark: SparkSession, sf: str) -> DataFrame:
    events = facts(spark, sf, "domain_events").select("event_id", F.col("occurred_at").cast("timestamp").alias("occurred_at"), "correlation_id", "intent", "value")
    found = _streamed(events, lambda s: state.stream_read_model(s, ["correlation_id"], _fold, {"n_orders": 0, "best": None}, late="36500 days"), ["correlation_id"], "event_id")
    model = F.from_json("state", "n_orders bigint, best double")
    return found.select("correlation_id", model["n_orders"].alias("n_orders"), model["best"].alias("best"), "applied", "last_intent")


def stream_buffer(spark: SparkSession, sf: str) -> DataFrame:
    status = F.expr("CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'dispatched' END")
    rows = facts(spark, sf, "domain_events")
    error = F.expr("CASE WHEN event_id % 3 = 1 THEN concat('e', event_id) END")
    changes = rows.select(F.col("correlation_id").alias("id"), F.col("event_id").alias("seq"), status.alias("status"), error.alias("error"), F.expr(_NOW).alias("at"))
    return _streamed(changes, state.stream_buffer, ["id"], "seq")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (stream_workflows, stream_read_model, stream_buffer)}


def oracle_sql(batch: dict[str, str]) -> dict[str, str]:
    """batch: the SQL of the same operators on tables."""
    return {
        "stream_workflows": batch["workflow_state"],
        "stream_buffer": batch["buffer_status"],
        "stream_read_model": f"{with_views('domain_events')} SELECT correlation_id, count(*) FILTER (intent = 'Domain.Order.Placed') AS n_orders, max(value) AS best, count(*) AS applied, arg_max(intent, (occurred_at, event_id)) AS last_intent FROM domain_events GROUP BY correlation_id",
    }
