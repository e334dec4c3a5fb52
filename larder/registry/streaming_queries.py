"""Structured Streaming jobs, run to the end of the available files."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.registry.base import f32, query
from larder.session import scratch_path
from larder.streaming import incremental as inc


def incoming(fx, parts=4):
    """The events table as several files, oldest day first."""
    events = fx.raw("events").select("event_id", "ts", "user_id", "event_type", "value")
    folder = scratch_path(fx.spark, "incoming")
    events.repartitionByRange(parts, "ts").write.parquet(folder)
    return folder, events.schema


@query(
    "x01_incremental_map",
    "SELECT event_type, COUNT(*) AS n_rows, COUNT(DISTINCT event_id) AS n_events, CAST(SUM(value) AS FLOAT) AS total FROM (SELECT event_id, upper(event_type) AS event_type, value FROM events) GROUP BY 1",
)
def incremental(fx):
    folder, schema = incoming(fx)
    out, state = scratch_path(fx.spark, "mapped"), scratch_path(fx.spark, "state")
    stream = inc.read_stream(fx.spark, folder, schema, files_per_trigger=2)
    inc.map_new_files(stream, lambda batch: batch.withColumn("event_type", F.upper("event_type")), out, state).awaitTermination()
    result = fx.spark.read.parquet(out).groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.count_distinct("event_id").alias("n_events"), F.sum("value").alias("total")
    )
    return f32(result, "total")


@query(
    "x02_closed_daily_totals",
    """SELECT CAST(ts AS DATE) AS date, event_type, COUNT(*) AS n_rows, CAST(SUM(value) AS FLOAT) AS total FROM events
       WHERE CAST(ts AS DATE) < (SELECT CAST(MAX(ts) - INTERVAL 1 DAY AS DATE) FROM events) GROUP BY 1, 2""",
)
def closed_days(fx):
    folder, schema = incoming(fx, 1)
    out, state = scratch_path(fx.spark, "totals"), scratch_path(fx.spark, "state")
    stream = inc.read_stream(fx.spark, folder, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    inc.append_closed_days(inc.daily_totals(stream), out, state).awaitTermination()
    return f32(fx.spark.read.parquet(out), "total")
