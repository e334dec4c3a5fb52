"""Incremental jobs over files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder, schema, files_per_trigger=8, glob=None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def map_new_files(stream: DataFrame, transform, out, checkpoint) -> StreamingQuery:
    """Apply ``transform`` to each batch of new files and write Parquet.

    Batch ``n`` is written to its own folder in overwrite mode, so that a batch that is retried after a
    failure replaces its first attempt.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def daily_totals(stream: DataFrame, time="ts", by=("event_type",), value="value", delay="1 day") -> DataFrame:
    """Totals per day and key; state is dropped once the watermark passes the day."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day").alias("_day"), *by)
        .agg(F.count("*").alias("n_rows"), F.sum(value).alias("total"))
        .select(F.col("_day.start").cast("date").alias("date"), *by, "n_rows", "total")
    )


def append_closed_days(totals: DataFrame, out, checkpoint) -> StreamingQuery:
    """Write each day once, after the watermark has closed it."""
    return (
        totals.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
