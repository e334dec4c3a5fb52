"""Table writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.utils import AnalysisException

from larder.errors import SavingError
from larder.sources.readers import format_of, hadoop_path, path_exists, read_csv


def write_any(df: DataFrame, path, format=None, overwrite=True, compression="snappy") -> str:
    """Parquet, CSV with header, or JSON lines; overwrites, or fails when the path exists."""
    kind = (format or format_of(path)).lower()
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").format(kind)
    if kind == "parquet":
        writer = writer.option("compression", compression)
    elif kind == "csv":
        writer = writer.option("header", True)
    elif kind != "json":
        raise SavingError(f"unknown format: {kind}")
    try:
        writer.save(path)
    except AnalysisException as error:
        raise SavingError(f"cannot write {path}: {error}") from error
    return path


def _write_counted(df: DataFrame, path, compression) -> int:
    """Overwrite ``path``; the rows are counted as they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", compression).parquet(path)
    return seen.get["rows"]


def write_query(spark, query, path, compression="snappy", **tables) -> DataFrame:
    """Run SQL, write the result, report its row count; what was written is not read back."""
    return spark.createDataFrame([(_write_counted(spark.sql(query, **tables), path, compression),)], "n_rows LONG")


_LOG = "_batches"
_ENTRY = "batch_id STRING, n_rows LONG, n_files LONG, n_bytes LONG"


def append_batch(df: DataFrame, path, batch_id, compression="snappy") -> bool:
    """Append one batch to the dataset at ``path``; False if a batch of this id is in it already.

    A batch has a folder of its own, which a retry overwrites, and belongs to the dataset from the moment its log entry
    (id, rows, files, bytes) is renamed into place, which comes last. Ids name folders: letters, digits, ``.``, ``-``, ``_``.
    """
    spark, batch_id = df.sparkSession, str(batch_id)
    if not batch_id or set(batch_id) - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._-"):
        raise SavingError(f"not a batch id: {batch_id!r}")
    if path_exists(spark, f"{path}/{_LOG}/{batch_id}.json"):
        return False
    folder = f"{path}/batch_id={batch_id}"
    rows = _write_counted(df, folder, compression)
    fs, target = hadoop_path(spark, folder)
    written = [f for f in fs.listStatus(target) if f.getPath().getName().startswith("part-")]
    entry = {"batch_id": batch_id, "n_rows": rows, "n_files": len(written), "n_bytes": sum(f.getLen() for f in written)}
    _, draft = hadoop_path(spark, f"{path}/{_LOG}/.{batch_id}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if not fs.rename(draft, hadoop_path(spark, f"{path}/{_LOG}/{batch_id}.json")[1]):
        raise SavingError(f"cannot commit batch {batch_id} of {path}")
    return True


def batch_log(spark, path) -> DataFrame:
    """(batch_id, n_rows, n_files, n_bytes) of the committed batches."""
    if not path_exists(spark, f"{path}/{_LOG}"):
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).json(f"{path}/{_LOG}")


def read_batches(spark, path) -> DataFrame:
    """The rows of the committed batches; what a failed attempt left behind is not read."""
    ids = [r["batch_id"] for r in batch_log(spark, path).select("batch_id").collect()]  # one row per batch
    if not ids:
        raise SavingError(f"no batch in {path}")
    return spark.read.parquet(*[f"{path}/batch_id={i}" for i in sorted(ids)])


def append_batches(batches, path, compression="snappy") -> DataFrame:
    """Append frames, or (id, frame) pairs, one after the other; report rows and number of batches from the log.

    Frames without an id are numbered, so a repeated run of the same job adds nothing twice.
    """
    spark = None
    for position, batch in enumerate(batches):
        batch_id, frame = batch if isinstance(batch, tuple) else (str(position), batch)
        spark = frame.sparkSession
        append_batch(frame, path, batch_id, compression)
    if spark is None:
        raise SavingError("no batch to write")
    return batch_log(spark, path).agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_batches"))


def write_sorted(df: DataFrame, path, order=("store_nbr", "item_nbr", "date"), compression="snappy") -> str:
    """Files in key order. Range partitioning on the whole key splits a store that holds most rows."""
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("compression", compression)
        .parquet(path)
    )
    return path


def write_feature_store(df: DataFrame, path, overwrite=True, order=("store_nbr", "item_nbr", "date")) -> str:
    """Partitioned by year and month, so that date ranges prune; month files are split by key range."""
    if "year" not in df.columns or "month" not in df.columns:
        df = df.withColumns({"year": F.year("date"), "month": F.month("date")})
    layout = ("year", "month", *order)
    try:
        (
            df.repartitionByRange(*layout)
            .sortWithinPartitions(*layout)
            .write.mode("overwrite" if overwrite else "errorifexists")
            .partitionBy("year", "month")
            .parquet(path)
        )
    except AnalysisException as error:
        raise SavingError(f"cannot write {path}: {error}") from error
    return path


def map_batches(df: DataFrame, func, schema, path=None) -> DataFrame:
    """Apply a pandas frame function to Arrow batches of every partition; write when a path is given."""

    def run(batches):
        for batch in batches:
            yield func(batch)

    result = df.mapInPandas(run, schema)
    if path is None:
        return result
    result.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _bytes(spark, path):
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    )


def csv_to_parquet(spark, name, csv_path, parquet_path, schema=None, force=False, compression="snappy") -> DataFrame:
    """Convert once: a complete target (with ``_SUCCESS``) is kept unless forced. Reports rows, columns and sizes."""
    skipped = path_exists(spark, f"{parquet_path}/_SUCCESS") and not force
    if not skipped:
        read_csv(spark, csv_path, schema=schema).write.mode("overwrite").option("compression", compression).parquet(
            parquet_path
        )
    table = spark.read.parquet(parquet_path)
    n_rows = table.count()
    csv_bytes, parquet_bytes = (_bytes(spark, path).first()["bytes"] for path in (csv_path, parquet_path))
    action = "skipped" if skipped else "converted"
    ratio = csv_bytes / parquet_bytes if parquet_bytes else None
    # One row of figures of this moment: a later conversion may replace the files.
    return spark.createDataFrame(
        [(name, action, n_rows, len(table.columns), csv_bytes, parquet_bytes, ratio)],
        "table_name STRING, action STRING, n_rows BIGINT, n_columns INT, csv_bytes BIGINT, parquet_bytes BIGINT, compression_ratio DOUBLE",
    )


def convert_all(spark, tables: dict, force=False) -> DataFrame:
    """``tables`` maps a name to (csv path, parquet path, schema or None)."""
    reports = [csv_to_parquet(spark, name, *spec[:2], schema=spec[2], force=force) for name, spec in tables.items()]
    result = reports[0]
    for report in reports[1:]:
        result = result.unionByName(report)
    return result


def export_forecast(predictions: DataFrame, procurement: DataFrame, summary: DataFrame, folder) -> dict[str, str]:
    """Predictions and procurement as CSV, the one-row summary as JSON."""
    paths = {
        "predictions": f"{folder}/final_predictions.csv",
        "procurement": f"{folder}/procurement_recommendations.csv",
        "summary": f"{folder}/inventory_alerts_summary.json",
    }
    write_any(predictions, paths["predictions"], "csv")
    write_any(procurement, paths["procurement"], "csv")
    write_any(summary, paths["summary"], "json")
    return paths
