"""Table readers. Everything is lazy; Catalyst pushes columns and filters into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from larder.errors import LoadingError
from larder.operators.ranking import newest_rows
from larder.schemas import PREDICTIONS

FORMATS = ("csv", "parquet", "json")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_path(spark, path)
    return fs.exists(target)


def _narrow(df: DataFrame, columns=None, where: Column | str | None = None) -> DataFrame:
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_csv(spark, path, columns=None, schema=None, where=None) -> DataFrame:
    """CSV with a header. Types are inferred only if no schema is given."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return _narrow(reader.csv(path), columns, where)


def read_parquet(spark, path, columns=None, where=None) -> DataFrame:
    return _narrow(spark.read.parquet(path), columns, where)


def read_many(spark, paths, columns=None, where=None) -> DataFrame:
    """Several Parquet datasets as one table."""
    return _narrow(spark.read.parquet(*paths), columns, where)


def read_json(spark, path, columns=None, schema=None, where=None) -> DataFrame:
    """JSON lines, or arrays of records when a file is one array."""
    reader = spark.read.option("multiLine", False)
    return _narrow((reader.schema(schema) if schema is not None else reader).json(path), columns, where)


def format_of(path: str) -> str:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise LoadingError(f"unknown format: {path}")
    return suffix


def read_any(spark, path, format=None, columns=None, schema=None) -> DataFrame:
    """Reader by explicit format or by suffix; a missing path is a loading error."""
    kind = (format or format_of(path)).lower()
    if kind not in FORMATS:
        raise LoadingError(f"unknown format: {kind}")
    try:
        if kind == "csv":
            return read_csv(spark, path, columns, schema)
        if kind == "json":
            return read_json(spark, path, columns, schema)
        return read_parquet(spark, path, columns)
    except AnalysisException as error:
        raise LoadingError(f"cannot read {path}: {error}") from error


def read_predictions(spark, path, columns=None, schema=PREDICTIONS) -> DataFrame:
    """Predictions saved as CSV or Parquet; the CSV is read by schema, without a pass to infer types."""
    return read_any(spark, path, columns=columns, schema=schema)


def read_newest(spark, path, n, columns=None, order=("date", "store_nbr", "item_nbr"), newest=True) -> DataFrame:
    """The newest (or oldest) ``n`` rows by date, ties by key."""
    return _narrow(newest_rows(spark.read.parquet(path), n, order, newest), columns)


def row_count(spark, path) -> DataFrame:
    """One row; answered from Parquet footers when aggregate pushdown is on."""
    return spark.read.parquet(path).agg(F.count("*").alias("n_rows"))


def describe_columns(df: DataFrame) -> DataFrame:
    """Name, type and position of every column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position INT, column_name STRING, column_type STRING")


def run_sql(spark, query, **tables) -> DataFrame:
    """Ad-hoc SQL; keyword DataFrames can be named in the text as ``{name}``."""
    return spark.sql(query, **tables)
