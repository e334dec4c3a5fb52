"""The dataset catalog: named tables below one folder, and tables kept in memory."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.errors import LoadingError
from larder.sources.readers import hadoop_path, read_any

RAW_TABLES = ("train", "test", "stores", "items", "oil", "transactions", "holidays_events")
DERIVED_TABLES = ("clean_data", "feature_store")


@dataclass
class Catalog:
    """Tables by name; each is ``<folder>/<name>.parquet`` unless ``paths`` says otherwise."""

    spark: SparkSession
    folder: str
    paths: dict[str, str] = field(default_factory=dict)
    _kept: dict[str, DataFrame] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return self.paths.get(name, f"{self.folder}/{name}.parquet")

    def load(self, name: str, columns=None) -> DataFrame:
        if name in self._kept:
            df = self._kept[name]
            return df.select(*columns) if columns else df
        return read_any(self.spark, self.path(name), columns=columns)

    def train(self, columns=None):
        return self.load("train", columns)

    def test(self, columns=None):
        return self.load("test", columns)

    def clean_data(self, columns=None):
        return self.load("clean_data", columns)

    def feature_store(self, columns=None):
        return self.load("feature_store", columns)

    def load_all(self, names=RAW_TABLES, register=True) -> dict[str, DataFrame]:
        """Every table by name, also as temp views."""
        tables = {name: self.load(name) for name in names}
        if register:
            for name, df in tables.items():
                register_view(df, name)
        return tables

    def inventory(self, names=RAW_TABLES) -> DataFrame:
        """Rows, columns, files and bytes per table."""
        sizes = table_sizes(self.spark, {name: self.path(name) for name in names})
        return inventory_of({name: self.load(name) for name in names}).join(sizes, "table_name")

    def keep(self, name: str) -> DataFrame:
        """Hold a table in executor memory (spilling to disk) for repeated use."""
        if name not in self._kept:
            self._kept[name] = self.load(name).persist()
        return self._kept[name]

    def drop(self, name: str | None = None) -> None:
        names = list(self._kept) if name is None else [name]
        for key in names:
            df = self._kept.pop(key, None)
            if df is None:
                raise LoadingError(f"{key} is not kept")
            df.unpersist()


def register_view(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


def drop_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def table_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table_name, n_files, n_bytes) from the file system's own listing; no data is read."""
    rows = []
    for name, path in paths.items():
        fs, target = hadoop_path(spark, path)
        if not fs.exists(target):
            raise LoadingError(f"{path} does not exist")
        listing, n_files, n_bytes = fs.listFiles(target, True), 0, 0
        while listing.hasNext():
            found = listing.next()
            if not found.getPath().getName().startswith(("_", ".")):
                n_files, n_bytes = n_files + 1, n_bytes + found.getLen()
        rows.append((name, n_files, n_bytes))
    return spark.createDataFrame(rows, "table_name STRING, n_files LONG, n_bytes LONG")


def inventory_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
