"""Scans, sources and sinks: data is derived from the given tables, written, and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from larder import schemas
from larder.errors import LoadingError, SavingError
from larder.registry.base import f32, query
from larder.session import scratch_path, settle
from larder.sources import readers, writers
from larder.sources.catalog import Catalog, drop_view, inventory_of, register_view
from larder.operators.inventory import filter_inventory, summary_row
from larder.operators.ranking import concat_frames

SALES_SCHEMA = "date DATE, store_nbr INT, item_nbr INT, unit_sales DOUBLE, onpromotion STRING"


def per_store(df):
    return df.groupBy("store_nbr").agg(F.count("*").alias("n_rows"), F.sum("unit_sales").alias("total_sales"))


PER_STORE_SQL = "SELECT store_nbr, COUNT(*) AS n_rows, SUM(unit_sales) AS total_sales FROM train GROUP BY store_nbr"


def written_sales(fx, kind):
    path = scratch_path(fx.spark, "sales") + f".{kind}"
    return writers.write_any(fx.train, path, kind)


@query("s01_csv_scan", PER_STORE_SQL)
def csv_scan(fx):
    path = written_sales(fx, "csv")
    return per_store(readers.read_csv(fx.spark, path, ["store_nbr", "unit_sales"], schema=SALES_SCHEMA))


@query(
    "s02_parquet_scan",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'",
)
def parquet_scan(fx):
    return readers.read_parquet(
        fx.spark, fx.path("lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"],
        where="l_quantity >= 49 AND l_returnflag = 'R'",
    )


@query(
    "s03_many_files",
    "SELECT o_orderstatus, COUNT(*) AS n_rows, MIN(o_orderkey) AS first_key, MAX(o_orderkey) AS last_key FROM orders GROUP BY 1",
)
def many_files(fx):
    orders = fx.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    paths = []
    for name, part in (("open", orders.where("o_orderstatus = 'O'")), ("other", orders.where("o_orderstatus <> 'O'"))):
        paths.append(writers.write_any(part, scratch_path(fx.spark, name), "parquet"))
    return (
        readers.read_many(fx.spark, paths, ["o_orderkey", "o_orderstatus"])
        .groupBy("o_orderstatus")
        .agg(F.count("*").alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))
    )


@query(
    "s04_json_scan",
    "SELECT store_nbr, COUNT(*) AS n_days, CAST(SUM(transactions) AS BIGINT) AS transactions FROM transactions GROUP BY 1",
)
def json_scan(fx):
    path = writers.write_any(fx.transactions, scratch_path(fx.spark, "transactions"), "json")
    table = readers.read_json(fx.spark, path, schema=schemas.TRANSACTIONS)
    return table.groupBy("store_nbr").agg(F.count("*").alias("n_days"), F.sum("transactions").alias("transactions"))


@query(
    "s05_load_by_suffix",
    """SELECT kind, n.* FROM (VALUES ('csv'), ('json'), ('parquet')) k(kind),
       (SELECT COUNT(*) AS n_rows, CAST(SUM(item_nbr) AS BIGINT) AS checksum FROM items) n""",
)
def load_by_suffix(fx):
    parts = []
    for kind in readers.FORMATS:
        path = writers.write_any(fx.items, scratch_path(fx.spark, "items") + f".{kind}", kind)
        table = readers.read_any(fx.spark, path, columns=["item_nbr"], schema=None if kind == "parquet" else schemas.ITEMS)
        parts.append(
            table.agg(F.count("*").alias("n_rows"), F.sum("item_nbr").alias("checksum")).select(
                F.lit(kind).alias("kind"), "n_rows", "checksum"
            )
        )
    for bad in ("/nowhere/table.parquet", "/nowhere/table.xml"):
        try:
            readers.read_any(fx.spark, bad)
        except LoadingError:
            continue
        raise AssertionError("a loading error was expected")
    return concat_frames(parts)


def written_catalog(fx) -> Catalog:
    folder = scratch_path(fx.spark, "catalog")
    for name, table in fx.tables.items():
        writers.write_any(table, f"{folder}/{name}.parquet")
    return Catalog(fx.spark, folder)


CATALOG_COUNTS = """
    SELECT 'train' AS table_name, COUNT(*) AS n_rows FROM train UNION ALL SELECT 'stores', COUNT(*) FROM stores
    UNION ALL SELECT 'items', COUNT(*) FROM items UNION ALL SELECT 'oil', COUNT(*) FROM oil
    UNION ALL SELECT 'transactions', COUNT(*) FROM transactions UNION ALL SELECT 'holidays_events', COUNT(*) FROM holidays
"""


@query("s06_load_catalog", CATALOG_COUNTS)
def load_catalog(fx):
    tables = written_catalog(fx).load_all(tuple(fx.tables))
    return concat_frames(
        [fx.spark.sql(f"SELECT '{name}' AS table_name, COUNT(*) AS n_rows FROM {name}") for name in tables]
    )


@query(
    "s07_named_loaders",
    "SELECT date, COUNT(*) AS n_rows, SUM(unit_sales) AS total_sales FROM train GROUP BY date",
)
def named_loaders(fx):
    return (
        written_catalog(fx).train(["date", "unit_sales"]).groupBy("date")
        .agg(F.count("*").alias("n_rows"), F.sum("unit_sales").alias("total_sales"))
    )


@query(
    "s08_newest_rows",
    "SELECT date, store_nbr, item_nbr, unit_sales FROM train ORDER BY date DESC, store_nbr, item_nbr LIMIT 1000",
)
def newest(fx):
    path = written_sales(fx, "parquet")
    return readers.read_newest(fx.spark, path, 1000, ["date", "store_nbr", "item_nbr", "unit_sales"])


@query(
    "s08_oldest_rows",
    "SELECT date, store_nbr, item_nbr, unit_sales FROM train ORDER BY date, store_nbr, item_nbr LIMIT 777",
)
def oldest(fx):
    path = written_sales(fx, "parquet")
    return readers.read_newest(fx.spark, path, 777, ["date", "store_nbr", "item_nbr", "unit_sales"], newest=False)


def batch_sum(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"n": [len(batch)], "quantity": [batch["l_quantity"].sum()]})


@query("s09_chunk_scan", "SELECT COUNT(*) AS n_rows, SUM(l_quantity) AS quantity FROM lineitem")
def chunk_scan(fx):
    scan = readers.read_parquet(fx.spark, fx.path("lineitem"), ["l_quantity"])
    return writers.map_batches(scan, batch_sum, "n BIGINT, quantity DOUBLE").agg(
        F.sum("n").alias("n_rows"), F.sum("quantity").alias("quantity")
    )


def add_net_cents(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.assign(double_quantity=batch["l_quantity"] * 2)


@query(
    "s10_batch_map",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity * 2 AS double_quantity FROM lineitem",
)
def batch_map(fx):
    scan = readers.read_parquet(fx.spark, fx.path("lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"])
    return writers.map_batches(
        scan, add_net_cents, "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, double_quantity DOUBLE",
        scratch_path(fx.spark, "mapped"),
    )


@query("s11_save_formats", "SELECT kind, s.* FROM (VALUES ('csv'), ('json'), ('parquet')) k(kind), stores s")
def save_formats(fx):
    parts = []
    for kind in readers.FORMATS:
        path = writers.write_any(fx.stores, scratch_path(fx.spark, "stores"), kind)
        writers.write_any(fx.stores, path, kind, overwrite=True)
        try:
            writers.write_any(fx.stores, path, kind, overwrite=False)
        except SavingError:
            pass
        else:
            raise AssertionError("a saving error was expected")
        table = readers.read_any(fx.spark, path, kind, schema=None if kind == "parquet" else schemas.STORES)
        parts.append(table.select(F.lit(kind).alias("kind"), *fx.stores.columns))
    return concat_frames(parts)


@query("s12_sql_to_parquet", "SELECT COUNT(*) AS n_rows FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def sql_to_parquet(fx):
    return writers.write_query(
        fx.spark, "SELECT DISTINCT l_partkey FROM {lines}", scratch_path(fx.spark, "query"),
        compression="zstd", lines=fx.raw("lineitem"),
    )


@query("s13_append_batches", "SELECT COUNT(*) AS n_rows, CAST(3 AS BIGINT) AS n_batches FROM orders")
def append(fx):
    orders = fx.raw("orders")
    batches = (orders.where(F.pmod("o_orderkey", F.lit(3)) == i) for i in range(3))
    return writers.append_batches(batches, scratch_path(fx.spark, "appended"))


@query(
    "s14_csv_to_parquet",
    """SELECT 'first' AS attempt, 'converted' AS action, COUNT(*) AS n_rows, 5 AS n_columns FROM train
       UNION ALL SELECT 'second', 'skipped', COUNT(*), 5 FROM train UNION ALL SELECT 'forced', 'converted', COUNT(*), 5 FROM train""",
)
def convert(fx):
    source, target = written_sales(fx, "csv"), scratch_path(fx.spark, "converted") + ".parquet"
    parts = []
    for attempt, force in (("first", False), ("second", False), ("forced", True)):
        report = writers.csv_to_parquet(fx.spark, "train", source, target, SALES_SCHEMA, force)
        parts.append(report.select(F.lit(attempt).alias("attempt"), "action", "n_rows", "n_columns"))
    return concat_frames(parts)


@query(
    "s14_convert_all",
    "SELECT 'train' AS table_name, 'converted' AS action, COUNT(*) AS n_rows, 5 AS n_columns FROM train UNION ALL SELECT 'stores', 'converted', COUNT(*), 5 FROM stores",
)
def convert_several(fx):
    stores = writers.write_any(fx.stores, scratch_path(fx.spark, "stores") + ".csv", "csv")
    jobs = {"train": (written_sales(fx, "csv"), SALES_SCHEMA), "stores": (stores, schemas.STORES)}
    tables = {name: (path, scratch_path(fx.spark, name) + ".parquet", schema) for name, (path, schema) in jobs.items()}
    return writers.convert_all(fx.spark, tables).select("table_name", "action", "n_rows", "n_columns")


@query("s15_row_count", "SELECT COUNT(*) AS n_rows FROM lineitem")
def count_rows(fx):
    return readers.row_count(fx.spark, fx.path("lineitem"))


@query(
    "s16_schema",
    """SELECT CAST(row_number() OVER () - 1 AS INT) AS position, column_name,
              CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                               WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS column_type
       FROM (DESCRIBE SELECT * FROM lineitem)""",
)
def schema(fx):
    return readers.describe_columns(fx.raw("lineitem"))


@query(
    "s17_ad_hoc_sql",
    "SELECT o_orderpriority, COUNT(*) AS n_orders, MAX(o_totalprice) AS largest FROM orders GROUP BY 1",
)
def ad_hoc(fx):
    return readers.run_sql(
        fx.spark,
        "SELECT o_orderpriority, COUNT(*) AS n_orders, MAX(o_totalprice) AS largest FROM {orders} GROUP BY 1",
        orders=fx.raw("orders"),
    )


@query("s18_register_view", "SELECT type, COUNT(*) AS n_stores FROM stores GROUP BY 1")
def view(fx):
    register_view(fx.stores, "larder_stores")
    result = fx.spark.sql("SELECT type, COUNT(*) AS n_stores FROM larder_stores GROUP BY 1")
    drop_view(fx.spark, "larder_stores")
    return result


@query(
    "s19_save_feature_store",
    "SELECT date, store_nbr, item_nbr, CAST(unit_sales AS FLOAT) AS unit_sales, CAST(sales_roll_mean_28 AS FLOAT) AS sales_roll_mean_28 FROM fstore",
)
def save_store(fx):
    path = writers.write_feature_store(fx.features, scratch_path(fx.spark, "store"))
    saved = readers.read_parquet(fx.spark, path, ["date", "store_nbr", "item_nbr", "unit_sales", "sales_roll_mean_28"])
    return f32(saved, "unit_sales", "sales_roll_mean_28")


@query(
    "s20_load_predictions",
    "SELECT date, store_nbr, item_nbr, CAST(forecast_sales AS FLOAT) AS forecast_sales FROM fc",
)
def load_predictions(fx):
    path = scratch_path(fx.spark, "predictions") + ".csv"
    writers.write_any(fx.forecast.select("date", "store_nbr", "item_nbr", "forecast_sales", "actual_sales"), path)
    return f32(readers.read_predictions(fx.spark, path).drop("actual_sales"), "forecast_sales")


@query(
    "s21_export",
    """SELECT 'predictions' AS artifact, COUNT(*) AS n_rows FROM fc UNION ALL SELECT 'procurement', COUNT(*) FROM inv
       UNION ALL SELECT 'critical', COUNT(*) FROM inv WHERE alert_status = 'CRITICAL_UNDERSTOCK'
       UNION ALL SELECT 'summary', 1""",
)
def export(fx):
    folder = scratch_path(fx.spark, "export")
    predictions = fx.forecast.select("date", "store_nbr", "item_nbr", "forecast_sales", "actual_sales")
    # Four artifacts of one forecast: computed once, so that they agree.
    inventory = settle(fx.inventory, "inventory")
    paths = writers.export_forecast(settle(predictions, "forecast"), inventory, summary_row(inventory), folder)
    critical = writers.write_any(filter_inventory(inventory, ["CRITICAL_UNDERSTOCK"]), f"{folder}/critical.csv")
    kinds = {**paths, "critical": critical}
    return concat_frames(
        [
            readers.read_any(fx.spark, path).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("artifact"), "n_rows")
            for name, path in kinds.items()
        ]
    )


# Columns of the given tables.
SIZED = {"region": 2, "nation": 3, "orders": 6, "lineitem": 11, "part": 6}


@query(
    "s22_dataset_inventory",
    "SELECT table_name, n_rows, CAST(CASE table_name WHEN 'train' THEN 5 WHEN 'stores' THEN 5 WHEN 'items' THEN 4 "
    "WHEN 'oil' THEN 2 ELSE 3 END AS INT) AS n_columns FROM (" + CATALOG_COUNTS + ")",
)
def dataset_inventory(fx):
    return inventory_of(fx.tables)


@query(
    "s13_append_retry",
    "SELECT 'retried' AS attempt, COUNT(*) AS n_rows, CAST(2 AS BIGINT) AS n_batches FROM orders UNION ALL SELECT 'read', COUNT(*), 2 FROM orders",
)
def append_again(fx):
    """One batch comes twice, as after a lost answer; it counts once in the log and in the rows."""
    orders, path = fx.raw("orders"), scratch_path(fx.spark, "appended")
    odd = F.col("o_orderkey") % 2 == 1
    batches = [("even", orders.where(~odd)), ("odd", orders.where(odd)), ("odd", orders.where(odd))]
    log = writers.append_batches(batches, path).select(F.lit("retried").alias("attempt"), "n_rows", "n_batches")
    return log.union(writers.read_batches(fx.spark, path).select(F.lit("read").alias("attempt")).groupBy("attempt").agg(F.count("*").alias("n_rows"), F.lit(2).cast("long")))


@query(
    "s22_table_sizes",
    " UNION ALL ".join(f"SELECT '{name}' AS table_name, COUNT(*) AS n_rows, {n} AS n_columns, TRUE AS has_bytes FROM {name}" for name, n in SIZED.items()),
)
def sizes(fx):
    found = Catalog(fx.spark, fx.folder).inventory(SIZED)
    return found.select("table_name", "n_rows", "n_columns", ((F.col("n_files") > 0) & (F.col("n_bytes") > 0)).alias("has_bytes"))


@query("s23_keep_in_memory", "SELECT state, COUNT(*) AS n_stores, CAST(SUM(cluster) AS BIGINT) AS clusters FROM stores GROUP BY 1")
def keep(fx):
    folder = scratch_path(fx.spark, "kept")
    writers.write_any(fx.stores, f"{folder}/stores.parquet")
    catalog = Catalog(fx.spark, folder)
    kept = catalog.keep("stores")
    kept.count()
    assert catalog.load("stores").storageLevel.useMemory
    catalog.drop("stores")
    return catalog.load("stores").groupBy("state").agg(F.count("*").alias("n_stores"), F.sum("cluster").alias("clusters"))
