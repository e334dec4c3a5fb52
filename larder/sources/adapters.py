"""Retail tables derived from an order-line star schema (lineitem, orders, part, supplier, nation, region).

A series is (nation, brand). Sales are summed per day, store and item before anything
else, so every series has at most one row per calendar day however hot a key is.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F


@lru_cache(maxsize=256)
def _schema(application: str, path: str):
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; its schema is read from the files once per application."""
    path = f"{folder}/{name}.parquet"
    return spark.read.schema(_schema(spark.sparkContext.applicationId, path)).parquet(path)


BRAND_NUMBER = "CAST(substring(p_brand, 7) AS INT)"


def stores(spark, folder) -> DataFrame:
    return (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
        .selectExpr(
            "CAST(n_nationkey + 1 AS INT) AS store_nbr",
            "n_name AS city",
            "r_name AS state",
            "elt(CAST(n_nationkey % 5 AS INT) + 1, 'A', 'B', 'C', 'D', 'E') AS type",
            "CAST(n_nationkey % 17 + 1 AS INT) AS cluster",
        )
    )


def items(spark, folder) -> DataFrame:
    return (
        table(spark, folder, "part")
        .selectExpr(f"{BRAND_NUMBER} AS item_nbr")
        .distinct()
        .selectExpr(
            "item_nbr",
            "concat('FAMILY_', item_nbr % 6) AS family",
            "item_nbr % 10 AS class",
            "CASE WHEN item_nbr % 3 = 0 THEN 1 ELSE 0 END AS perishable",
        )
    )


def _supplier_stores(spark, folder, condition="true") -> DataFrame:
    suppliers = table(spark, folder, "supplier").where(condition)
    return suppliers.selectExpr("s_suppkey AS l_suppkey", "CAST(s_nationkey + 1 AS INT) AS store_nbr")


def train(spark, folder) -> DataFrame:
    """One row per day, store and item; small dimensions are broadcast, so the sum is the only shuffle."""
    parts = table(spark, folder, "part").selectExpr("p_partkey AS l_partkey", f"{BRAND_NUMBER} AS item_nbr")
    return (
        table(spark, folder, "lineitem")
        .join(_supplier_stores(spark, folder), "l_suppkey")
        .join(parts, "l_partkey")
        .groupBy(F.expr("CAST(l_shipdate AS DATE) AS date"), "store_nbr", "item_nbr")
        .agg(
            F.expr(
                "SUM(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -l_quantity ELSE l_quantity END) AS unit_sales"
            ),
            F.expr("MAX(l_discount) AS discount"),
        )
        .selectExpr(
            "date",
            "store_nbr",
            "item_nbr",
            "unit_sales",
            "CASE WHEN discount >= 0.08D THEN 'True' WHEN discount > 0.01D THEN 'False' END AS onpromotion",
        )
    )


def oil(spark, folder) -> DataFrame:
    """Weekday prices; null on the 11th of a month."""
    return (
        table(spark, folder, "orders")
        .where("dayofweek(o_orderdate) BETWEEN 2 AND 6")
        .groupBy(F.expr("CAST(o_orderdate AS DATE) AS date"))
        .agg(F.expr("CAST(SUM(CAST(o_totalprice * 100 AS DECIMAL(18, 0))) AS DOUBLE) / 100 / COUNT(*) / 5000 AS price"))
        .selectExpr("date", "CASE WHEN dayofmonth(date) <> 11 THEN price END AS dcoilwtico")
    )


def transactions(spark, folder) -> DataFrame:
    """Distinct orders per store and day; store 8 has none."""
    return (
        table(spark, folder, "lineitem")
        .join(_supplier_stores(spark, folder, "s_nationkey <> 7"), "l_suppkey")
        .groupBy(F.expr("CAST(l_shipdate AS DATE) AS date"), "store_nbr")
        .agg(F.expr("COUNT(DISTINCT l_orderkey) AS transactions"))
    )


def holidays(spark, folder) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .selectExpr("CAST(o_orderdate AS DATE) AS date")
        .where("dayofmonth(date) IN (1, 12, 24, 26)")
        .distinct()
        .selectExpr(
            "date",
            "CASE dayofmonth(date) WHEN 1 THEN 'Holiday' WHEN 12 THEN 'Transfer' WHEN 24 THEN 'Event' ELSE 'Bridge' END AS type",
            "dayofmonth(date) = 1 AND month(date) % 4 = 0 AS transferred",
        )
    )


def with_stock(demand: DataFrame, column="current_stock") -> DataFrame:
    """Arithmetic stock between 0 and three reorder points."""
    share = (F.col("store_nbr") * 31 + F.col("item_nbr") * 17) % 301
    return demand.withColumn(column, F.floor(F.col("reorder_point") * share / 100).cast("bigint"))

