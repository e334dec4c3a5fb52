"""Running totals and positions over a whole table without sorting it in one task.

Rows are range-partitioned by the order, each task works through its own range, and the totals of the ranges before it (one
row per partition) complete its results. The order should end in a column that tells rows apart: equal rows
cannot be split between ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.session import settle


def in_order(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, position: str | None = None) -> DataFrame:
    """``df`` with the running sum of each of ``sums`` (this row included) and its 1-based ``position`` in the order.

    The ranges are written once, since both passes must see the same cuts.
    """
    spark, sums = df.sparkSession, sums or {}
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    measured = df.withColumns({f"_v_{name}": value for name, value in sums.items()})
    parted = settle(measured.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = parted.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    before, seen = [], None
    for row in sorted(totals.collect(), key=lambda r: r["_range"]):  # one row per partition
        seen = seen or [0] + [None] * len(sums)
        before.append((row["_range"], *seen))
        seen = [a if b is None else b if a is None else a + b for a, b in zip(seen, row[1:])]
    schema = totals.schema
    for field in schema.fields:
        field.nullable = True
    offsets = spark.createDataFrame(before, schema)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parted.withColumns({f"_s_{name}": F.sum(f"_v_{name}").over(inside) for name in sums})
    if position:
        out = out.withColumn("_p", F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long"))
    out = out.join(offsets, "_range")
    out = out.withColumns({name: F.when(F.col(f"_t_{name}").isNull(), F.col(f"_s_{name}")).otherwise(F.col(f"_t_{name}") + F.coalesce(f"_s_{name}", F.lit(0))) for name in sums})
    if position:
        out = out.withColumn(position, F.col("_p") + F.col("_rows"))
    return out.select(*df.columns, *sums, *([position] if position else []))
