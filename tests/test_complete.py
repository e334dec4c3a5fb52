"""Results that the registered tables cannot show: nulls, unknown keys, odd headers and dates, plans without blow-up."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.functions import scalars as sc
from larder.operators import inventory, quality, ranking, windows as W
from larder.plans.clean import local_holiday_days
from larder.plans.upload import match_headers
from larder.session import drop_scratch, scratch_path, settle
from larder.sources import writers
from tests.conftest import column, day, series


@pytest.mark.parametrize("values, want", [([None, 2, 3, 4], [None, None, 2, 2.25]), ([1, None, 3, 5], [None, 1, 1, 1.5])])
def test_ewma_with_nulls(spark, values, want):
    assert column(W.ewma(series(spark, values), (7,), prefix="e"), "e_7") == want


@pytest.mark.parametrize("n, want", [(1, [3]), (3, [3, 2, None]), (2, [3, 2]), (9, [3, 2, None])])
def test_newest_rows_with_null_dates(spark, n, want):
    rows = [(day(2), 1, 2), (day(3), 1, 3), (None, 1, None)]
    df = spark.createDataFrame(rows, "date DATE, store_nbr INT, item_nbr INT")
    assert sorted((r["item_nbr"] or 0) for r in ranking.newest_rows(df, n).collect()) == sorted((x or 0) for x in want)


def test_requests_without_forecast_are_answered(spark):
    asked = spark.createDataFrame([(1, 1, 3), (9, 9, 3)], "store_nbr INT, item_nbr INT, current_stock LONG")
    known = spark.createDataFrame([(day(0), 1, 1, 32.0, 30.0)], "date DATE, store_nbr INT, item_nbr INT, forecast_sales DOUBLE, actual_sales DOUBLE")
    found = {r["store_nbr"]: r["daily_avg_demand"] for r in inventory.replenish_requests(asked, known).collect()}
    assert found == {1: 2.0, 9: 0.5}


def test_one_header_for_two_targets(spark):
    df = spark.createDataFrame([("7", "a")], "item_category STRING, other STRING")
    row = match_headers(df).first()
    assert (row["item_nbr"], row["family"], row["other"]) == ("7", "7", "a")


def test_dates_in_several_layouts(spark):
    texts = ["2017-08-01", "08/01/2017", "2017/8/1", "1.8.2017", "20170801", "2017-08-01 10:00:00", "1 Aug 2017", "Aug 1, 2017"]
    df = spark.createDataFrame([(t,) for t in [*texts, "soon", None, "2017-13-01"]], "t STRING")
    found = [r["d"] for r in df.select(sc.to_date(F.col("t")).alias("d")).collect()]
    assert found == [dt.date(2017, 8, 1)] * len(texts) + [None] * 3


def test_half_written_target_is_converted_again(spark, tmp_path):
    source = str(tmp_path / "t.csv")
    spark.createDataFrame([(1,)], "a INT").write.option("header", True).csv(source)
    (tmp_path / "t.parquet").mkdir()
    (tmp_path / "t.parquet" / "part-0.parquet").write_bytes(b"")
    report = writers.csv_to_parquet(spark, "t", source, str(tmp_path / "t.parquet"), "a INT").first()
    assert (report["action"], report["n_rows"]) == ("converted", 1)


def test_quality_report_does_not_multiply_rows(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("b"), F.lit(1).alias("c"))
    report = quality.quality_report(df)
    assert "Expand" not in report._jdf.queryExecution().toString()
    assert {r["column_name"]: r["unique_count"] for r in report.collect()} == {"id": 10, "b": 2, "c": 1}


def test_holidays_by_place(spark):
    events = spark.createDataFrame(
        [(day(0), "Holiday", False, "Local", "X"), (day(1), "Event", False, "National", "N"), (day(2), "Holiday", False, "Regional", "S")],
        "date DATE, type STRING, transferred BOOLEAN, locale STRING, locale_name STRING",
    )
    stores = spark.createDataFrame([(1, "X", "S"), (2, "Y", "S"), (3, "Z", "T")], "store_nbr INT, city STRING, state STRING")
    national, local = local_holiday_days(events, stores)
    assert [r["date"] for r in national.collect()] == [day(1)]
    assert sorted((r["date"], r["store_nbr"]) for r in local.collect()) == [(day(0), 1), (day(2), 1), (day(2), 2)]


def test_scratch_is_dropped(spark):
    import os

    path = scratch_path(spark, "probe")
    spark.range(3).write.parquet(path)
    settle(spark.range(2))
    assert os.path.exists(path) and drop_scratch(spark) >= 2 and not os.path.exists(path)
