import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.operators import windows as W
from larder.plans.clean import densify
from tests.conftest import column, day, series


def test_three_rows_have_null_lags_and_one_value_has_no_deviation(spark):
    df = series(spark, [4, 8, 6])
    assert column(W.lags(df, steps=(1, 7), prefix="lag"), "lag_1") == [None, 4.0, 8.0]
    assert column(W.lags(df, steps=(7,), prefix="lag"), "lag_7") == [None] * 3
    assert column(W.rolling(df, "mean", (7,), prefix="m"), "m_7") == [None, 4.0, 6.0]
    std = column(W.rolling(df, "std", (7,), prefix="s"), "s_7")
    assert std[:2] == [None, None] and std[2] == pytest.approx(8**0.5)
    assert column(W.rolling(df, "median", (14,), prefix="d"), "d_14") == [None, 4.0, 6.0]
    assert column(W.expanding(df, prefix="e"), "e_mean") == [None, 4.0, 6.0]


@pytest.mark.parametrize("spans", [(7, 14, 28), (1, 2, 400), (3,)])
def test_ewma_equals_pandas_over_many_blocks(spark, spans):
    values = np.random.default_rng(3).integers(0, 90, 5000).astype(float)
    got = W.ewma(series(spark, values), spans, prefix="e").orderBy("date").toPandas()
    prior = pd.Series(values).shift(1)
    for span in spans:
        expected = prior.ewm(span=span, adjust=False).mean()
        np.testing.assert_allclose(got[f"e_{span}"], expected, rtol=1e-10)


@pytest.mark.parametrize("func", ["mean", "std", "min", "max", "median"])
def test_rolling_equals_pandas(spark, func):
    values = np.random.default_rng(4).integers(0, 50, 200).astype(float)
    got = W.rolling(series(spark, values), func, (14,), prefix="r").orderBy("date").toPandas()["r_14"]
    expected = getattr(pd.Series(values).shift(1).rolling(14, min_periods=1), func)()
    np.testing.assert_allclose(got.astype(float), expected, rtol=1e-10)


def test_missing_days_shift_lags_unless_densified(spark):
    df = series(spark, [5]).unionByName(series(spark, [9], start=3))
    assert column(W.lags(df, steps=(1,), prefix="lag"), "lag_1") == [None, 5.0]
    assert column(W.lags(densify(df), steps=(1,), prefix="lag"), "lag_1") == [None, 5.0, 0.0, 0.0]


def test_fill_both_ways(spark):
    df = series(spark, [None, 2, None, None, 5, None])
    assert column(W.fill_both_ways(df, "unit_sales"), "unit_sales") == [2.0, 2.0, 2.0, 2.0, 5.0, 5.0]


def test_constant_frame_has_no_correlation(spark):
    df = series(spark, [1, 1, 1, 2]).withColumn("other", F.dayofmonth("date").cast("double"))
    got = column(W.rolling_correlation(df, "unit_sales", "other", 3), "rolling_corr")
    assert got[:3] == [None, None, None] and got[3] == pytest.approx(0.8660254)


def test_pareto_ends_at_100_and_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 6.0)], "name STRING, v DOUBLE")
    rows = W.pareto(df, "v", "name").orderBy("cumulative_pct").collect()
    assert [r["name"] for r in rows] == ["c", "a", "b"] and rows[-1]["cumulative_pct"] == pytest.approx(100)


def test_scaling_of_a_constant_column(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0)], "name STRING, v DOUBLE")
    assert [r["v_scaled"] for r in W.minmax_scale(df, ["v"]).collect()] == [50.0, 50.0]


def test_dates_of_the_fixture_are_consecutive():
    assert (day(1) - day(0)).days == 1
