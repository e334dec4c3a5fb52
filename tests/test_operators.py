import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from larder.errors import DataValidationError, FeatureStoreError, LoadingError, SavingError
from larder.operators import evaluation as ev, inventory as inv, joins, quality as q, ranking
from larder.operators.aggregates import correlation, with_events
from larder.operators.quantiles import exact_quantiles
from larder.plans import clean as cl
from larder.plans.upload import fill_defaults, normalise_headers, number_days, prepare_upload
from larder.sources import readers, writers
from tests.conftest import column, day, series

PROBS = (0.0, 0.1, 0.5, 0.9, 0.999, 1.0)


@pytest.mark.parametrize("kind", ["normal", "few", "hot"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(5)
    values = {
        "normal": rng.normal(size=4000),
        "few": rng.integers(0, 5, 4000).astype(float),
        "hot": np.where(rng.random(4000) < 0.4, 7.0, rng.normal(size=4000) * 100),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE").unionByName(
        spark.createDataFrame([(None,)], "v DOUBLE")
    )
    row = exact_quantiles(df, "v", PROBS).first()
    np.testing.assert_allclose([row[f"q{p:g}"] for p in PROBS], np.quantile(values, PROBS), rtol=1e-12, atol=1e-12)


def test_quantiles_by_group_with_a_null_group(spark):
    rows = [("a", float(i)) for i in range(11)] + [(None, float(i * 10)) for i in range(5)]
    got = exact_quantiles(spark.createDataFrame(rows, "g STRING, v DOUBLE"), "v", (0.5,), by=("g",), names=("m",))
    assert {r["g"]: r["m"] for r in got.collect()} == {"a": 5.0, None: 20.0}


def test_quantile_of_no_rows(spark):
    empty = spark.createDataFrame([], "v DOUBLE")
    assert exact_quantiles(empty, "v", (0.5,), names=("m",)).collect()[0]["m"] is None


@pytest.mark.parametrize("n", [0, 1, 7, 12, 13, 100])
@pytest.mark.parametrize("newest", [True, False])
def test_newest_rows_equals_sorting(spark, n, newest):
    rows = [(day(d), s, i) for d in range(3) for s in range(2) for i in range(2)]
    df = spark.createDataFrame(rows, "date DATE, store_nbr INT, item_nbr INT")
    got = {tuple(r) for r in ranking.newest_rows(df, n, newest=newest).collect()}
    ordered = sorted(rows, key=lambda r: (-r[0].toordinal() if newest else r[0].toordinal(), r[1], r[2]))
    assert got == set(ordered[:n])


def test_moved_holidays_and_two_events_on_one_day(spark):
    rows = [
        (day(0), "Holiday", "National", "X", True), (day(0), "Event", "Local", "Quito", False),
        (day(0), "Additional", "National", "X", False), (day(1), "Transfer", "National", "X", True),
    ]
    holidays = spark.createDataFrame(rows, "date DATE, type STRING, locale STRING, locale_name STRING, transferred BOOLEAN")
    days = {r["date"]: (r["is_holiday"], r["holiday_type"]) for r in cl.holiday_days(holidays).collect()}
    assert days == {day(0): (1, "Additional"), day(1): (1, "Transfer")}
    daily = spark.createDataFrame([(day(0), 1.0), (day(2), 2.0)], "date DATE, total_sales DOUBLE")
    assert with_events(daily, holidays).count() == 4


def test_holidays_by_locale_mark_only_their_stores(spark):
    tables = {
        "train": spark.createDataFrame(
            [(day(0), 1, 1, 3.0, "True"), (day(0), 2, 1, -1.0, None)],
            "date DATE, store_nbr INT, item_nbr INT, unit_sales DOUBLE, onpromotion STRING",
        ),
        "stores": spark.createDataFrame([(1, "Quito", "P", "A", 1), (2, "Loja", "L", "B", 2)], "store_nbr INT, city STRING, state STRING, type STRING, cluster INT"),
        "items": spark.createDataFrame([(1, "F", 1, 0)], "item_nbr INT, family STRING, class INT, perishable INT"),
        "oil": spark.createDataFrame([(day(0), 50.0)], "date DATE, dcoilwtico DOUBLE"),
        "transactions": spark.createDataFrame([(day(0), 1, 9)], "date DATE, store_nbr INT, transactions BIGINT"),
        "holidays_events": spark.createDataFrame(
            [(day(0), "Holiday", "Local", "Quito", "d", False)],
            "date DATE, type STRING, locale STRING, locale_name STRING, description STRING, transferred BOOLEAN",
        ),
    }
    by_store = {r["store_nbr"]: r for r in cl.build_clean(tables, by_locale=True).collect()}
    assert (by_store[1]["is_holiday"], by_store[2]["is_holiday"]) == (1, 0)
    assert (by_store[2]["unit_sales"], by_store[2]["is_return"], by_store[2]["onpromotion"]) == (0.0, 1, False)
    everywhere = cl.build_clean(tables).where("is_holiday = 1").count()
    assert everywhere == 2


def stock_case(spark, mean, std, stock):
    return spark.createDataFrame(
        [(1, 1, float(mean), float(std), stock)],
        "store_nbr INT, item_nbr INT, daily_avg_demand DOUBLE, demand_std DOUBLE, current_stock BIGINT",
    )


@pytest.mark.parametrize(
    "stock, status, order", [(73, "CRITICAL_UNDERSTOCK", 71), (74, "OPTIMAL_STOCK", 70), (144, "OPTIMAL_STOCK", 0), (145, "OVERSTOCK", 0)]
)
def test_status_at_the_boundaries(spark, stock, status, order):
    # Safety ceil(1.65 * 0.8 * sqrt 7) = 4, reorder point 70 + 4, target level 74 + 70.
    row = inv.stock_decisions(inv.stock_levels(stock_case(spark, 10, 0.8, stock))).first()
    assert (row["safety_stock"], row["reorder_point"], row["target_stock_level"]) == (4, 74, 144)
    assert (row["alert_status"], row["recommended_order_qty"]) == (status, order)


def test_demand_variants_for_one_row_and_zero_demand(spark):
    df = spark.createDataFrame([(1, 1, 8.0), (1, 2, 0.0)], "store_nbr INT, item_nbr INT, forecast_sales DOUBLE")
    got = {
        variant: {r["item_nbr"]: (r["daily_avg_demand"], r["demand_std"]) for r in inv.horizon_demand(df, variant).collect()}
        for variant in ("mean", "per_horizon", "flat", "service")
    }
    assert got["mean"] == {1: (8.0, 0.0), 2: (0.0, 0.0)}
    assert got["per_horizon"] == {1: (0.5, 0.125), 2: (0.5, 0.0)}
    assert got["flat"] == {1: (0.5, 0.125), 2: (0.5, 0.125)}
    assert got["service"] == {1: (8.0, 0.1), 2: (0.0, 0.1)}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0, 500), st.floats(0, 90), st.integers(0, 4000)), min_size=1, max_size=30))
def test_levels_are_ordered_and_statuses_partition(spark, cases):
    df = spark.createDataFrame(
        [(1, i, float(m), float(s), k) for i, (m, s, k) in enumerate(cases)],
        "store_nbr INT, item_nbr INT, daily_avg_demand DOUBLE, demand_std DOUBLE, current_stock BIGINT",
    )
    rows = inv.stock_decisions(inv.stock_levels(df)).collect()
    assert all(r["safety_stock"] <= r["reorder_point"] <= r["target_stock_level"] for r in rows)
    assert all(r["alert_status"] in (inv.CRITICAL, inv.OPTIMAL, inv.OVER) for r in rows)
    assert all((r["reorder_priority_score"] > 0) == (r["alert_status"] == inv.CRITICAL) for r in rows)


def test_scenario_without_changes_has_no_deviation(spark):
    demand = stock_case(spark, 10, 3, 0)
    row = inv.scenarios(demand, [("calm", 0, 0, 7, 95), ("shock", 0, 50, 7, 95)]).orderBy("scenario").collect()
    assert row[0]["scenario_safety"] == 0 and row[0]["scenario_reorder"] == 70
    expected = np.ceil(1.65 * np.std([15.0] * 3 + [10.0] * 13) * np.sqrt(7))
    assert row[1]["scenario_safety"] == expected


def test_upload_headers_and_values(spark):
    df = spark.createDataFrame(
        [("2020-01-05", "Store 4", "SKU-12", "abc"), ("2020-01-06 10:00", "x", "", "7")],
        ["Date_Time", "store_id", "SKU", " Sales "],
    )
    named = normalise_headers(df)
    assert named.columns == ["date", "store_nbr", "item_nbr", "unit_sales"]
    rows = fill_defaults(named).orderBy("date").collect()
    assert [(r["store_nbr"], r["item_nbr"], r["unit_sales"]) for r in rows] == [(4, 12, 10.0), (1, 103520, 7.0)]
    assert rows[0]["current_stock"] == 50.0 and rows[0]["onpromotion"] == 0.0 and str(rows[1]["date"]) == "2020-01-06"


def test_alias_keeps_an_existing_column(spark):
    df = spark.createDataFrame([(1.0, 2.0)], ["sales", "unit_sales"])
    assert normalise_headers(df).columns == ["sales", "unit_sales"]


def test_undated_rows_get_consecutive_days(spark):
    df = number_days(spark.range(500).withColumnRenamed("id", "k"), ["k"])
    days = sorted(r["date"] for r in df.collect())
    assert len(set(days)) == 500 and (days[-1] - days[0]).days == 499
    assert prepare_upload(spark.range(3).withColumnRenamed("id", "sales")).count() == 3


def test_prediction_sanity_and_metrics_with_bad_values(spark):
    rows = [(1.0, float("nan")), (2.0, float("inf")), (3.0, -1.0), (4.0, 4.0)]
    df = spark.createDataFrame(rows, "actual_sales DOUBLE, forecast_sales DOUBLE")
    r = ev.sanity_report(df).first()
    assert (r["nan_count"], r["inf_count"], r["negative_count"]) == (1, 1, 1)
    m = ev.metrics(df).first()
    assert m["rmse"] == pytest.approx(np.sqrt((1 + 4 + 9) / 4)) and m["mape_pct"] == pytest.approx(200 / 3)


def test_leaderboard_breaks_ties_by_name(spark):
    scores = spark.createDataFrame([("b", 0.1), ("a", 0.1), ("c", 0.05)], "model STRING, rmsle DOUBLE")
    assert [r["model"] for r in ev.leaderboard(scores).collect()] == ["c", "a", "b"]
    assert ev.champion(scores).first()["model"] == "c"


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a DOUBLE, b DOUBLE")
    assert correlation(df, "a", "b").first()[0] is None


def test_rules_raise(spark):
    df = series(spark, [1, -2, None])
    for rule in (
        lambda: q.require_columns(df, ["nothing"]),
        lambda: q.require_numeric(df, ["unit_sales"], allow_negatives=False),
        lambda: q.require_numeric(df, ["date"]),
        lambda: q.require_date(df, "item_nbr"),
        lambda: q.require_target(df),
        lambda: q.require_unique(df, "store_nbr"),
        lambda: q.require_types(df, {"date": "timestamp"}),
        lambda: q.require_table(df.where("false")),
        lambda: q.require_clean(df, 5.0),
    ):
        with pytest.raises(DataValidationError):
            rule()
    with pytest.raises(FeatureStoreError):
        q.require_feature_store(df)
    q.require_unique(df, ["date", "store_nbr", "item_nbr"])
    q.require_clean(series(spark, [0, 5]), 5.0)


def test_quality_report_counts_infinities(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("inf"), None), (None, "x")], "v DOUBLE, t STRING")
    got = {r["column_name"]: r.asDict() for r in q.quality_report(df).collect()}
    assert got["v"]["inf_count"] == 1 and got["v"]["null_count"] == 1 and got["v"]["unique_count"] == 2
    assert got["t"]["is_constant"] and got["t"]["null_pct"] == pytest.approx(33.33)
    assert q.missing_report(df).count() == 2


def test_readers_and_writers(spark, tmp_path):
    df = series(spark, [1, 2, 3])
    for kind in readers.FORMATS:
        path = str(tmp_path / f"t.{kind}")
        writers.write_any(df, path)
        assert readers.read_any(spark, path).count() == 3
        with pytest.raises(SavingError):
            writers.write_any(df, path, overwrite=False)
    with pytest.raises(LoadingError):
        readers.read_any(spark, str(tmp_path / "absent.parquet"))
    assert readers.path_exists(spark, str(tmp_path)) and not readers.path_exists(spark, str(tmp_path / "absent"))


def test_unmatched_rows_survive_an_outer_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, l STRING")
    right = spark.createDataFrame([(2, "x"), (3, "y")], "k INT, r STRING")
    assert {how: joins.join_on(left, right, "k", how).count() for how in joins.JOIN_KINDS} == {
        "left": 2, "inner": 1, "right": 2, "full": 3, "outer": 3,
    }


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 300, 70000, 1.5)], "a BIGINT, b BIGINT, c BIGINT, d DOUBLE")
    assert [t for _, t in cl.narrow_types(df).dtypes] == ["tinyint", "smallint", "int", "float"]


def test_spine_fills_every_day(spark):
    df = series(spark, [5]).unionByName(series(spark, [9], start=3))
    assert column(joins.on_calendar(df.select("date", "unit_sales"), joins.date_spine(df)), "unit_sales") == [5.0, None, None, 9.0]


def test_blend_needs_every_model(spark):
    a, b = series(spark, [10, 20]), series(spark, [30])
    parts = {n: (df.withColumnRenamed("unit_sales", "forecast_sales"), w) for n, df, w in (("a", a, 0.5), ("b", b, 0.5))}
    assert [r["forecast_sales"] for r in ev.blend(parts).collect()] == [20.0]


def test_sample_is_repeatable(spark):
    df = spark.range(1000)
    first, again = (sorted(r["id"] for r in ranking.sample_rows(df, 50, ["id"]).collect()) for _ in range(2))
    assert first == again and len(set(first)) == 50


def test_linear_penalties_match_the_closed_form(spark):
    from larder.operators.models import LABEL, fit_linear

    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 2))
    y = x @ np.array([2.0, -1.0]) + 0.3 + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], f"a DOUBLE, b DOUBLE, {LABEL} DOUBLE")
    centred, target = x - x.mean(0), y - y.mean()
    ridge = np.linalg.solve(centred.T @ centred + 5.0 * np.eye(2), centred.T @ target)
    model = fit_linear(df, ["a", "b"], "ridge", 5.0).stages[-1]
    np.testing.assert_allclose(model.coefficients.toArray(), ridge, rtol=1e-4)
    # Lasso by coordinate descent.
    w = np.zeros(2)
    for _ in range(500):
        for j in range(2):
            rest = target - centred @ w + centred[:, j] * w[j]
            rho, size = centred[:, j] @ rest / 300, centred[:, j] @ centred[:, j] / 300
            w[j] = np.sign(rho) * max(abs(rho) - 0.2, 0) / size
    lasso = fit_linear(df, ["a", "b"], "lasso", 0.2).stages[-1]
    np.testing.assert_allclose(lasso.coefficients.toArray(), w, rtol=2e-3)


def test_plan_pushes_filters_and_columns(spark):
    scan = readers.read_parquet(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey"], where="l_quantity >= 49")
    text = scan._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_quantity,49.0)" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_series_windows_share_one_exchange(spark):
    df = spark.range(0, 1000, 1, 4).select(
        F.date_from_unix_date(F.col("id").cast("int")).alias("date"), (F.col("id") % 3).alias("store_nbr"),
        (F.col("id") % 5).alias("item_nbr"), F.col("id").cast("double").alias("unit_sales"),
    )
    from larder.plans.feature_store import rolling_features

    text = rolling_features(df)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
