"""Uploads over history, boosting with patience, halving search, moment fits, ordered totals, samples, appends, sizes."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from larder.errors import SavingError
from larder.operators import linear, models, ordered, quality, ranking, windows as W
from larder.plans import forecast as fc
from larder.plans.upload import model_forecast, prepare_upload, run_upload, unreadable_dates, with_history
from larder.session import scratch_path
from larder.sources import writers
from larder.sources.catalog import Catalog, table_sizes
from tests.conftest import day

HISTORY = "date DATE, store_nbr INT, item_nbr INT, unit_sales DOUBLE, onpromotion BOOLEAN, city STRING"


def history(spark, days=100):
    rows = [(day(i), 1, 7, float(i), i % 10 == 0, "Quito" if i < 95 else None) for i in range(days)]
    return spark.createDataFrame(rows + [(day(5), 2, 9, 3.0, False, "Loja")], HISTORY)


def upload(spark, rows):
    return spark.createDataFrame(rows, "date STRING, store STRING, sku STRING, qty STRING, promo STRING, stock STRING")


def test_upload_takes_lags_from_history(spark):
    rows = [(str(day(100)), "1", "7", "500", "", "3"), (str(day(102)), "1", "7", "600", "", "3"), (str(day(100)), "2", "9", "1", "", "2"), (str(day(100)), "5", "5", "1", "", "")]
    found = {(r["store_nbr"], r["date"]): r for r in with_history(prepare_upload(upload(spark, rows)), history(spark), 60).collect()}
    first, second = found[1, day(100)], found[1, day(102)]
    assert [first[f"sales_lag_{n}"] for n in (1, 2, 28)] == [99.0, 98.0, 72.0] and first["promo_lag_7"] == 0 and first["city"] == "Quito"
    assert first["sales_roll_mean_60"] == pytest.approx(np.mean(range(40, 100))) and first["sales_expanding_mean"] == first["sales_roll_mean_60"]
    assert second["sales_lag_1"] == 500.0 and second["sales_roll_max_7"] == 500.0
    smoothed = 40.0
    for x in range(41, 100):
        smoothed = 0.75 * smoothed + 0.25 * x
    assert first["sales_ewma_7"] == pytest.approx(smoothed)
    # The history of (2, 9) ended more than 60 days before; (5, 5) has none.
    assert all(found[key][c] is None for key in ((2, day(100)), (5, day(100))) for c in ("sales_lag_1", "sales_roll_mean_7", "city"))
    assert len(found) == 4 and "_uploaded" not in first.asDict()


def test_upload_keeps_days_that_are_repeated_unreadable_or_before_the_history(spark):
    rows = [(str(day(100)), "1", "7", "5", "", "9"), (str(day(100)), "1", "7", "6", "", "4"), ("soon", "1", "7", "2", "", "9"), (None, "1", "8", "2", "", "9")]
    raw = upload(spark, rows)
    found = with_history(prepare_upload(raw), history(spark)).collect()
    assert sorted((str(r["date"]), r["item_nbr"], r["unit_sales"], r["current_stock"], r["sales_lag_1"]) for r in found) == [
        (str(day(100)), 7, 11.0, 4.0, 99.0), ("None", 7, 2.0, 9.0, None), ("None", 8, 2.0, 9.0, None),
    ]
    out = run_upload(raw, history=history(spark))
    assert tuple(out["dates"].first()) == (4, 1) and {r["date"] for r in out["trajectory"].collect()} == {day(100)}
    assert {r["item_nbr"] for r in out["items"].collect()} == {7, 8}
    assert with_history(prepare_upload(upload(spark, rows[:0])), history(spark)).count() == 0
    assert with_history(prepare_upload(upload(spark, [(str(day(-5)), "1", "7", "5", "", "")])), history(spark)).first()["sales_lag_1"] is None
    assert tuple(unreadable_dates(raw.drop("date")).first()) == (4, 0)


def test_only_needed_history_is_read(spark, tmp_path):
    path = str(tmp_path / "history.parquet")
    history(spark).write.parquet(path)
    found = with_history(prepare_upload(upload(spark, [(str(day(100)), "1", "7", "5", "", "")])), spark.read.parquet(path), 30)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThan(date" in plan and "GreaterThanOrEqual(date" in plan


def test_fitted_model_replaces_the_rule(spark):
    store = history(spark)
    features = ["sales_lag_1", "sales_roll_mean_7", "year"]
    past = with_history(prepare_upload(upload(spark, [(str(day(i)), "1", "7", str(i), "", "5") for i in range(40, 100)])), store.where(F.col("date") < F.lit(day(40))))
    model = models.fit_linear(models.training_frame(past, features), features)
    out = run_upload(upload(spark, [(str(day(100)), "1", "7", "0", "", "5")]), forecast=model_forecast(model, features), history=store)
    forecast = out["trajectory"].first()["forecast"]
    assert 90 < forecast < 115 and out["items"].first()["current_stock"] == 5


def boosting_rows(spark, n, seed, noise=1.0):
    pick = random.Random(seed)
    rows = [(x := pick.uniform(-2, 2), pick.uniform(-2, 2), abs(x) + noise * pick.gauss(0, 1)) for _ in range(n)]
    return spark.createDataFrame([(a, b, y, models.math.log1p(max(y, 0.0))) for a, b, y in rows], f"a DOUBLE, b DOUBLE, unit_sales DOUBLE, {models.LABEL} DOUBLE").coalesce(1).persist()


def test_best_round():
    assert models.best_round([5, 4, 3, 4, 5, 2], 2) == (2, True)
    assert models.best_round([5, 4, 3, 4, 5, 2], 4) == (5, False)
    assert models.best_round([3, 3, 3], 2) == (0, True) and models.best_round([1], 3) == (0, False)


def test_boosting_stops_by_patience(spark):
    """Few noisy rows and a fast rate: later rounds only fit noise, so the ensemble is cut back to its best round."""
    train, later = boosting_rows(spark, 120, 1), boosting_rows(spark, 400, 2)
    model, curve = models.fit_patiently(train, ["a", "b"], later, rounds=40, patience=5, first=10, rate=0.5, depth=4)
    trees, (best, stopped) = model.stages[-1].getNumTrees, models.best_round(curve, 5)
    assert stopped and trees == best + 1 < len(curve) < 40 and curve[best] == min(curve[: best + 6])
    assert models.staged_loss(model, later)[-1] == pytest.approx(curve[best])
    path = scratch_path(spark, "boosted")
    model.write().overwrite().save(path)
    from pyspark.ml import PipelineModel

    loaded = PipelineModel.load(path)
    assert models.features_of(loaded) == ["a", "b"]
    assert [r[models.PREDICTION] for r in loaded.transform(later).collect()] == [r[models.PREDICTION] for r in model.transform(later).collect()]


def test_training_never_sees_the_horizon(spark):
    pick = random.Random(3)
    rows = [(day(i), 1, k, float(i % 7 + pick.random()), float(i % 7)) for i in range(60) for k in range(3)]
    store = spark.createDataFrame(rows, "date DATE, store_nbr INT, item_nbr INT, unit_sales DOUBLE, f DOUBLE").persist()
    model, features, late = fc.train(store, features=["f"], rounds=20, patience=3, first=5)
    changed = store.withColumn("unit_sales", F.when(F.col("date") >= F.lit(day(44)), 1000.0).otherwise(F.col("unit_sales")))
    again, *_ = fc.train(changed, features=["f"], rounds=20, patience=3, first=5)
    assert features == ["f"] and late.count() == 48 and model.stages[-1].getNumTrees == again.stages[-1].getNumTrees
    assert model.stages[-1].treeWeights == again.stages[-1].treeWeights


def test_folds_roll_forward(spark):
    folds = models.date_folds(spark.createDataFrame([(day(i),) for i in range(100)], "date DATE"))
    assert folds == [(day(40), day(59)), (day(60), day(79)), (day(80), day(99))]


def test_search_is_not_a_ranking_by_rate(spark):
    pick = random.Random(4)
    rows = [(day(i), 1, k, max(0.0, 5 + 3 * (k % 5) + pick.gauss(0, 1)), float(k % 5), pick.random()) for i in range(20) for k in range(10)]
    store = spark.createDataFrame(rows, "date DATE, store_nbr INT, item_nbr INT, unit_sales DOUBLE, f DOUBLE, g DOUBLE").coalesce(1).persist()
    found = sorted(models.search_boosted(store, ["f", "g"], trials=6, keep=(3, 1), progress=(0.1, 0.2, 0.4)).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in found] == list(range(1, 7)) and [r["rung"] for r in found] == [2, 1, 1, 0, 0, 0]
    assert all(r["rounds"] * r["rate"] >= (0.1, 0.2, 0.4)[r["rung"]] for r in found) and all(r["rmsle"] > 0 for r in found)
    losses = [r["rmsle"] for r in found if r["rung"] == 0]
    assert losses == sorted(losses)


def linear_rows(spark, n=300, parts=4):
    pick = np.random.default_rng(5)
    x = pick.normal(size=(n, 4)) * [1, 10, 0.1, 1] + [0, 1998, 5, 0]
    x[:, 3] = x[:, 0]  # collinear
    y = 2 * x[:, 0] - 0.3 * (x[:, 1] - 1998) + pick.normal(size=n)
    rows = [(*map(float, r), 7.0, float(t)) for r, t in zip(x, y)]
    return x, y, spark.createDataFrame(rows, f"a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, same DOUBLE, {models.LABEL} DOUBLE").repartition(parts)


FEATURES = ["a", "b", "c", "d", "same"]


def test_moments_and_fits(spark):
    x, y, df = linear_rows(spark)
    m = linear.moments(df, FEATURES, models.LABEL)
    whole = np.column_stack([x, np.full(len(x), 7.0), y])
    assert m.n == 300 and np.allclose(m.mean, whole.mean(axis=0)) and np.allclose(m.cov, np.cov(whole.T, bias=True), atol=1e-9)
    fits = {"ols": linear.solve(m), "ridge": linear.solve(m, "ridge", 5.0), "lasso": linear.solve(m, "lasso", 0.1), "elasticnet": linear.solve(m, "elasticnet", 0.1, 0.5)}
    for r in linear.optimality(df, FEATURES, models.LABEL, fits).collect():
        assert r["violation"] < 1e-8 and r["n_rows"] == 300 and r["n_features"] == 5, r
    wrong = linear.Fit(fits["lasso"].coefficients + 0.01, fits["lasso"].intercept, 0.1, 0.0)
    assert linear.optimality(df, FEATURES, models.LABEL, {"wrong": wrong}).first()["violation"] > 1e-3
    centred = x - x.mean(axis=0)
    ridge = np.linalg.solve(centred.T @ centred + 5 * np.eye(4), centred.T @ (y - y.mean()))
    assert np.allclose(fits["ridge"].coefficients[:4], ridge) and fits["ridge"].coefficients[4] == 0
    model = linear.as_pipeline(fits["lasso"], FEATURES, models.LABEL, models.PREDICTION)
    path = scratch_path(spark, "linear")
    model.write().overwrite().save(path)
    from pyspark.ml import PipelineModel

    expected = whole[:, :5] @ fits["lasso"].coefficients + fits["lasso"].intercept
    assert np.allclose(sorted(r[models.PREDICTION] for r in PipelineModel.load(path).transform(df).collect()), sorted(expected))
    assert models.coefficients(model, FEATURES).count() == 5


def test_moments_of_nothing(spark):
    _, _, df = linear_rows(spark, 5)
    m = linear.moments(df.limit(0), FEATURES, models.LABEL)
    assert m.n == 0 and linear.solve(m).coefficients.tolist() == [0] * 5
    one = linear.solve(linear.moments(df.limit(1), FEATURES, models.LABEL), "lasso", 0.1)
    assert one.coefficients.tolist() == [0] * 5


@pytest.mark.parametrize("descending", (False, True))
def test_totals_in_order(spark, descending):
    pick = random.Random(6)
    values = [(i, pick.choice([None, *range(20)]), float(pick.randint(0, 9)) if pick.random() < 0.9 else None) for i in range(400)]
    df = spark.createDataFrame(values, "id INT, v INT, w DOUBLE").repartition(5)
    key = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last()
    found = ordered.in_order(df, [key, F.col("id")], {"upto": F.col("w")}, "place")
    whole = Window.orderBy(key, "id")
    expected = df.withColumns({"upto": F.sum("w").over(whole.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(whole).cast("long")})
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == sorted(map(tuple, expected.collect()), key=lambda r: r[0])
    assert ordered.in_order(df.limit(0), [key], {"upto": F.col("w")}, "place").count() == 0


def test_no_window_over_everything(spark):
    df = spark.range(50).withColumn("v", F.col("id") % 7)
    for out in (W.running_total(df, "v", "id"), W.pareto(df, "v", "id"), ranking.rank_by(df, "v", "id"), W.share_of_total(df, "v"), W.minmax_scale(df, ["v"]), W.max_scale(df, "v")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "SinglePartition" not in out._jdf.queryExecution().sparkPlan().toString()
        assert all("_range" in line for line in plan.splitlines() if "Window [" in line)
    assert [r["rank"] for r in ranking.rank_by(df, "v", "id").orderBy("v", "id").collect()] == list(range(1, 51))


@pytest.mark.parametrize("n", (0, 1, 37, 999, 2000, 3000))
def test_large_samples_are_exact(spark, n):
    df = spark.range(2000).repartition(4)
    small = sorted(r["id"] for r in ranking.sample_rows(df, n, ["id"], small=5000).collect())
    large = sorted(r["id"] for r in ranking.sample_rows(df, n, ["id"], small=2).collect())
    assert small == large and len(large) == min(n, 2000)


def test_samples_with_equal_keys(spark):
    df = spark.createDataFrame([(1,)] * 30 + [(2,)] * 30, "id INT")
    assert ranking.sample_rows(df, 20, ["id"], small=3).count() == 20 and ranking.sample_rows(df, 45, ["id"], small=3).count() == 45


def test_appends_count_once_and_survive_a_failure(spark, tmp_path):
    path = str(tmp_path / "data")
    a, b = spark.range(10).toDF("x"), spark.range(5).toDF("x")
    assert writers.batch_log(spark, path).count() == 0
    with pytest.raises(SavingError):
        writers.read_batches(spark, path)
    assert writers.append_batch(a, path, "a") and not writers.append_batch(a, path, "a")
    # An attempt that wrote files but died before its log entry.
    b.write.parquet(f"{path}/batch_id=b")
    assert writers.read_batches(spark, path).count() == 10
    assert writers.append_batch(b, path, "b") and writers.read_batches(spark, path).count() == 15
    log = {r["batch_id"]: r for r in writers.batch_log(spark, path).collect()}
    assert {k: r["n_rows"] for k, r in log.items()} == {"a": 10, "b": 5} and all(r["n_files"] > 0 and r["n_bytes"] > 0 for r in log.values())
    assert writers.append_batch(a.limit(0), path, "none") and writers.read_batches(spark, path).count() == 15
    for bad in ("", "a/b", ".."[:0], "x y"):
        with pytest.raises(SavingError):
            writers.append_batch(a, path, bad)


def test_table_sizes(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "region.parquet"))
    row = table_sizes(spark, {"region": str(tmp_path / "region.parquet")}).first()
    files = [f for f in os.listdir(tmp_path / "region.parquet") if f.startswith("part-")]
    assert (row["n_files"], row["n_bytes"]) == (len(files), sum(os.path.getsize(tmp_path / "region.parquet" / f) for f in files))
    found = Catalog(spark, str(tmp_path)).inventory(["region"]).first().asDict()
    assert found == {"table_name": "region", "n_rows": 100, "n_columns": 1, "n_files": row["n_files"], "n_bytes": row["n_bytes"]}


def test_distinct_counts_of_all_types(spark):
    rows = [(1, 0.0, "a", day(0), None), (1, -0.0, "b", day(0), None), (2, float("nan"), "a", day(1), None), (None, float("nan"), "", None, None)]
    df = spark.createDataFrame(rows, "i INT, d DOUBLE, s STRING, t DATE, n STRING")
    report = quality.quality_report(df)
    assert {r["column_name"]: r["unique_count"] for r in report.collect()} == {"i": 2, "d": 2, "s": 3, "t": 2, "n": 0}
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Scan ExistingRDD") <= 4
    assert quality.quality_report(df.limit(0)).count() == 5
    assert isinstance(day(0), dt.date)
