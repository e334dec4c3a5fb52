"""Splits, baselines, metrics, leaderboards and model fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import evaluation as ev, linear as linear_fit, models, quality, windows as W
from larder.operators.aggregates import half_year_rows
from larder.operators.inventory import trajectory, with_band
from larder.plans import forecast as fc
from larder.plans.feature_store import sales_lags
from larder.registry.aggregate_queries import STORED_SQL, STORE_NUMBERS, stored
from larder.registry.base import f32, query
from larder.session import settle

KEY = ("date", "store_nbr", "item_nbr")

CUTOFF_SQL = """(SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT date FROM train)) WHERE i = FLOOR(n * 0.8::DOUBLE))"""


@query(
    "m01_date_split",
    f"""SELECT CASE WHEN date < {CUTOFF_SQL} THEN 'train' ELSE 'validation' END AS part, COUNT(*) AS n_rows, MIN(date) AS first_date, MAX(date) AS last_date FROM train GROUP BY 1""",
)
def split(fx):
    early, late = ev.split_by_date(fx.train, ev.date_cutoff(fx.train))
    parts = [
        part.agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).withColumn("part", F.lit(name))
        for name, part in (("train", early), ("validation", late))
    ]
    return parts[0].unionByName(parts[1]).select("part", "n_rows", "first_date", "last_date")


@query(
    "m02_feature_vector",
    """SELECT date, store_nbr, item_nbr, CAST(COALESCE(sales_lag_1, 0) AS FLOAT) AS f1, CAST(COALESCE(sales_lag_7, 0) AS FLOAT) AS f2, CAST(transactions AS FLOAT) AS f3 FROM rolled""",
)
def vector(fx):
    lagged = sales_lags(fx.clean).select(*KEY, "sales_lag_1", "sales_lag_7", "transactions")
    out = models.vector_columns(models.feature_vectors(lagged, ["sales_lag_1", "sales_lag_7", "transactions"]))
    return out.select(*KEY, *[F.col("features_array")[i].cast("float").alias(f"f{i + 1}") for i in range(3)])


@query(
    "m03_standardise",
    f"""WITH s AS (SELECT AVG(unit_sales) AS m, STDDEV_POP(unit_sales) AS d FROM train WHERE date < {CUTOFF_SQL})
        SELECT date, store_nbr, item_nbr, CAST((unit_sales - m) / d AS FLOAT) AS unit_sales_scaled FROM train, s WHERE date >= {CUTOFF_SQL}""",
)
def standardised(fx):
    early, late = ev.split_by_date(fx.train, ev.date_cutoff(fx.train))
    return f32(ev.standardise(early, late, ["unit_sales"]).select(*KEY, "unit_sales_scaled"), "unit_sales_scaled")


def with_baselines(fx):
    """Validation rows with three prediction columns; the lagged sales are written once, and so is the cutoff."""
    rows = settle(ev.seasonal_naive(W.lags(fx.train, "unit_sales", (7,), prefix="sales_lag")), "lagged")
    cutoff = rows.select(ev.date_cutoff(rows).alias("cutoff")).limit(1).first()
    early, late = ev.split_by_date(rows, F.lit(cutoff["cutoff"] if cutoff else None).cast("date"))
    return ev.constant_baselines(early, late).withColumnRenamed("unit_sales", "actual_sales")


BASELINE_SQL = f"""
    lagged AS (SELECT *, COALESCE(lag(unit_sales, 7) OVER (PARTITION BY store_nbr, item_nbr ORDER BY date), 0) AS seasonal_naive FROM train),
    bc AS (SELECT AVG(unit_sales) AS global_mean, quantile_cont(unit_sales, 0.5) AS global_median FROM train WHERE date < {CUTOFF_SQL}),
    val AS (SELECT date, store_nbr, item_nbr, unit_sales AS actual_sales, global_mean, global_median, seasonal_naive FROM lagged, bc WHERE date >= {CUTOFF_SQL}),
    preds AS (SELECT 'global_mean' AS model, date, actual_sales, global_mean AS forecast_sales FROM val UNION ALL SELECT 'global_median', date, actual_sales, global_median FROM val
              UNION ALL SELECT 'seasonal_naive', date, actual_sales, seasonal_naive FROM val)
"""
MODELS = ("global_mean", "global_median", "seasonal_naive")


@query(
    "m04_constant_baselines",
    f"WITH {BASELINE_SQL} SELECT date, store_nbr, item_nbr, CAST(global_mean AS FLOAT) AS global_mean, CAST(global_median AS FLOAT) AS global_median FROM val",
)
def constants(fx):
    return f32(with_baselines(fx).select(*KEY, "global_mean", "global_median"), "global_mean", "global_median")


@query("m05_seasonal_naive", f"WITH {BASELINE_SQL} SELECT date, store_nbr, item_nbr, seasonal_naive FROM val")
def naive(fx):
    return with_baselines(fx).select(*KEY, "seasonal_naive")


def _metric_sql(source, mape, by="model"):
    base = {"all": "GREATEST(y, 2.220446049250313e-16::DOUBLE)", "gt1": "CASE WHEN y > 1 THEN y END", "positive": "CASE WHEN y > 0 THEN y END"}[mape]
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {key}COUNT(*) AS n_rows, CAST(SQRT(AVG((y - p) * (y - p))) AS FLOAT) AS rmse, CAST(AVG(ABS(y - p)) AS FLOAT) AS mae,
        CAST(SQRT(AVG((ln(1 + y) - ln(1 + p)) * (ln(1 + y) - ln(1 + p)))) AS FLOAT) AS rmsle,
        CAST(1 - AVG((y - p) * (y - p)) / NULLIF(VAR_POP(y), 0) AS FLOAT) AS r2, CAST(COALESCE(AVG(ABS(y - p) / ({base})), 0) * 100 AS FLOAT) AS mape_pct
        FROM (SELECT *, GREATEST(actual_sales, 0) AS y, GREATEST(forecast_sales, 0) AS p FROM {source}) {group}"""


METRICS = ("rmse", "mae", "rmsle", "r2", "mape_pct")


@query("m11_metrics", _metric_sql("fc", "gt1", None))
def metric_set(fx):
    return f32(ev.metrics(fx.forecast), *METRICS)


for _variant in ev.MAPE_ROWS:

    @query(
        f"m12_mape_{_variant}",
        f"WITH {BASELINE_SQL} SELECT model, n_rows, mape_pct FROM (" + _metric_sql("preds", _variant) + ")",
    )
    def mape(fx, variant=_variant):
        return f32(ev.score_models(with_baselines(fx), MODELS, mape=variant).select("model", "n_rows", "mape_pct"), "mape_pct")


def odd_predictions(fx):
    value = (
        F.when(F.col("item_nbr") == 1, F.lit(float("nan"))).when(F.col("item_nbr") == 2, F.lit(float("inf"))).when(F.col("item_nbr") == 3, -F.abs("unit_sales")).otherwise(F.col("unit_sales"))
    )
    return fx.train.select(*KEY, F.col("unit_sales").alias("actual_sales"), value.alias("forecast_sales"))


@query(
    "m13_prediction_sanity",
    """SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE item_nbr = 1) AS nan_count, COUNT(*) FILTER (WHERE item_nbr = 2) AS inf_count,
              COUNT(*) FILTER (WHERE item_nbr > 2 AND (unit_sales < 0 OR (item_nbr = 3 AND unit_sales > 0))) AS negative_count FROM train""",
)
def sanity(fx):
    return ev.sanity_report(odd_predictions(fx))


LEADER_SQL = f"WITH {BASELINE_SQL}, scores AS (" + _metric_sql("preds", "gt1") + ")"


@query("m14_leaderboard", LEADER_SQL + " SELECT *, CAST(row_number() OVER (ORDER BY rmsle, model) AS INT) AS rank FROM scores")
def leaderboard(fx):
    return f32(ev.leaderboard(ev.score_models(with_baselines(fx), MODELS)), *METRICS)


@query(
    "m14_best_per_metric",
    LEADER_SQL
    + " UNION ALL ".join(
        f" (SELECT '{m}' AS metric, model, {m} AS value FROM scores ORDER BY {m} {'DESC' if m == 'r2' else ''}, model LIMIT 1)" for m in METRICS
    ),
)
def best(fx):
    return f32(ev.best_per_metric(ev.score_models(with_baselines(fx), MODELS)), "value")


@query("m15_champion", LEADER_SQL + " SELECT model, rmsle FROM scores ORDER BY rmsle, model LIMIT 1")
def champion(fx):
    return f32(ev.champion(ev.score_models(with_baselines(fx), MODELS)).select("model", "rmsle"), "rmsle")


@query(
    "m19_prediction_sample",
    """SELECT date, store_nbr, item_nbr, CAST(actual_sales AS FLOAT) AS actual_sales, CAST(forecast_sales AS FLOAT) AS forecast_sales, CAST(ABS(actual_sales - forecast_sales) AS FLOAT) AS abs_error,
              CAST(CASE WHEN actual_sales > 0 THEN ABS(actual_sales - forecast_sales) / actual_sales * 100 ELSE 0 END AS FLOAT) AS pct_error FROM fc ORDER BY date, store_nbr, item_nbr LIMIT 1000""",
)
def prediction_sample(fx):
    return f32(ev.prediction_sample(fx.forecast), "actual_sales", "forecast_sales", "abs_error", "pct_error")


@query(
    "m20_blend",
    f"WITH {BASELINE_SQL} SELECT date, store_nbr, item_nbr, CAST(0.5 * seasonal_naive + 0.3 * global_mean + 0.2 * global_median AS FLOAT) AS forecast_sales FROM val",
)
def blend(fx):
    rows = with_baselines(fx)
    parts = {m: (rows.select(*KEY, F.col(m).alias("forecast_sales")), w) for m, w in (("seasonal_naive", 0.5), ("global_mean", 0.3), ("global_median", 0.2))}
    return f32(ev.blend(parts), "forecast_sales")


@query("m23_rule_forecast", "SELECT date, store_nbr, item_nbr, CAST(forecast_sales AS FLOAT) AS forecast_sales FROM fc")
def rule(fx):
    return f32(fx.forecast.select(*KEY, "forecast_sales"), "forecast_sales")


@query(
    "m24_bands",
    " UNION ALL ".join(
        f"SELECT {b}::DOUBLE AS band_pct, date, CAST(GREATEST(0, SUM(forecast_sales) * (1 - {b}::DOUBLE / 100)) AS FLOAT) AS lower_band, CAST(SUM(forecast_sales) * (1 + {b}::DOUBLE / 100) AS FLOAT) AS upper_band FROM fc GROUP BY date"
        for b in (7, 10, 18)
    ),
)
def bands(fx):
    daily = trajectory(fx.forecast).select("date", "forecast_sales")
    parts = [with_band(daily, "forecast_sales", b).select(F.lit(float(b)).alias("band_pct"), "date", "lower_band", "upper_band") for b in (7, 10, 18)]
    return f32(parts[0].unionByName(parts[1]).unionByName(parts[2]), "lower_band", "upper_band")


@query(
    "m25_residual_histogram",
    f"""WITH {BASELINE_SQL}, r AS (SELECT actual_sales - seasonal_naive AS e FROM val)
        SELECT CAST(CASE WHEN e < -200 THEN 0 WHEN e >= 200 THEN 41 ELSE FLOOR((e + 200) / 10) + 1 END AS BIGINT) AS bin, COUNT(*) AS n_rows FROM r GROUP BY 1""",
)
def residual_histogram(fx):
    rows = with_baselines(fx).withColumnRenamed("seasonal_naive", "forecast_sales")
    return ev.residual_histogram(rows, -200, 200, 40)


AUDITED = ("sales_lag_1", "sales_lag_7", "sales_lag_28", "transactions", "is_return")


@query(
    "m26_feature_audit",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing, CAST(0 AS BIGINT) AS infinite, COUNT(DISTINCT {c}) <= 1 AS is_constant, CAST(0 AS BIGINT) AS duplicate_keys FROM rolled"
        for c in AUDITED
    ),
)
def audit(fx):
    return quality.feature_audit(sales_lags(fx.clean), AUDITED, KEY)


@query(
    "m26_lag_nulls",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT 'sales_lag_{n}' AS column_name, COUNT(*) - COUNT(sales_lag_{n}) AS missing_count, CAST(ROUND((COUNT(*) - COUNT(sales_lag_{n})) * 100.0::DOUBLE / COUNT(*), 2) AS FLOAT) AS missing_pct FROM rolled"
        for n in (1, 2, 3, 7, 14, 21, 28)
    )
    + ") WHERE missing_count > 0",
)
def lag_nulls(fx):
    return f32(quality.lag_null_report(sales_lags(fx.clean)), "missing_pct")


@query(
    "a52_daily_fit",
    f"WITH {BASELINE_SQL} SELECT date, model, CAST(AVG(actual_sales) AS FLOAT) AS mean_actual, CAST(AVG(forecast_sales) AS FLOAT) AS mean_forecast FROM preds GROUP BY 1, 2",
)
def daily_fit(fx):
    return f32(ev.daily_fit(with_baselines(fx), MODELS), "mean_actual", "mean_forecast")


#: Features of the store, as ``quality.default_features`` finds them.
FEATURES = tuple(c for c in STORE_NUMBERS if c not in ("unit_sales", *quality.SAME_DAY_OUTCOMES))


@query(
    "m26_store_audit",
    f"WITH st AS MATERIALIZED ({STORED_SQL}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing, CAST(0 AS BIGINT) AS infinite, COUNT(DISTINCT {c}) <= 1 AS is_constant, CAST(0 AS BIGINT) AS duplicate_keys FROM st"
        for c in FEATURES
    ),
)
def store_audit(fx):
    """Every feature of the store before training."""
    table = stored(fx)
    return quality.feature_audit(table, quality.default_features(table), KEY)


# Fits: no SQL twin.

#: Bound of the registered boosted fits, which stop by patience on later dates.
ROUNDS, PATIENCE, TRIALS, TOP = 200, 10, 15, 20


def model_table(fx):
    """The feature store, written once for the many passes of a fit, and the features known before the day."""
    table = settle(fx.features, "store")
    return table, quality.default_features(table)


def parts(fx):
    """Early and late rows by date, and the features."""
    table, features = model_table(fx)
    early, late = ev.split_by_date(table, ev.date_cutoff(table))
    return early, late, features


PENALTIES = {"ols": ("ols",), "ridge": ("ridge", 1.0), "lasso": ("lasso", 0.01), "elasticnet": ("elasticnet", 0.01, 0.5)}


def linear_fits(frame, features):
    """The four fits from one pass over the rows."""
    known = linear_fit.moments(frame, features, models.LABEL)
    return {name: linear_fit.solve(known, *penalty) for name, penalty in PENALTIES.items()}


def fit_linear_models(frame, features):
    return {name: linear_fit.as_pipeline(fit, features, models.LABEL, models.PREDICTION) for name, fit in linear_fits(frame, features).items()}


@query("m06_linear_models")
def linear(fx):
    early, late, features = parts(fx)
    return models.score_saved(fit_linear_models(models.training_frame(early, features), features), late, features)


STORE_CUTOFF_SQL = CUTOFF_SQL.replace("FROM train", "FROM fstore")


@query(
    "m06_optimality",
    f"""SELECT model, (SELECT COUNT(*) FROM fstore WHERE date < {STORE_CUTOFF_SQL}) AS n_rows, {len(FEATURES)} AS n_features, TRUE AS is_optimal
        FROM (VALUES ('ols'), ('ridge'), ('lasso'), ('elasticnet')) v(model)""",
)
def linear_optimality(fx):
    """Every fit meets its optimality conditions on the rows themselves, in a pass of its own."""
    early, _, features = parts(fx)
    frame = models.training_frame(early, features)
    found = linear_fit.optimality(frame, features, models.LABEL, linear_fits(frame, features))
    return found.select("model", "n_rows", "n_features", (F.col("violation") <= 1e-6).alias("is_optimal"))


@query("m07_coefficients")
def coefficients(fx):
    early, _, features = parts(fx)
    return models.coefficients(models.fit_linear(models.training_frame(early, features), features, "lasso", 0.01), features)


@query("m08_random_forest")
def forest(fx):
    early, late, features = parts(fx)
    model = models.fit_forest(models.training_frame(early, features), features)
    return models.score_saved({"random_forest": model}, late, features)


@query("m09_boosted_trees")
def boosted(fx):
    """Boosted trees stopped by patience: their errors, the trees kept and the trees built."""
    early, late, features = parts(fx)
    frame, later = models.training_frame(early, features).persist(), models.training_frame(late, features).persist()
    model, curve = models.fit_patiently(frame, features, later, ROUNDS, PATIENCE)
    frame.unpersist()
    later.unpersist()
    return models.score_saved({"boosted_trees": model}, late, features).withColumns(
        {"n_trees": F.lit(model.stages[-1].getNumTrees), "n_rounds": F.lit(len(curve))}
    )


@query("m10_full_history_training")
def full_history(fx):
    """One fit on all rows before the horizon; rows per half-year window as the training report."""
    table, features = model_table(fx)
    model, _, late = fc.train(table, features=features, rounds=ROUNDS, patience=PATIENCE)
    trees = model.stages[-1].getNumTrees
    return half_year_rows(table).withColumns({"n_trees": F.lit(trees), "n_holdout": late.agg(F.count("*")).scalar()})


def all_models(early, features):
    """The fits that compete; the boosted one stops by patience on the last dates before the validation rows."""
    frame = models.training_frame(early, features).persist()
    fitted = {**fit_linear_models(frame, features), "random_forest": models.fit_forest(frame, features)}
    frame.unpersist()
    return {**fitted, "boosted_trees": fc.fit_before(early, features, rounds=ROUNDS, patience=PATIENCE)}


@query("m16_score_saved_models")
def saved(fx):
    from pyspark.ml import PipelineModel

    from larder.session import scratch_path

    early, late, features = parts(fx)
    loaded = {}
    for kind, model in all_models(early, features).items():
        path = scratch_path(fx.spark, f"model-{kind}")
        model.write().overwrite().save(path)
        loaded[kind] = PipelineModel.load(path)
    return ev.leaderboard(models.score_saved(loaded, late, models.features_of(loaded["boosted_trees"])))


@query("m17_feature_importance")
def importance(fx):
    early, _, features = parts(fx)
    return models.importances(fx.spark, models.fit_forest(models.training_frame(early, features), features), features)


@query("m18_batch_inference")
def inference(fx):
    """The champion of the saved models by RMSLE, fitted before the horizon, forecasts the horizon."""
    table, features = model_table(fx)
    early, late = ev.split_by_date(table, ev.date_cutoff(table))
    candidates = all_models(early, features)
    best = ev.champion(models.score_saved(candidates, late, features)).first()["model"]
    return fc.forecast(table, candidates[best], models.features_of(candidates[best]))


@query("m21_ablation")
def ablation(fx):
    """All features against the ``TOP`` ones by measured importance."""
    early, late, features = parts(fx)
    model = models.fit_forest(models.training_frame(early, features), features)
    top = [r["feature"] for r in models.importances(fx.spark, model, features).orderBy("rank").limit(TOP).collect()]
    return models.ablation(early, late, {"all": features, "top": top})


@query("m21_target_comparison")
def comparison(fx):
    early, late, features = parts(fx)
    return models.target_comparison(early, late, features)


@query("m22_search")
def search(fx):
    table, features = model_table(fx)
    return models.search_boosted(table, features, TRIALS)
