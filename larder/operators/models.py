"""Distributed model fits with pyspark.ml."""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.functions.scalars import log_target, replace_non_finite, unlog_prediction
from larder.operators.evaluation import importance_table, metrics
from larder.operators.joins import align_columns
from larder.operators.linear import Moments, as_pipeline, moments, solve
from larder.operators.ranking import rank_by

LABEL = "log_sales"
PREDICTION = "log_forecast"


def training_frame(df: DataFrame, features, target="unit_sales", keep=()) -> DataFrame:
    """Aligned double features (null is 0) and the log1p target."""
    label = log_target(F.col(target)).alias("_label")
    aligned = align_columns(df.withColumn("_label", label), features, keep=(*keep, "_label"))
    return aligned.withColumnRenamed("_label", LABEL)


def feature_vectors(df: DataFrame, features, output="features") -> DataFrame:
    """Dense feature vector with nulls as 0."""
    filled = df.fillna(0.0, subset=list(features))
    return VectorAssembler(inputCols=list(features), outputCol=output).transform(filled)


def vector_columns(df: DataFrame, column="features") -> DataFrame:
    return df.withColumn(f"{column}_array", vector_to_array(column))


def _pipeline(features, estimator) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, estimator.setFeaturesCol("features").setLabelCol(LABEL).setPredictionCol(PREDICTION)])


def fit_linear(train: DataFrame, features, kind="ols", alpha=1.0, l1_ratio=0.5, known: Moments | None = None) -> PipelineModel:
    """``ols``, ``ridge``, ``lasso`` or ``elasticnet`` on the raw feature scale, from one pass of moments or ``known`` ones."""
    fit = solve(known or moments(train, features, LABEL), kind, alpha, l1_ratio)
    return as_pipeline(fit, features, LABEL, PREDICTION)


def fit_forest(train: DataFrame, features, trees=50, depth=10, leaf=50, seed=42) -> PipelineModel:
    estimator = RandomForestRegressor(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", minInstancesPerNode=leaf, seed=seed
    )
    return _pipeline(features, estimator).fit(train)


def best_round(curve, patience) -> tuple[int, bool]:
    """Place of the least loss before ``patience`` rounds pass without a lower one, and whether they did."""
    best = 0
    for i, loss in enumerate(curve):
        if loss < curve[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def staged_loss(model: PipelineModel, rows: DataFrame) -> list[float]:
    """Mean squared error of the first 1, 2, ... trees on rows with features and target; one pass."""
    *before, boosted = model.stages
    known = rows.withColumn(boosted.getLabelCol(), F.col(LABEL))  # a model cut back or loaded may name its target otherwise
    return boosted.evaluateEachIteration(PipelineModel(before).transform(known), "squared")


def first_trees(model: PipelineModel, count: int) -> PipelineModel:
    """The ensemble cut back to its first ``count`` trees."""
    *before, boosted = model.stages
    if count >= boosted.getNumTrees:
        return model
    context, java = SparkSession.active().sparkContext, boosted._java_obj
    regression = context._jvm.org.apache.spark.ml.regression
    trees = context._gateway.new_array(regression.DecisionTreeRegressionModel, count)
    weights = context._gateway.new_array(context._gateway.jvm.double, count)
    for i, tree in enumerate(java.trees()[:count]):
        trees[i], weights[i] = tree, java.treeWeights()[i]
    cut = GBTRegressionModel(regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures()))
    cut._resetUid(java.uid())
    return PipelineModel([*before, cut.setFeaturesCol("features").setPredictionCol(PREDICTION)])


def fit_boosted(
    train: DataFrame, features, validation: DataFrame | None = None, rounds=50, rate=0.1, depth=5, row_share=0.8,
    column_share="0.8", patience=10, first=25, seed=42,
) -> PipelineModel:
    """Boosted trees on all rows. With validation rows, ``rounds`` is only a bound: see ``fit_patiently``."""
    if validation is not None:
        settings = dict(rate=rate, depth=depth, row_share=row_share, column_share=column_share, seed=seed)
        return fit_patiently(train, features, validation, rounds, patience, first, **settings)[0]
    estimator = GBTRegressor(
        maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=row_share, featureSubsetStrategy=column_share, seed=seed
    )
    return _pipeline(features, estimator).fit(train)


def fit_patiently(train: DataFrame, features, validation: DataFrame, rounds=500, patience=10, first=25, **settings):
    """(model, staged losses): boosting stopped by patience and cut back to its best round.

    The ensemble grows to ``first`` trees, then to twice as many, until the loss on the validation rows has not fallen for
    ``patience`` rounds or ``rounds`` are reached. A longer fit repeats the shorter one under the same seed,
    so at most twice the needed trees are built, by the library's own distributed fit.
    """
    count = min(first, rounds)
    while True:
        model = fit_boosted(train, features, rounds=count, **settings)
        curve = staged_loss(model, validation)
        best, stopped = best_round(curve, patience)
        if stopped or count >= rounds:
            return first_trees(model, best + 1), curve
        count = min(2 * count, rounds)


def features_of(model: PipelineModel) -> list[str]:
    """The columns a saved pipeline expects."""
    return list(model.stages[0].getInputCols())


def coefficients(model: PipelineModel, features) -> DataFrame:
    """Coefficients by absolute size, with the percentage of zeros."""
    linear = model.stages[-1]
    values = [float(v) for v in linear.coefficients.toArray()]
    zero = 100.0 * sum(v == 0 for v in values) / max(1, len(values))
    table = SparkSession.active().createDataFrame(
        list(zip(features, values, (abs(v) for v in values))),
        "feature STRING, coefficient DOUBLE, abs_coefficient DOUBLE",
    )
    return rank_by(table, "abs_coefficient", "feature", descending=True, bounded=True).withColumn("sparsity_pct", F.lit(zero))


def importances(spark, model: PipelineModel, features) -> DataFrame:
    return importance_table(spark, features, model.stages[-1].featureImportances.toArray())


def predict(model: PipelineModel, df: DataFrame, features, keep=("date", "store_nbr", "item_nbr"), digits=2) -> DataFrame:
    """Predict, clip at 0, back from logs, round. Columns the table lacks count as 0; ``keep`` columns stay as they are."""
    kept = {f"_keep_{c}": F.col(c) for c in keep}
    aligned = align_columns(df.withColumns({**kept, "_actual": F.col("unit_sales")}), features, keep=(*kept, "_actual"))
    scored = model.transform(aligned)
    forecast = unlog_prediction(replace_non_finite(F.col(PREDICTION)))
    return scored.select(
        *(F.col(f"_keep_{c}").alias(c) for c in keep),
        (F.round(forecast, digits) if digits is not None else forecast).alias("forecast_sales"),
        F.col("_actual").alias("actual_sales"),
    )


def rule_forecast(df: DataFrame, lift=0.35, sales="unit_sales", promo="onpromotion") -> DataFrame:
    """The model-free forecast: sales, raised on promotion."""
    raised = F.col(sales) * (1 + F.col(promo).cast("double") * lift)
    return df.withColumns({"forecast_sales": F.round(raised, 2), "actual_sales": F.col(sales)})


def score_saved(models: dict[str, PipelineModel], validation: DataFrame, features, mape="gt1") -> DataFrame:
    """Every model on the same validation rows."""
    result = None
    for name, model in models.items():
        row = metrics(predict(model, validation, features, digits=None), mape=mape).withColumn("model", F.lit(name))
        result = row if result is None else result.unionByName(row)
    return result


def ablation(train: DataFrame, validation: DataFrame, feature_sets: dict, fit=fit_linear) -> DataFrame:
    """Metrics of one estimator on several feature sets."""
    result = None
    for name, features in feature_sets.items():
        model = fit(training_frame(train, features), features)
        row = metrics(predict(model, validation, features, digits=None)).withColumns(
            {"feature_set": F.lit(name), "n_features": F.lit(len(features))}
        )
        result = row if result is None else result.unionByName(row)
    return result


def target_comparison(train: DataFrame, validation: DataFrame, features) -> DataFrame:
    """The same linear model on the log target and on the raw target."""
    logged = metrics(predict(fit_linear(training_frame(train, features), features), validation, features, digits=None))
    raw_frame = training_frame(train, features, keep=("unit_sales",)).withColumn(LABEL, F.col("unit_sales").cast("double"))
    raw_model = fit_linear(raw_frame, features)
    aligned = align_columns(validation.withColumn("_actual", F.col("unit_sales")), features, keep=("_actual",))
    raw = raw_model.transform(aligned).select(F.col("_actual").alias("actual_sales"), F.col(PREDICTION).alias("forecast_sales"))
    return logged.withColumn("target", F.lit("log")).unionByName(metrics(raw).withColumn("target", F.lit("raw")))


def date_folds(df: DataFrame, folds=3, first=0.4, width=0.2, date="date") -> list[tuple]:
    """Dates (start, end) of validation windows that roll forward over the distinct dates; all earlier dates train."""
    days = [r[date] for r in df.select(date).distinct().orderBy(date).collect()]  # one row per day of the calendar
    step = (1 - first - width) / max(folds - 1, 1)
    edges = [(int(len(days) * (first + i * step)), int(len(days) * (first + i * step + width))) for i in range(folds)]
    return [(days[low], days[min(high, len(days)) - 1]) for low, high in edges if low < high]


def trial_settings(trials=15, seed=42) -> list[dict]:
    """Seeded settings: depth, rate (log-uniform), row and column shares."""
    rng, out = random.Random(seed), []
    for _ in range(trials):
        depth = rng.randint(3, 8)
        rate = round(math.exp(rng.uniform(math.log(0.01), math.log(0.15))), 4)
        rows, columns = round(rng.uniform(0.5, 0.95), 2), str(round(rng.uniform(0.5, 0.95), 2))
        out.append(dict(depth=depth, rate=rate, row_share=rows, column_share=columns))
    return out


def search_boosted(df: DataFrame, features, trials=15, keep=(5, 2), progress=(0.15, 0.45, 1.35), seed=42) -> DataFrame:
    """Successive halving over date folds: all trials briefly on the first fold, the ``keep`` best longer on each later one.

    A rung gives every trial the same progress, rounds times rate: a slow rate gets more rounds, so trials are not
    ranked by their rate. The loss is that of the best round so far. One row per trial: settings, the last rung it
    reached, rounds and loss there, and its rank (later rungs first, then loss).
    """
    settings, left, rows = trial_settings(trials, seed), list(range(trials)), {}
    for rung, (low, high) in enumerate(date_folds(df, len(progress))):
        past = training_frame(df.where(F.col("date") < F.lit(low)), features).persist()
        window = training_frame(df.where(F.col("date").between(F.lit(low), F.lit(high))), features).persist()
        losses = {}
        for trial in left:
            rounds = max(2, math.ceil(progress[rung] / settings[trial]["rate"]))
            curve = staged_loss(fit_boosted(past, features, rounds=rounds, seed=seed, **settings[trial]), window)
            losses[trial] = min(curve)
            rows[trial] = (rung, rounds, int(np.argmin(curve)) + 1, math.sqrt(losses[trial]))
        past.unpersist()
        window.unpersist()
        if rung < len(keep):
            left = sorted(left, key=lambda t: (losses[t], t))[: keep[rung]]
    order = sorted(rows, key=lambda t: (-rows[t][0], rows[t][3], t))
    table = [
        (t, s["depth"], s["rate"], s["row_share"], float(s["column_share"]), *rows[t], order.index(t) + 1)
        for t, s in enumerate(settings) if t in rows
    ]
    return df.sparkSession.createDataFrame(
        table, "trial INT, depth INT, rate DOUBLE, row_share DOUBLE, column_share DOUBLE, rung INT, rounds INT, best_rounds INT, rmsle DOUBLE, rank INT"
    )
