"""Training, batch inference and replenishment over the forecast horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.operators.evaluation import horizon_start, split_by_date
from larder.operators.inventory import horizon_demand, replenish
from larder.operators.models import fit_boosted, fit_patiently, predict, rule_forecast, training_frame
from larder.operators.quality import default_features


def fit_before(past: DataFrame, features, days=16, rounds=500, patience=10, refit=True, **settings):
    """Boosted trees on ``past``: its last ``days`` dates choose the number of rounds, then all of it is fitted with so many.

    Without ``refit`` the model that never saw those dates is returned.
    """
    early, last = split_by_date(past, horizon_start(past, days))
    frame, later = training_frame(early, features).persist(), training_frame(last, features).persist()
    model, _ = fit_patiently(frame, features, later, rounds, patience, **settings)
    frame.unpersist()
    later.unpersist()
    return fit_boosted(training_frame(past, features), features, rounds=model.stages[-1].getNumTrees, **settings) if refit else model


def train(store: DataFrame, cutoff=None, features=None, fit=fit_before, **settings):
    """Fit on the dates before the cutoff (default: the last 16 dates). Returns model, features, validation rows.

    ``fit`` takes the past rows and the features; the rows after the cutoff are never seen by it.
    """
    features = list(features or default_features(store))
    edge = cutoff if cutoff is not None else horizon_start(store)
    past, future = split_by_date(store, edge)
    return fit(past, features, **settings), features, future


def forecast(store: DataFrame, model=None, features=None, start=None) -> DataFrame:
    """Forecast rows of the horizon: by model, or by rule when there is none."""
    edge = start if start is not None else horizon_start(store)
    rows = store.where(F.col("date") >= edge)
    if model is None:
        return rule_forecast(rows)
    return predict(model, rows, features)


def replenishment(forecast_rows: DataFrame, stock: DataFrame, variant="mean", **settings) -> DataFrame:
    extra = (F.sum("actual_sales").alias("actual_sales_16d"),)
    return replenish(horizon_demand(forecast_rows, variant, extra=extra), stock, **settings)
