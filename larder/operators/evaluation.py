"""Model evaluation as table jobs: splits, baselines, metrics, leaderboards, diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from larder.functions.scalars import absolute_error, is_infinite, percent_error, replace_non_finite
from larder.operators.aggregates import histogram
from larder.operators.quantiles import exact_quantiles
from larder.operators.ranking import rank_by
from larder.operators.windows import share_of_total


def date_cutoff(df: DataFrame, share=0.8, date="date"):
    """The date after ``share`` of the distinct dates, as a scalar subquery."""
    days = df.select(date).distinct()
    numbered = days.withColumn("_i", F.row_number().over(Window.orderBy(date)) - 1)
    total = days.agg(F.count("*")).scalar()
    return numbered.where(F.col("_i") == F.floor(total * F.lit(share))).agg(F.max(date)).scalar()


def horizon_start(df: DataFrame, days=16, date="date"):
    """First of the last ``days`` distinct dates."""
    last = df.select(date).distinct().orderBy(F.desc(date)).limit(days)
    return last.agg(F.min(date)).scalar()


def split_by_date(df: DataFrame, cutoff, date="date") -> tuple[DataFrame, DataFrame]:
    edge = F.lit(cutoff).cast("date") if isinstance(cutoff, str) else cutoff
    return df.where(F.col(date) < edge), df.where(F.col(date) >= edge)


def standardise(train: DataFrame, df: DataFrame, columns, suffix="_scaled") -> DataFrame:
    """Centre and scale by the mean and population deviation of ``train``; a constant column is only centred."""
    stats = train.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}__std") for c in columns]
    )
    out = {}
    for c in columns:
        mean, std = stats.select(f"{c}__mean").scalar(), stats.select(f"{c}__std").scalar()
        out[f"{c}{suffix}"] = (F.col(c) - mean) / F.when(std > 0, std).otherwise(1.0)
    return df.withColumns(out)


def constant_baselines(train: DataFrame, validation: DataFrame, target="unit_sales") -> DataFrame:
    """Global mean and global median of the training target on every validation row."""
    mean = train.agg(F.avg(target)).scalar()
    median = exact_quantiles(train, target, (0.5,), names=("median",)).scalar()
    return validation.withColumns({"global_mean": mean, "global_median": median})


def seasonal_naive(df: DataFrame, lag="sales_lag_7", alias="seasonal_naive") -> DataFrame:
    return df.withColumn(alias, F.coalesce(F.col(lag), F.lit(0.0)))


MAPE_ROWS = ("all", "gt1", "positive")


def metrics(df: DataFrame, actual="actual_sales", predicted="forecast_sales", mape="gt1", by=()) -> DataFrame:
    """RMSE, MAE, RMSLE, R2 and MAPE of values clipped at 0, in one aggregate.

    MAPE rows: ``all`` (zero actuals divide by machine epsilon), ``gt1`` (above 1), ``positive``.
    """
    if mape not in MAPE_ROWS:
        raise ValueError(f"mape must be one of {MAPE_ROWS}")
    y = F.greatest(F.col(actual).cast("double"), F.lit(0.0))
    p = F.greatest(replace_non_finite(F.col(predicted)), F.lit(0.0))
    error, log_error = y - p, F.log1p(y) - F.log1p(p)
    base = {"all": F.greatest(y, F.lit(2.220446049250313e-16)), "gt1": F.when(y > 1, y), "positive": F.when(y > 0, y)}
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.avg(error * error).alias("_mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(log_error * log_error).alias("_msle"),
        F.var_pop(y).alias("_var"),
        F.avg(F.abs(error) / base[mape]).alias("_mape"),
    )
    return sums.select(
        *by,
        "n_rows",
        F.sqrt("_mse").alias("rmse"),
        "mae",
        F.sqrt("_msle").alias("rmsle"),
        (1 - F.try_divide(F.col("_mse"), F.col("_var"))).alias("r2"),
        (F.coalesce("_mape", F.lit(0.0)) * 100).alias("mape_pct"),
    )


def stack_predictions(df: DataFrame, models, keep=("actual_sales",)) -> DataFrame:
    """One prediction column per model to long form."""
    return df.select(*keep, *models).unpivot(list(keep), list(models), "model", "forecast_sales")


def score_models(df: DataFrame, models, actual="actual_sales", mape="gt1") -> DataFrame:
    """The metric set of several prediction columns."""
    return metrics(stack_predictions(df, models, (actual,)), actual, "forecast_sales", mape, by=("model",))


def leaderboard(scores: DataFrame) -> DataFrame:
    return rank_by(scores, "rmsle", "model", bounded=True).orderBy("rank")


def best_per_metric(scores: DataFrame) -> DataFrame:
    """The winner of each metric; ties by name."""
    picks = {"rmse": 1, "mae": 1, "rmsle": 1, "mape_pct": 1, "r2": -1}
    row = scores.agg(
        *[F.min_by(F.struct("model", F.col(m).alias("value")), F.struct(F.col(m) * s, "model")).alias(m) for m, s in picks.items()]
    )
    cells = [
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}.model").alias("model"), F.col(f"{m}.value").alias("value"))
        for m in picks
    ]
    return row.select(F.inline(F.array(*cells)))


def champion(scores: DataFrame) -> DataFrame:
    """The model with the lowest RMSLE; ties by name."""
    return scores.orderBy("rmsle", "model").limit(1)


def sanity_report(df: DataFrame, predicted="forecast_sales") -> DataFrame:
    p = F.col(predicted).cast("double")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(F.isnan(p), 1)).alias("nan_count"),
        F.count(F.when(is_infinite(p), 1)).alias("inf_count"),
        F.count(F.when((p < 0) & ~F.isnan(p), 1)).alias("negative_count"),
    )


def prediction_sample(df: DataFrame, n=1000, order=("date", "store_nbr", "item_nbr")) -> DataFrame:
    """The first ``n`` rows by key with their errors."""
    actual, predicted = F.col("actual_sales"), F.col("forecast_sales")
    return with_errors(df.orderBy(*order).limit(n)).select(*order, actual, predicted, "abs_error", "pct_error")


def with_errors(df: DataFrame, actual="actual_sales", predicted="forecast_sales") -> DataFrame:
    return df.withColumns(
        {
            "abs_error": absolute_error(F.col(actual), F.col(predicted)),
            "pct_error": percent_error(F.col(actual), F.col(predicted)),
        }
    )


def residuals(df: DataFrame, actual="actual_sales", predicted="forecast_sales") -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted)).withColumn("abs_error", F.abs("residual"))


def residual_histogram(df: DataFrame, low, high, bins=60, **columns) -> DataFrame:
    return histogram(residuals(df, **columns), "residual", low, high, bins)


def daily_fit(df: DataFrame, models, actual="actual_sales") -> DataFrame:
    """Mean actual and mean prediction per day and model."""
    return stack_predictions(df, models, ("date", actual)).groupBy("date", "model").agg(
        F.avg(actual).alias("mean_actual"), F.avg("forecast_sales").alias("mean_forecast")
    )


def blend(parts: dict[str, tuple[DataFrame, float]], keys=("date", "store_nbr", "item_nbr"), value="forecast_sales"):
    """Weighted sum of the predictions of several models, matched by key.

    The weighted rows are stacked and summed, so no join is needed; keys that some model lacks are dropped.
    """
    rows = [df.select(*keys, (F.col(value) * weight).alias(value)) for df, weight in parts.values()]
    stacked = reduce(DataFrame.unionByName, rows)
    return (
        stacked.groupBy(*keys)
        .agg(F.sum(value).alias(value), F.count("*").alias("_n"))
        .where(F.col("_n") == len(parts))
        .drop("_n")
    )


def importance_table(spark, names, values) -> DataFrame:
    """Features by importance with rank and share."""
    rows = [(name, float(value)) for name, value in zip(names, values)]
    table = spark.createDataFrame(rows, "feature STRING, importance DOUBLE")
    return share_of_total(rank_by(table, "importance", "feature", descending=True, bounded=True), "importance").orderBy("rank")
