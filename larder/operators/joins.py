"""Joins. No side is forced to broadcast: Catalyst and AQE choose by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.errors import DataValidationError

JOIN_KINDS = {"left": "left", "inner": "inner", "right": "right", "full": "full", "outer": "full"}


def join_on(left: DataFrame, right: DataFrame, on, how="left", right_columns=None, path=None) -> DataFrame:
    """Equi-join; only ``right_columns`` (default: those the left side lacks) are taken from the right.

    The result is written and read back when ``path`` is given.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how.lower() not in JOIN_KINDS:
        raise DataValidationError(f"unsupported join: {how}")
    wanted = list(right_columns) if right_columns is not None else [c for c in right.columns if c not in left.columns]
    narrow = right.select(*keys, *[c for c in wanted if c not in keys])
    result = left.join(narrow, keys, JOIN_KINDS[how.lower()])
    if path is None:
        return result
    result.write.mode("overwrite").parquet(path)
    return left.sparkSession.read.parquet(path)


def join_all(left: DataFrame, *steps, how="left") -> DataFrame:
    """Chain of joins; each step is ``(right, keys)`` or ``(right, keys, right_columns)``."""
    result = left
    for right, keys, *columns in steps:
        result = join_on(result, right, keys, how, columns[0] if columns else None)
    return result


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row frame on every row, as scalar subqueries rather than a join."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def attach_total(df: DataFrame, source: DataFrame | None = None, alias="total_rows") -> DataFrame:
    return df.withColumn(alias, (source if source is not None else df).agg(F.count("*")).scalar())


def date_spine(df: DataFrame, date="date") -> DataFrame:
    """Every calendar day between the first and last date of ``df``."""
    span = df.agg(F.min(date).alias("_first"), F.max(date).alias("_last")).where(F.col("_first").isNotNull())
    return span.select(F.explode(F.expr("sequence(_first, _last, interval 1 day)")).alias(date))


def on_calendar(df: DataFrame, spine: DataFrame, date="date") -> DataFrame:
    """Left join of a date-keyed table to a spine of days."""
    return spine.join(df, date, "left")


def align_columns(df: DataFrame, expected, keep=()) -> DataFrame:
    """The expected columns as doubles, in order; absent ones and nulls are 0."""
    present = set(df.columns)
    features = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in present else F.lit(0.0).alias(c)
        for c in expected
    ]
    return df.select(*keep, *features)
