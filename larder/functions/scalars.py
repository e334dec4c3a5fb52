"""Scalar expressions: clipping, coercion, labels, errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip_and_cap(value: Column, cap) -> Column:
    """Negative values become 0, values above ``cap`` become ``cap``."""
    return F.least(F.greatest(value, F.lit(0.0)), cap if isinstance(cap, Column) else F.lit(cap))


def return_flag(value: Column) -> Column:
    return F.when(value < 0, 1).otherwise(0)


def text_to_boolean(value: Column) -> Column:
    """Text that is no boolean, and null, count as false."""
    return F.coalesce(value.cast("string").try_cast("boolean"), F.lit(False))


def is_infinite(value: Column) -> Column:
    v = value.cast("double")
    return v.isin(float("inf"), float("-inf"))


def is_non_finite(value: Column) -> Column:
    return F.isnan(value.cast("double")) | is_infinite(value)


def replace_non_finite(value: Column, nan=0.0, posinf=0.0, neginf=0.0) -> Column:
    v = value.cast("double")
    return (
        F.when(F.isnan(v), F.lit(float(nan)))
        .when(v == float("inf"), F.lit(float(posinf)))
        .when(v == float("-inf"), F.lit(float(neginf)))
        .otherwise(v)
    )


def log_target(value: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0)))


def unlog_prediction(value: Column) -> Column:
    return F.expm1(F.greatest(value, F.lit(0.0)))


def ratio(numerator: Column, denominator: Column, default=None) -> Column:
    """Division that gives ``default`` (null if not set) for a zero denominator."""
    result = F.try_divide(numerator, denominator)
    return result if default is None else F.coalesce(result, F.lit(default))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def pearson(a: str, b: str) -> str:
    """Aggregate expression for the correlation of two columns; null if either is constant, where ``corr`` fails."""
    both = f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL"
    x, y = f"CASE WHEN {both} THEN CAST(`{a}` AS DOUBLE) END", f"CASE WHEN {both} THEN CAST(`{b}` AS DOUBLE) END"
    return f"try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y}))"


def sales_per_transaction(sales: Column, transactions: Column) -> Column:
    return sales / (transactions + F.lit(1))


def first_number(text: Column, default: int) -> Column:
    """First run of digits in a text such as ``SKU-12``."""
    digits = F.regexp_extract(text.cast("string"), r"([0-9]+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(default).cast("bigint"))


def to_number(value: Column, default: float) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(float(default)))


#: Accepted date layouts, tried in this order: shape of the text, and how to read it. Month goes before day.
DATE_LAYOUTS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"), (r"^\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"), (r"^\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"), (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy"),
)


def to_date(value: Column) -> Column:
    """A text that begins with a date in one of ``DATE_LAYOUTS``; null if it does not."""
    text = F.trim(value.cast("string"))
    found = [F.try_to_date(F.nullif(F.regexp_extract(text, shape, 0), F.lit("")), layout) for shape, layout in DATE_LAYOUTS]
    return F.coalesce(*found)


def clean_header(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, "[\"']", "")))


def store_label(store: Column) -> Column:
    return F.concat(F.lit("Store #"), store.cast("string"))


def sku_label(item: Column) -> Column:
    return F.concat(F.lit("SKU-"), item.cast("string"))


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def percent_error(actual: Column, predicted: Column) -> Column:
    """0 where the actual value is not positive."""
    return F.when(actual > 0, F.try_divide(F.abs(actual - predicted), actual) * 100.0).otherwise(0.0)
