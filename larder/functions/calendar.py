"""Calendar expressions of a date column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the source system's truncated pi, kept for equal sin/cos values.
PI = 3.14159265
EVENT_WINDOW = ("2016-04-16", "2016-05-16")


def day_of_week(date: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(date) - 1


def is_weekend(date: Column) -> Column:
    return F.when(F.dayofweek(date).isin(1, 7), 1).otherwise(0)


def is_payday(date: Column) -> Column:
    return F.when((F.dayofmonth(date) == 15) | (date == F.last_day(date)), 1).otherwise(0)


def in_event_window(date: Column, window=EVENT_WINDOW) -> Column:
    first, last = (F.lit(day).cast("date") for day in window)
    return F.when(date.between(first, last), 1).otherwise(0)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0 * PI) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def date_parts(df: DataFrame, date="date") -> DataFrame:
    """The twelve calendar features."""
    d = F.col(date)
    sin_month, cos_month = cyclic(F.month(d), 12)
    sin_dow, cos_dow = cyclic(day_of_week(d), 7)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "day": F.dayofmonth(d),
            "day_of_week": day_of_week(d),
            "week_of_year": F.weekofyear(d),
            "quarter": F.quarter(d),
            "day_of_year": F.dayofyear(d),
            "is_weekend": is_weekend(d),
            "sin_month": sin_month,
            "cos_month": cos_month,
            "sin_dow": sin_dow,
            "cos_dow": cos_dow,
        }
    )


def weekday_name(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_day(date: Column) -> Column:
    return F.date_format(date, "MM-dd")


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")
