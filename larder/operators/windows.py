"""Series windows: lags, rolling statistics, EWMA, fills, shares, control limits.

Series operators need one row per key and order value (see ``quality.require_unique``),
so a series is never longer than its calendar. All of them partition by the same
keys and therefore share one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.operators.ordered import in_order

KEYS = ("store_nbr", "item_nbr")


def series(keys=KEYS, order="date"):
    return Window.partitionBy(*keys).orderBy(order)


def lags(df: DataFrame, value="unit_sales", steps=(1, 2, 3, 7, 14, 21, 28), keys=KEYS, order="date", prefix=None):
    """Earlier values by rows, not days. Booleans become 0/1."""
    w = series(keys, order)
    column = F.col(value)
    if dict(df.dtypes)[value] == "boolean":
        column = column.cast("int")
    prefix = prefix or f"{value}_lag"
    return df.withColumns({f"{prefix}_{n}": F.lag(column, n).over(w) for n in steps})


def _prior(n=None, keys=KEYS, order="date"):
    return series(keys, order).rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def rolling(df: DataFrame, func, sizes, value="unit_sales", keys=KEYS, order="date", prefix=None) -> DataFrame:
    """``mean``, ``std``, ``min``, ``max`` or ``median`` over the ``n`` rows before the current one."""
    functions = {
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "median": lambda c: _middle(F.sort_array(F.collect_list(c))),
    }
    prefix = prefix or f"{value}_roll_{func}"
    if func == "median":
        # Spark has no median over a frame; the frame has at most n values.
        lists = {f"_list_{n}": F.collect_list(value).over(_prior(n, keys, order)) for n in sizes}
        out = df.withColumns(lists)
        out = out.withColumns({f"{prefix}_{n}": _middle(F.sort_array(f"_list_{n}")) for n in sizes})
        return out.drop(*lists)
    return df.withColumns({f"{prefix}_{n}": functions[func](value).over(_prior(n, keys, order)) for n in sizes})


def _middle(ordered: Column) -> Column:
    size = F.size(ordered)
    low = F.get(ordered, F.floor((size - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(size / 2).cast("int"))
    return F.when(size > 0, (low + high) / 2)


def expanding(df: DataFrame, value="unit_sales", keys=KEYS, order="date", prefix=None) -> DataFrame:
    """Mean and sample deviation of all earlier values."""
    frame = _prior(None, keys, order)
    prefix = prefix or f"{value}_expanding"
    return df.withColumns(
        {f"{prefix}_mean": F.avg(value).over(frame), f"{prefix}_std": F.stddev_samp(value).over(frame)}
    )


def _block_length(spans) -> int | None:
    """Rows per block for which every span's oldest weight is negligible and its inverse is finite."""
    rates = [-math.log(1 - 2 / (span + 1)) for span in spans]
    length = int(600 / max(rates))
    return length if length >= 45 / min(rates) else None


def ewma(df: DataFrame, spans=(7, 14, 28), value="unit_sales", keys=KEYS, order="date", prefix=None) -> DataFrame:
    """Exponentially weighted mean of earlier values: e1 = x1, e(t) = a x(t) + (1-a) e(t-1), a = 2/(span+1).

    With q = 1-a the mean is q^t times a running sum of x(i) q^-i. To keep the powers finite on
    any length of series, rows are cut into long blocks; a block starts from the last value of the
    block before, and what lies further back weighs less than double precision. No array holds a series
    and no Python runs. The mean starts at the first value; a null later on leaves it as it was.
    """
    prefix = prefix or f"{value}_ewma"
    plain = [s for s in spans if s <= 1]
    spans_left = [s for s in spans if s > 1]
    earlier = series(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({f"{prefix}_{s}": F.last(value, ignorenulls=True).over(earlier) for s in plain})
    if not spans_left:
        return out
    block = _block_length(spans_left)
    if block is None:
        for span in spans_left:
            out = ewma(out, (span,), value, keys, order, prefix)
        return out
    w = series(keys, order)
    out = out.withColumns({"_row": F.count(value).over(earlier) - 1, "_before": F.lag(value).over(w)})
    out = out.withColumns({"_block": F.floor(F.col("_row") / block), "_place": F.pmod(F.col("_row"), F.lit(block))})
    # The block grows with the order column, so one sort serves the whole series and its blocks.
    whole = Window.partitionBy(*keys).orderBy("_block", order)
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local, carry = {}, {}
    for span in spans_left:
        q = 1 - 2 / (span + 1)
        scaled = F.expr(f"CASE WHEN _row = 0 THEN _before ELSE {1 - q!r}D * _before * pow({1 / q!r}D, _place) END")
        local[f"_local_{span}"] = F.sum(scaled).over(inside) * F.expr(f"pow({q!r}D, _place)")
        carry[f"_carry_{span}"] = F.when((F.col("_place") == 0) & (F.col("_row") > 0), F.lag(f"_local_{span}").over(whole))
    out = out.withColumns(local).withColumns(carry)
    out = out.withColumns({c: F.first(c).over(inside) for c in carry})
    for span in spans_left:
        q = 1 - 2 / (span + 1)
        state = f"_local_{span} + coalesce(_carry_{span}, 0D) * pow({q!r}D, _place + 1)"
        out = out.withColumn(f"{prefix}_{span}", F.expr(f"CASE WHEN _row >= 0 THEN {state} END"))
    return out.drop("_row", "_before", "_block", "_place", *local, *carry)


def trailing_mean(df: DataFrame, value, sizes, keys=(), order="date", current=True, full=False, prefix=None):
    """Rolling mean; with the current row or only earlier ones, null until the frame is full if asked."""
    prefix = prefix or f"{value}_roll_mean"
    columns = {}
    for n in sizes:
        frame = series(keys, order).rowsBetween(-(n - 1), 0) if current else _prior(n, keys, order)
        mean = F.avg(value).over(frame)
        columns[f"{prefix}_{n}"] = F.when(F.count(value).over(frame) >= n, mean) if full else mean
    return df.withColumns(columns)


def change(df: DataFrame, value, n, keys=(), order="date", relative=False, alias=None, default=0.0) -> DataFrame:
    """Difference (or relative change) to the value ``n`` rows earlier; nulls become ``default``."""
    before = F.lag(value, n).over(series(keys, order))
    result = F.col(value) - before
    if relative:
        result = F.try_divide(result, before)
    return df.withColumn(alias or f"{value}_diff_{n}", F.coalesce(result, F.lit(default)))


def fill_both_ways(df: DataFrame, value, order="date", keys=()) -> DataFrame:
    """Forward fill, then backward fill."""
    w = series(keys, order)
    forward = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    backward = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(forward, backward))


def fill_forward(df: DataFrame, value, order="date", keys=()) -> DataFrame:
    w = series(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def rolling_correlation(df: DataFrame, a, b, n=60, keys=(), order="date", alias="rolling_corr") -> DataFrame:
    frame = series(keys, order).rowsBetween(-(n - 1), 0)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
    # Not corr(): it raises on a constant frame.
    spread = F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame)
    value = F.try_divide(F.covar_pop(x, y).over(frame), spread)
    return df.withColumn(alias, F.when(F.count(F.when(both, 1)).over(frame) >= n, value))


def group_totals(df: DataFrame, value, by=KEYS, prefix=None) -> DataFrame:
    """Group sum and sample deviation on every row; aggregated first, so a hot group is combined map-side."""
    prefix = prefix or value
    totals = df.groupBy(*by).agg(F.sum(value).alias(f"{prefix}_sum"), F.stddev_samp(value).alias(f"{prefix}_std"))
    return df.join(totals, list(by), "left")


def running_total(df: DataFrame, value, order="date", keys=(), alias="cumulative", ties=()) -> DataFrame:
    """Running sum per key, or over the whole table in ranges of the order (``ties`` complete it)."""
    if not keys:
        return in_order(df, [F.col(order), *[F.col(c) for c in ties]], {alias: F.col(value)})
    return df.withColumn(
        alias, F.sum(value).over(series(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    )


def pareto(df: DataFrame, value, name, alias="cumulative_pct") -> DataFrame:
    """Descending cumulative share in percent; ties by name."""
    out = in_order(df, [F.col(value).desc(), F.col(name)], {"_upto": F.col(value)})
    return out.withColumn(alias, F.try_divide(F.col("_upto") * 100.0, df.agg(F.sum(value)).scalar())).drop("_upto")


def share_of_total(df: DataFrame, value, alias="share_pct", by=()) -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*by)) if by else df.agg(F.sum(value)).scalar()
    return df.withColumn(alias, F.try_divide(F.col(value) * 100.0, total))


def control_limits(df: DataFrame, value, k=2.0) -> DataFrame:
    """Mean and ``k`` population deviations over the whole series; rows outside are flagged."""
    limits = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    mean, deviation = limits.select("m").scalar(), limits.select("s").scalar()
    out = df.withColumns(
        {
            "series_mean": mean,
            "upper_limit": mean + F.lit(k) * deviation,
            "lower_limit": mean - F.lit(k) * deviation,
        }
    )
    return out.withColumn(
        "is_anomaly", (F.col(value) > F.col("upper_limit")) | (F.col(value) < F.col("lower_limit"))
    )


def minmax_scale(df: DataFrame, columns, by=(), constant=50.0, suffix="_scaled") -> DataFrame:
    """0 to 100 between the smallest and largest value; a constant column gives ``constant``."""
    w, out = Window.partitionBy(*by), {}
    ends = None if by else df.agg(*[f(c).alias(f"{c}__{f.__name__}") for c in columns for f in (F.min, F.max)])
    for c in columns:
        low, high = (F.min(c).over(w), F.max(c).over(w)) if by else (ends.select(f"{c}__min").scalar(), ends.select(f"{c}__max").scalar())
        out[f"{c}{suffix}"] = F.when(high > low, (F.col(c) - low) / (high - low) * 100.0).otherwise(F.lit(constant))
    return df.withColumns(out)


def max_scale(df: DataFrame, value, by=(), floor=1.0, alias=None) -> DataFrame:
    """Percent of the largest value (at least ``floor``)."""
    largest = F.max(value).over(Window.partitionBy(*by)) if by else df.agg(F.max(value)).scalar()
    return df.withColumn(alias or f"{value}_scaled", F.col(value) / F.greatest(largest, F.lit(floor)) * 100.0)
