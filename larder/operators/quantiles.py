"""Exact interpolated quantiles without collecting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _splits(df: DataFrame) -> int:
    """Value ranges per group: as many as the shuffle has partitions, so that their number grows with the cluster."""
    return max(16, min(1024, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def exact_quantiles(df: DataFrame, value, probabilities, by=(), names=None) -> DataFrame:
    """One row per group with one column per probability (linear interpolation, nulls skipped).

    Rows are first reduced to one per distinct value. These are cut into value ranges of
    about equal size, so ranks inside a range need only a short sort; the ranks before a range come
    from the range totals.
    """
    by = list(by)
    names = list(names or [f"q{p:g}" for p in probabilities])
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    n = _splits(df)
    steps = ", ".join(f"{i / n}D" for i in range(1, n))
    cut = F.expr(f"coalesce(percentile_approx(_v, array({steps}), 10000), CAST(array() AS ARRAY<DOUBLE>))")
    # Every group has edges of its own, so a group on another scale is cut as finely.
    if by:
        edges = counts.groupBy(*[F.col(c).alias(f"_edge_{c}") for c in by]).agg(cut.alias("_edges"))
        counts = counts.join(edges, F.expr(" AND ".join(f"`{c}` <=> `_edge_{c}`" for c in by))).drop(*[f"_edge_{c}" for c in by])
    else:
        counts = counts.withColumn("_edges", counts.agg(cut).scalar())
    # Position among the sorted edges: equal values share it, and larger values never come before. It is never null,
    # so the join below cannot push a null check on it down to the raw rows.
    place = F.array_position(F.sort_array(F.array_append("_edges", F.col("_v"))), F.col("_v"))
    ranged = counts.withColumn("_range", F.coalesce(place, F.lit(0))).drop("_edges")
    totals = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_m"))
    groups = Window.partitionBy(*by)
    upto = groups.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_before"),
        F.sum("_m").over(groups).alias("_total"),
    )
    match = " AND ".join(["_range = _r", *[f"`{c}` <=> `_by_{c}`" for c in by]])
    inside = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.withColumn("_cum", F.sum("_n").over(inside)).join(offsets, F.expr(match))
    picks = []
    for i, p in enumerate(probabilities):
        for side, rank in (("lo", f"floor({p!r}D * (_total - 1))"), ("hi", f"ceil({p!r}D * (_total - 1))")):
            here = f"_before + _cum - _n <= {rank} AND {rank} < _before + _cum"
            picks.append(F.expr(f"max(CASE WHEN {here} THEN _v END) AS _{side}{i}"))
    summary = ranked.groupBy(*by).agg(F.max("_total").alias("_total"), *picks)
    out = [
        F.expr(f"_lo{i} + (_hi{i} - _lo{i}) * ({p!r}D * (_total - 1) - floor({p!r}D * (_total - 1)))").alias(name)
        for i, (p, name) in enumerate(zip(probabilities, names))
    ]
    return summary.select(*by, *out)


def column_quantiles(df: DataFrame, columns, probabilities, names) -> DataFrame:
    """Quantiles of several columns at once: one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    return exact_quantiles(long, "value", probabilities, by=("column_name",), names=names)
