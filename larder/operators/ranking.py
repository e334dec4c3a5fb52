"""Sorts, limits, top-k, samples and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from larder.operators.ordered import in_order


def _ordering(columns, descending):
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in columns]


def top_rows(df: DataFrame, measure, n, ties=(), descending=True) -> DataFrame:
    """Top (or bottom) ``n`` by a measure; each task keeps ``n`` rows, no global sort."""
    return df.orderBy(*_ordering([measure], descending), *[F.col(c) for c in ties]).limit(n)


def preview(df: DataFrame, n, order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def newest_rows(df: DataFrame, n, order=("date", "store_nbr", "item_nbr"), newest=True) -> DataFrame:
    """Exactly ``n`` rows, newest (or oldest) first column first, later columns break ties ascending.

    ``n`` may be large: instead of sorting rows, rows are counted per value of each order
    column in turn to find the boundary, so that the result stays distributed. Nulls come last.
    The last order column must be unique within the others.
    """
    keep, at_edge = F.lit(False), F.lit(True)
    left = F.lit(n)
    for position, column in enumerate(order):
        descending = newest and position == 0
        per_value = df.where(at_edge).groupBy(column).agg(F.count("*").alias("_rows"))
        running = Window.orderBy(*_ordering([column], descending)).rowsBetween(Window.unboundedPreceding, 0)
        counted = per_value.withColumn("_upto", F.sum("_rows").over(running))
        # The first value that does not fit whole is the edge; nulls come last and can be the edge too.
        over = counted.where(F.col("_upto") > left)
        edge = over.agg((F.max if descending else F.min)(column)).scalar()
        some_over = over.agg(F.count("*") > 0).scalar()
        taken = counted.where(F.col("_upto") <= left).agg(F.coalesce(F.sum("_rows"), F.lit(0))).scalar()
        before_edge = F.col(column) > edge if descending else F.col(column) < edge
        whole = ~some_over | F.when(edge.isNull(), F.col(column).isNotNull()).otherwise(F.coalesce(before_edge, F.lit(False)))
        keep = keep | (at_edge & whole)
        at_edge = at_edge & some_over & F.col(column).eqNullSafe(edge)
        left = left - taken
    return df.where(keep)


#: A sample up to this size is taken as a top-n, with that many rows per task.
SMALL_SAMPLE = 10_000
_DIGITS = 4


def sample_rows(df: DataFrame, n, key, seed=42, small=SMALL_SAMPLE) -> DataFrame:
    """Repeatable random sample of ``n`` rows: those with the smallest hash of seed and key.

    A large sample is a filter: hashes are counted by their first digits (at most 16^4 rows per pass), whole ranges below the
    boundary are taken, and only the boundary range is refined by its next digits until it is small enough to sort.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    rows = df.withColumn("_digest", digest)
    taken, edge, left, place = F.lit(False), F.lit(True), n, 0
    while left > small and place < 32:
        digits = F.substring("_digest", place + 1, _DIGITS)
        counts = rows.where(edge).groupBy(digits.alias("d")).agg(F.count("*").alias("rows")).collect()  # at most 16^4 rows
        boundary, before = None, 0
        for row in sorted(counts):
            if before + row["rows"] > left:
                boundary = row["d"]
                break
            before += row["rows"]
        if boundary is None:  # everything that is left fits
            return rows.where(taken | edge).drop("_digest")
        taken, edge = taken | (edge & (digits < boundary)), edge & (digits == boundary)
        left, place = left - before, place + _DIGITS
    rest = rows.where(edge).orderBy("_digest", *key).limit(left)
    return (rest if place == 0 else rows.where(taken).unionByName(rest)).drop("_digest")


def rank_by(df: DataFrame, measure, name, by=(), descending=False, alias="rank", bounded=False) -> DataFrame:
    """Position by a measure, ties by name; ``bounded`` for whole tables of a fixed small size, such as leaderboards."""
    order = [*_ordering([measure], descending), F.col(name)]
    if by or bounded:
        return df.withColumn(alias, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return in_order(df, order, position=alias).withColumn(alias, F.col(alias).cast("int"))


def concat_frames(frames) -> DataFrame:
    """All rows of all frames; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged_union(frames: dict[str, DataFrame], tag="label") -> DataFrame:
    return concat_frames([df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def distinct_keys(df: DataFrame, *columns) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)
