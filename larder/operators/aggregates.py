"""Group-by reports on sales, holidays, promotions and prices. Facts are aggregated before they are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from larder.functions.calendar import weekday_name
from larder.functions.scalars import pearson, percent, ratio, text_to_boolean
from larder.operators.quantiles import exact_quantiles


def aggregate(df: DataFrame, by, measures: dict[str, str | list[str]], path=None) -> DataFrame:
    """``{"unit_sales": ["SUM", "AVG"]}`` gives ``unit_sales_sum`` and ``unit_sales_avg``."""
    out = []
    for column, names in measures.items():
        for name in [names] if isinstance(names, str) else names:
            out.append(F.expr(f"{name}(`{column}`)").alias(f"{column}_{name.lower()}"))
    result = df.groupBy(*([by] if isinstance(by, str) else by)).agg(*out)
    if path is None:
        return result
    result.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def daily_sales(sales: DataFrame) -> DataFrame:
    return sales.groupBy("date").agg(
        F.avg("unit_sales").alias("avg_sales"), F.sum("unit_sales").alias("total_sales"), F.count("*").alias("n_rows")
    )


def daily_trend(clean: DataFrame) -> DataFrame:
    return clean.groupBy("date").agg(
        F.avg("unit_sales").alias("avg_sales"),
        F.sum("is_return").cast("bigint").alias("returns"),
        F.avg(F.col("onpromotion").cast("double")).alias("promo_rate"),
    )


def outlier_audit(sales: DataFrame) -> DataFrame:
    """Totals, extremes and quantiles of sales, and the rows above the 99.9 % quantile."""
    quantiles = exact_quantiles(
        sales, "unit_sales", (0.5, 0.99, 0.999), names=("median_sales", "q99_sales", "q999_sales")
    )
    cap = quantiles.select("q999_sales").scalar()
    value = F.col("unit_sales")
    totals = sales.withColumn("_cap", cap).agg(
        F.count("*").alias("total_rows"),
        F.count(F.when(value < 0, 1)).alias("negative_sales"),
        F.min(value).alias("min_sales"),
        F.max(value).alias("max_sales"),
        F.avg(value).alias("mean_sales"),
        F.count(F.when(value > F.col("_cap"), 1)).alias("outliers_above_q999"),
    )
    return totals.withColumns({c: quantiles.select(c).scalar() for c in quantiles.columns})


def target_classes(sales: DataFrame) -> DataFrame:
    """Positive, zero and returned rows with shares."""
    value = F.col("unit_sales")
    row = sales.agg(
        F.count(F.when(value > 0, 1)).alias("positive"),
        F.count(F.when(value == 0, 1)).alias("zero"),
        F.count(F.when(value < 0, 1)).alias("returns"),
        F.count("*").alias("_rows"),
    )
    return row.unpivot("_rows", ["positive", "zero", "returns"], "sales_class", "n_rows").select(
        "sales_class", "n_rows", percent(F.col("n_rows"), F.col("_rows")).alias("share_pct")
    )


def value_counts(df: DataFrame, column) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def monthly_mean(daily: DataFrame, value, date="date") -> DataFrame:
    """Mean per calendar month; months without rows are null."""
    per_month = daily.groupBy(F.trunc(date, "month").alias("month")).agg(F.avg(value).alias(value))
    months = (
        daily.agg(F.trunc(F.min(date), "month").alias("_first"), F.trunc(F.max(date), "month").alias("_last"))
        .where(F.col("_first").isNotNull())
        .select(F.explode(F.expr("sequence(_first, _last, interval 1 month)")).alias("month"))
    )
    return months.join(per_month, "month", "left")


def by_weekday(daily: DataFrame, value="total_sales") -> DataFrame:
    return daily.groupBy(
        (F.dayofweek("date") - 1).alias("day_of_week"), weekday_name(F.col("date")).alias("weekday")
    ).agg(F.avg(value).alias("mean_sales"))


def by_month(daily: DataFrame, value="total_sales") -> DataFrame:
    return daily.groupBy(F.month("date").alias("month")).agg(F.avg(value).alias("mean_sales"))


def by_year(daily: DataFrame, value="total_sales") -> DataFrame:
    return daily.groupBy(F.year("date").alias("year")).agg(F.sum(value).alias("total_sales"))


def yearly_growth(daily: DataFrame, value="total_sales") -> DataFrame:
    before = F.lag("total_sales").over(Window.orderBy("year"))
    return by_year(daily, value).withColumn("growth_pct", percent(F.col("total_sales") - before, before))


def percentile_ladder(df: DataFrame, value, points=(1, 5, 10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    names = [f"p{p}" for p in points]
    wide = exact_quantiles(df, value, [p / 100 for p in points], names=names)
    return wide.unpivot([], names, "percentile", "value")


def sales_by_attribute(sales: DataFrame, dimension: DataFrame, key, attributes) -> DataFrame:
    """Totals per key first, then the attributes of the key."""
    per_key = sales.groupBy(key).agg(F.sum("unit_sales").alias("_total"))
    return per_key.join(dimension, key).groupBy(*attributes).agg(F.sum("_total").alias("total_sales"))


def family_months(sales: DataFrame, items: DataFrame, top=5) -> DataFrame:
    """Monthly totals of the families with the largest totals."""
    per_item = sales.groupBy("item_nbr", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.sum("unit_sales").alias("_total")
    )
    per_family = per_item.join(items, "item_nbr").groupBy("family", "month").agg(F.sum("_total").alias("total_sales"))
    best = (
        per_family.groupBy("family")
        .agg(F.sum("total_sales").alias("_sum"))
        .orderBy(F.desc("_sum"), "family")
        .limit(top)
        .select("family")
    )
    return per_family.join(best, "family", "left_semi")


def promotion_lift(sales: DataFrame) -> DataFrame:
    promo = text_to_boolean(F.col("onpromotion"))
    row = sales.agg(
        F.avg(F.when(promo, F.col("unit_sales"))).alias("promo_avg"),
        F.avg(F.when(~promo, F.col("unit_sales"))).alias("regular_avg"),
    )
    return row.withColumn("lift_pct", percent(F.col("promo_avg") - F.col("regular_avg"), F.col("regular_avg")))


def promotion_rate_by_month(sales: DataFrame) -> DataFrame:
    """Daily percentage of promoted rows, then the mean per month."""
    daily = sales.groupBy("date").agg(
        (F.avg(text_to_boolean(F.col("onpromotion")).cast("double")) * 100).alias("promo_rate")
    )
    return monthly_mean(daily, "promo_rate")


def family_lift(sales: DataFrame, items: DataFrame) -> DataFrame:
    """Lift of the mean item mean per family; an absent side counts as 0, the base is at least 1e-5."""
    per_item = sales.groupBy("item_nbr", text_to_boolean(F.col("onpromotion")).alias("promo")).agg(
        F.avg("unit_sales").alias("mean_sales")
    )
    wide = (
        per_item.join(items.select("item_nbr", "family"), "item_nbr")
        .groupBy("family")
        .agg(
            F.coalesce(F.avg(F.when(~F.col("promo"), F.col("mean_sales"))), F.lit(0.0)).alias("regular_avg"),
            F.coalesce(F.avg(F.when(F.col("promo"), F.col("mean_sales"))), F.lit(0.0)).alias("promo_avg"),
        )
    )
    base = F.greatest(F.col("regular_avg"), F.lit(1e-5))
    return wide.withColumn("lift_pct", F.round((F.col("promo_avg") - F.col("regular_avg")) / base * 100, 1))


def correlation(df: DataFrame, a, b, alias="correlation") -> DataFrame:
    return df.agg(F.expr(pearson(a, b)).alias(alias))


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """All pairs of a short column list in one aggregate, in long form."""
    columns = list(columns)
    row = df.agg(
        *[F.expr(pearson(a, b)).alias(f"{a}|{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]],
        F.lit(1.0).alias("_one"),
    )
    cells = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            low, high = (a, b) if i < j else (b, a)
            value = F.col("_one") if i == j else F.col(f"`{low}|{high}`")
            cells.append(F.struct(F.lit(a).alias("row_name"), F.lit(b).alias("column_name"), value.alias("correlation")))
    return row.select(F.inline(F.array(*cells)))


def rank_by_correlation(df: DataFrame, target, features) -> DataFrame:
    """Features by absolute correlation with the target."""
    row = df.agg(*[F.expr(pearson(c, target)).alias(c) for c in features])
    return row.unpivot([], list(features), "feature", "correlation").withColumn(
        "abs_correlation", F.abs("correlation")
    ).orderBy(F.desc_nulls_last("abs_correlation"), "feature")


def with_events(daily: DataFrame, holidays: DataFrame) -> DataFrame:
    """Every event of a day on its own row: days with two events appear twice."""
    return daily.join(holidays.select("date", "type", "transferred"), "date", "left").withColumn(
        "is_holiday", F.col("type").isNotNull()
    )


def holiday_effect(daily: DataFrame, holidays: DataFrame, by="is_holiday", value="total_sales") -> DataFrame:
    """Mean daily sales by holiday flag, by type or by transferred flag."""
    events = with_events(daily, holidays)
    if by != "is_holiday":
        events = events.where("is_holiday")
    return events.groupBy(by).agg(F.avg(value).alias("mean_sales"))


def holidays_per_year(holiday_days: DataFrame) -> DataFrame:
    return holiday_days.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n_holidays"))


def daily_transactions(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("date").agg(F.sum("transactions").alias("transactions"))


def transactions_by_type(transactions: DataFrame, stores: DataFrame) -> DataFrame:
    per_store = transactions.groupBy("store_nbr").agg(
        F.sum("transactions").alias("_sum"), F.count("transactions").alias("_n")
    )
    return per_store.join(stores, "store_nbr").groupBy("type").agg(
        ratio(F.sum("_sum").cast("double"), F.sum("_n")).alias("mean_transactions")
    )


def constant_per_key(df: DataFrame, by, value, alias=None) -> DataFrame:
    """The value of a column that is constant per key."""
    return df.groupBy(*by).agg(F.max(value).alias(alias or value))


def promo_ratio(clean: DataFrame, by, alias) -> DataFrame:
    return clean.groupBy(*by).agg(F.avg(F.col("onpromotion").cast("double")).alias(alias))


def frequency_encoding(df: DataFrame, column, alias=None, weight=None) -> DataFrame:
    """Share of rows per value; ``weight`` names a row count when ``df`` is already grouped."""
    counts = df.groupBy(column).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    # A grouped input has one total for all its columns, which Spark computes once.
    total = (df.agg(F.sum(weight)) if weight else counts.agg(F.sum("_n"))).scalar()
    return counts.select(column, (F.col("_n") / total).alias(alias or f"{column}_freq"))


def split_report(df: DataFrame, cutoff) -> DataFrame:
    """Rows, date span and share before and from a cutoff date."""
    edge = cutoff if not isinstance(cutoff, str) else F.lit(cutoff).cast("date")
    parts = (
        df.withColumn("part", F.when(F.col("date") < edge, "train").otherwise("validation"))
        .groupBy("part")
        .agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    )
    total = F.sum("n_rows").over(Window.partitionBy())
    return parts.withColumn("share_pct", percent(F.col("n_rows"), total))


def half_year_rows(df: DataFrame) -> DataFrame:
    """Rows per half-year window."""
    half = F.when(F.month("date") <= 6, "H1").otherwise("H2")
    return df.groupBy(F.concat_ws("-", F.year("date").cast("string"), half).alias("half_year")).agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def hierarchy_totals(sales: DataFrame, by=("type", "family"), value="unit_sales") -> DataFrame:
    """Totals per pair, per first level and overall."""
    return sales.rollup(*by).agg(F.sum(value).alias("total"))


def histogram(df: DataFrame, value, low, high, bins) -> DataFrame:
    """Rows per equal-width bin; bins 0 and ``bins + 1`` hold what lies outside."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin"))
        .agg(F.count("*").alias("n_rows"))
    )


