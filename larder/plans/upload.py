"""User uploads: header normalisation, defaults, and the whole forecast-to-replenishment job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from larder.functions.calendar import date_parts
from larder.functions.scalars import first_number, to_date, to_number
from larder.operators.inventory import horizon_demand, stock_decisions, stock_levels
from larder.operators.models import predict, rule_forecast
from larder.operators.windows import KEYS, series
from larder.plans.feature_store import ENCODED, day_flags, interactions, promo_lags, rolling_features, sales_lags
from larder.session import settle

# Accepted header names, in the order they are tried.
ALIASES = (
    ("sales", "unit_sales"), ("qty", "unit_sales"), ("demand", "unit_sales"),
    ("date_time", "date"), ("timestamp", "date"),
    ("item_id", "item_nbr"), ("sku", "item_nbr"), ("product_id", "item_nbr"),
    ("store_id", "store_nbr"), ("store", "store_nbr"),
    ("category", "family"), ("class", "family"),
    ("stock", "current_stock"),
)
# Words a header may contain.
HEADER_WORDS = (
    ("date", ("date",)), ("store_nbr", ("store",)), ("item_nbr", ("item", "sku")),
    ("family", ("family", "category")), ("unit_sales", ("sales", "demand")), ("current_stock", ("stock",)),
)
# What an upload without the column gets.
DEFAULTS = {"unit_sales": 10.0, "current_stock": 50.0, "onpromotion": 0.0, "store_nbr": 1, "item_nbr": 103520}
FIRST_DAY = "2017-08-01"
#: Columns of the history that an uploaded day takes over from the last day before it, where the history has them.
CARRIED = (
    "city", "state", "type", "cluster", "family", "class", "perishable", "dcoilwtico", *(f"{c}_freq" for c in ENCODED),
    "oil_roll_mean_7", "oil_roll_mean_30", "family_promo_ratio", "store_promo_ratio", "trans_roll_mean_7", "trans_roll_mean_28",
)


def tidy(header: str) -> str:
    return header.strip().lower().replace('"', "").replace("'", "")


def normalise_headers(df: DataFrame, aliases=ALIASES) -> DataFrame:
    """Trimmed lower-case headers; an alias is renamed only while its target is absent."""
    df = df.toDF(*[tidy(c) for c in df.columns])
    for old, new in aliases:
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def match_headers(df: DataFrame, words=HEADER_WORDS) -> DataFrame:
    """Targets from the first header that contains one of their words; one header may serve several targets."""
    headers = [tidy(c) for c in df.columns]
    df = df.toDF(*headers)
    source = {}
    for target, parts in words:
        hit = target if target in headers else next((h for h in headers if any(p in h for p in parts)), None)
        if hit is not None:
            source[target] = hit
    used = set(source.values())
    return df.select(*(F.col(h).alias(t) for t, h in source.items()), *(h for h in headers if h not in used and h not in source))


def number_days(df: DataFrame, order, first_day=FIRST_DAY, date="date") -> DataFrame:
    """Dates for a table that has none: every row gets its own day, repeatably for a unique ``order``.

    Rows are ranked inside hash buckets; the rows before a bucket come from the bucket counts.
    """
    buckets = 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    day = F.date_add(F.lit(first_day).cast("date"), (F.col("_before") + F.col("_place") - 1).cast("int"))
    return (
        keyed.withColumn("_place", place).join(offsets, "_bucket").withColumn(date, day).drop("_bucket", "_place", "_before")
    )


def fill_defaults(df: DataFrame, defaults=None) -> DataFrame:
    """Absent columns and unreadable values get defaults; ids are the first number in the text."""
    d = {**DEFAULTS, **(defaults or {})}
    out = {}
    for c in ("store_nbr", "item_nbr"):
        out[c] = first_number(F.col(c), d[c]) if c in df.columns else F.lit(d[c]).cast("bigint")
    for c in ("unit_sales", "current_stock", "onpromotion"):
        value = F.col(c).cast("string") if c in df.columns else None
        if value is not None and c == "onpromotion":
            flag = F.lower(F.trim(value))
            value = F.when(flag.isin("true", "t", "yes"), "1").when(flag.isin("false", "f", "no"), "0").otherwise(value)
        out[c] = to_number(value, d[c]) if value is not None else F.lit(float(d[c]))
    if "date" in df.columns:
        out["date"] = to_date(F.col("date"))
    if "family" not in df.columns:
        out["family"] = F.lit(None).cast("string")
    return df.withColumns(out)


def prepare_upload(df: DataFrame, defaults=None, date_order=None) -> DataFrame:
    """Normalised, typed upload rows."""
    df = normalise_headers(df)
    if "date" not in df.columns:
        df = number_days(df, date_order or df.columns)
    return fill_defaults(df, defaults)


def one_upload_per_day(rows: DataFrame, keys=KEYS) -> DataFrame:
    """Repeated records of a day combined: sales added, any promotion counts, first stock."""
    return rows.groupBy("date", *keys).agg(
        F.sum("unit_sales").alias("unit_sales"), F.max("onpromotion").alias("onpromotion"),
        F.min("current_stock").alias("current_stock"), F.max("family").alias("family"),
    )


def with_history(rows: DataFrame, history: DataFrame, days=60, keys=KEYS) -> DataFrame:
    """Prepared upload rows, one per day and SKU, with the features of their own series.

    Under the uploaded days of a SKU lie the last ``days`` calendar days of its ``history`` (the clean table or the feature store)
    before the upload begins; one window pass over both gives lags, rolling and smoothed values, and slowly changing
    columns are taken over as of the last day before. Only uploaded SKUs are read: the dates needed prune the history's
    files, and a tail is never longer than ``days`` rows, whatever share of the history a SKU holds. Statistics without a
    fixed length look back ``days``. A SKU without history, and a row without a readable date, gets nulls.
    """
    rows = settle(one_upload_per_day(rows, keys), "upload")
    dated = rows.where(F.col("date").isNotNull())
    begins = dated.groupBy(*keys).agg(F.min("date").alias("_begins"))
    span = begins.agg(F.min("_begins").alias("low"), F.max("_begins").alias("high")).first()
    carried = [c for c in CARRIED if c in history.columns]
    # An empty upload, or one without dates, asks for no history.
    near = history.where((F.col("date") >= F.date_sub(F.lit(span["low"]).cast("date"), days)) & (F.col("date") < F.lit(span["high"]).cast("date")))
    tail = near.select("date", *keys, "unit_sales", F.col("onpromotion").cast("double").alias("onpromotion"), *carried)
    tail = tail.join(begins, list(keys)).where((F.col("date") < F.col("_begins")) & (F.col("date") >= F.date_sub("_begins", days))).drop("_begins")
    both = tail.withColumn("_uploaded", F.lit(False)).unionByName(dated.withColumn("_uploaded", F.lit(True)), allowMissingColumns=True)
    upto = series(keys).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in carried})
    if "dcoilwtico" not in carried:
        both = both.withColumn("dcoilwtico", F.lit(None).cast("double"))
    found = interactions(rolling_features(promo_lags(sales_lags(both)))).where("_uploaded").drop("_uploaded")
    found = day_flags(found.withColumn("holiday_type", F.lit(None).cast("string"))).drop("holiday_type", "holiday_type_encoded")
    return found.unionByName(rows.where(F.col("date").isNull()), allowMissingColumns=True)


def model_forecast(model, features):
    """A ``forecast`` for ``run_upload`` that applies a fitted pipeline; features an upload cannot have count as 0."""
    return lambda rows: predict(model, rows, features, keep=("date", *KEYS, "current_stock", "family"))


def unreadable_dates(df: DataFrame) -> DataFrame:
    """Rows of an upload, and those whose date is written but cannot be read."""
    df = normalise_headers(df)
    lost = F.col("date").isNotNull() & to_date(F.col("date")).isNull() if "date" in df.columns else F.lit(False)
    return df.agg(F.count("*").alias("n_rows"), F.count_if(lost).alias("unreadable_dates"))


def run_upload(df: DataFrame, z=1.65, lead_days=7, review_days=7, forecast=rule_forecast, history=None, days=60) -> dict[str, DataFrame]:
    """Upload rows to KPIs, daily trajectory and one inventory row per SKU.

    ``forecast`` maps prepared rows to rows with ``forecast_sales``: the rule, or ``model_forecast`` of a fitted
    model. With ``history`` the rows carry the features of their own series (see ``with_history``). Rows without a
    readable date count in the demand of their SKU, but on no day of the trajectory; ``dates`` reports how many there are.
    """
    prepared = prepare_upload(df)
    rows = date_parts(prepared if history is None else with_history(prepared, history, days))
    # Dates are tried in several layouts: written once, not once per use.
    rows = settle(forecast(rows), "forecast")
    demand = horizon_demand(
        rows, "per_horizon",
        extra=(F.min_by("current_stock", F.struct("date", "current_stock")).alias("current_stock"), F.max("family").alias("family")),
    )
    inventory = stock_decisions(stock_levels(demand, z, lead_days, review_days))
    kpis = inventory.agg(
        F.sum("total_forecast_16d").alias("total_forecast_units"),
        F.sum("recommended_order_qty").alias("recommended_reorder_qty"),
        F.count(F.when(F.col("alert_status") == "CRITICAL_UNDERSTOCK", 1)).alias("critical_understock_skus"),
        F.count(F.when(F.col("alert_status") == "OPTIMAL_STOCK", 1)).alias("optimal_stock_skus"),
    )
    daily = rows.where(F.col("date").isNotNull()).groupBy("date").agg(F.sum("forecast_sales").alias("forecast"))
    return {"kpis": kpis, "trajectory": daily, "items": inventory, "dates": unreadable_dates(df)}
