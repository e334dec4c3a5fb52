"""The 74-column feature store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from larder.functions.calendar import EVENT_WINDOW, date_parts, in_event_window, is_payday
from larder.functions.scalars import sales_per_transaction
from larder.operators import windows as W
from larder.operators.aggregates import constant_per_key, frequency_encoding
from larder.session import settle

# Lag and window sizes, encoded columns and the ratio offset of the store.
LAGS = (1, 2, 3, 7, 14, 21, 28)
PROMO_LAGS = (1, 7)
ENCODED = ("family", "city", "state", "type", "cluster", "class")
EPSILON = 1e-4


def sales_lags(df: DataFrame) -> DataFrame:
    return W.lags(df, "unit_sales", LAGS, prefix="sales_lag")


def promo_lags(df: DataFrame) -> DataFrame:
    return W.lags(df, "onpromotion", PROMO_LAGS, prefix="promo_lag")


def day_flags(df: DataFrame, event_window=EVENT_WINDOW) -> DataFrame:
    return df.withColumns(
        {
            "is_payday": is_payday(F.col("date")),
            "is_earthquake_period": in_event_window(F.col("date"), event_window),
            "holiday_type_encoded": F.col("holiday_type"),
        }
    )


def rolling_features(df: DataFrame) -> DataFrame:
    """Fourteen statistics of earlier sales; one exchange serves all of them."""
    out = W.rolling(df, "mean", (7, 14, 28, 60), prefix="sales_roll_mean")
    out = W.rolling(out, "std", (7, 28), prefix="sales_roll_std")
    out = W.rolling(out, "min", (7,), prefix="sales_roll_min")
    out = W.rolling(out, "max", (7,), prefix="sales_roll_max")
    out = W.rolling(out, "median", (14,), prefix="sales_roll_median")
    out = W.expanding(out, prefix="sales_expanding")
    return W.ewma(out, (7, 14, 28), prefix="sales_ewma")


def interactions(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "sales_to_roll7_ratio": F.col("sales_lag_1") / (F.col("sales_roll_mean_7") + EPSILON),
            "sales_to_roll28_ratio": F.col("sales_lag_1") / (F.col("sales_roll_mean_28") + EPSILON),
            "promo_sales_interaction": F.col("onpromotion").cast("double") * F.col("sales_roll_mean_7"),
            "oil_sales_interaction": F.col("dcoilwtico") * F.col("sales_roll_mean_28"),
        }
    )


def oil_features(clean: DataFrame) -> DataFrame:
    """Per date: rolling means with the current day, 7-row change, 1-row difference."""
    daily = constant_per_key(clean, ("date",), "dcoilwtico")
    out = W.trailing_mean(daily, "dcoilwtico", (7, 30), prefix="oil_roll_mean")
    out = W.change(out, "dcoilwtico", 7, relative=True, alias="oil_pct_change_7d")
    out = W.change(out, "dcoilwtico", 1, alias="oil_diff_1d")
    return out.drop("dcoilwtico")


def _trailing_transactions(daily: DataFrame) -> DataFrame:
    out = W.trailing_mean(
        daily, "transactions", (7, 28), keys=("store_nbr",), current=False, prefix="trans_roll_mean"
    )
    return out.drop("transactions")


def transaction_features(clean: DataFrame) -> DataFrame:
    """Per store and date: rolling means of earlier rows."""
    return _trailing_transactions(constant_per_key(clean, ("store_nbr", "date"), "transactions"))


def day_groups(clean: DataFrame) -> DataFrame:
    """One pass over the fact rows: what the oil, promotion, transaction and frequency columns need."""
    return clean.groupBy("date", "store_nbr", *ENCODED).agg(
        F.count("*").alias("n_rows"),
        F.sum(F.col("onpromotion").cast("bigint")).alias("n_promo"),
        F.max("dcoilwtico").alias("dcoilwtico"),
        F.max("transactions").alias("transactions"),
    )


def _promo_share(alias):
    return (F.sum("n_promo").cast("double") / F.sum("n_rows")).alias(alias)


def family_day_features(groups: DataFrame) -> DataFrame:
    return groups.groupBy("date", "family").agg(_promo_share("family_promo_ratio"))


def store_day_features(groups: DataFrame) -> DataFrame:
    """Promotion share and trailing transactions per store and date, as one table for one join."""
    daily = groups.groupBy("store_nbr", "date").agg(
        _promo_share("store_promo_ratio"), F.max("transactions").alias("transactions")
    )
    return _trailing_transactions(daily)


def add_dimension_features(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Oil, promotion, transaction and frequency columns, joined from small aggregates of ``day_groups``."""
    out = (
        df.join(oil_features(groups), "date", "left")
        .join(family_day_features(groups), ["date", "family"], "left")
        .join(store_day_features(groups), ["date", "store_nbr"], "left")
    )
    for column in ENCODED:
        out = out.join(frequency_encoding(groups, column, weight="n_rows"), column, "left")
    zero = ("oil_pct_change_7d", "oil_diff_1d", "family_promo_ratio", "store_promo_ratio", "trans_roll_mean_7", "trans_roll_mean_28")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero})
    return out.withColumn("sales_per_transaction", sales_per_transaction(F.col("unit_sales"), F.col("transactions")))


def drop_warmup(df: DataFrame, source: DataFrame, days=90) -> DataFrame:
    first = source.agg(F.min("date")).scalar()
    return df.where(F.col("date") >= F.date_add(first, days))


def zero_nulls(df: DataFrame) -> DataFrame:
    """0 for null in every float or double column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.fillna(0.0, subset=floats) if floats else df


# The columns of the store, in their order.
STORE_COLUMNS = (
    "date", "store_nbr", "item_nbr", "unit_sales", "onpromotion", "is_return", "city", "state", "type", "cluster",
    "family", "class", "perishable", "dcoilwtico", "transactions", "is_holiday", "holiday_type",
    "year", "month", "day", "day_of_week", "week_of_year", "quarter", "day_of_year", "is_weekend",
    "sin_month", "cos_month", "sin_dow", "cos_dow",
    *(f"sales_lag_{n}" for n in LAGS), *(f"promo_lag_{n}" for n in PROMO_LAGS),
    "is_payday", "is_earthquake_period", "holiday_type_encoded",
    "oil_roll_mean_7", "oil_roll_mean_30", "oil_pct_change_7d", "oil_diff_1d",
    "family_promo_ratio", "store_promo_ratio", "trans_roll_mean_7", "trans_roll_mean_28", "sales_per_transaction",
    *(f"{c}_freq" for c in ENCODED),
    "sales_roll_mean_7", "sales_roll_mean_14", "sales_roll_mean_28", "sales_roll_mean_60",
    "sales_roll_std_7", "sales_roll_std_28", "sales_roll_min_7", "sales_roll_max_7", "sales_roll_median_14",
    "sales_expanding_mean", "sales_expanding_std", "sales_ewma_7", "sales_ewma_14", "sales_ewma_28",
    "sales_to_roll7_ratio", "sales_to_roll28_ratio", "promo_sales_interaction", "oil_sales_interaction",
)


def build_features(clean: DataFrame, event_window=EVENT_WINDOW, warmup_days=90) -> DataFrame:
    """Series windows come first, so that the joins that follow are planned with the
    measured sizes of the small sides and add no further shuffle of the fact rows.

    ``clean`` is read twice: pass a written table, not a long lazy plan. The grouped pass is
    written once, so that its ten uses neither repeat it nor guess its size.
    """
    groups = settle(day_groups(clean), "day_groups")
    out = date_parts(clean)
    out = day_flags(out, event_window)
    out = promo_lags(sales_lags(out))
    out = interactions(rolling_features(out))
    out = drop_warmup(out, groups, warmup_days)
    out = add_dimension_features(out, groups)
    return zero_nulls(out).select(*STORE_COLUMNS)
