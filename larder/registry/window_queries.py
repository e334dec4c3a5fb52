"""Series windows and the feature store."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import windows as W
from larder.operators.aggregates import daily_sales
from larder.operators.inventory import trajectory
from larder.operators.ranking import rank_by
from larder.plans.feature_store import STORE_COLUMNS, oil_features, promo_lags, sales_lags, transaction_features
from larder.registry.base import f32, query
from larder.registry.relational_queries import DAILY_FRAME_SQL, daily_frame

KEY = ("date", "store_nbr", "item_nbr")
PARTITION = "PARTITION BY store_nbr, item_nbr ORDER BY date"


def _sql(*columns, source="rolled"):
    return f"SELECT date, store_nbr, item_nbr, {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in columns)} FROM {source}"


def _out(df, *columns):
    return f32(df.select(*KEY, *columns), *columns)


LAGS = tuple(f"sales_lag_{n}" for n in (1, 2, 3, 7, 14, 21, 28))


@query("w01_sales_lags", _sql(*LAGS))
def lags(fx):
    return _out(sales_lags(fx.clean), *LAGS)


@query("w02_promo_lags", "SELECT date, store_nbr, item_nbr, promo_lag_1, promo_lag_7 FROM rolled")
def promo(fx):
    return promo_lags(fx.clean).select(*KEY, "promo_lag_1", "promo_lag_7")


MEANS = tuple(f"sales_roll_mean_{n}" for n in (7, 14, 28, 60))


@query("w03_rolling_mean", _sql(*MEANS))
def means(fx):
    return _out(W.rolling(fx.clean, "mean", (7, 14, 28, 60), prefix="sales_roll_mean"), *MEANS)


@query("w04_rolling_std", _sql("sales_roll_std_7", "sales_roll_std_28"))
def deviations(fx):
    return _out(W.rolling(fx.clean, "std", (7, 28), prefix="sales_roll_std"), "sales_roll_std_7", "sales_roll_std_28")


@query("w05_rolling_min_max", _sql("sales_roll_min_7", "sales_roll_max_7"))
def extremes(fx):
    out = W.rolling(fx.clean, "min", (7,), prefix="sales_roll_min")
    return _out(W.rolling(out, "max", (7,), prefix="sales_roll_max"), "sales_roll_min_7", "sales_roll_max_7")


@query("w06_rolling_median", _sql("sales_roll_median_14"))
def medians(fx):
    return _out(W.rolling(fx.clean, "median", (14,), prefix="sales_roll_median"), "sales_roll_median_14")


@query("w07_expanding", _sql("sales_expanding_mean", "sales_expanding_std"))
def expanding(fx):
    return _out(W.expanding(fx.clean, prefix="sales_expanding"), "sales_expanding_mean", "sales_expanding_std")


EWMAS = ("sales_ewma_7", "sales_ewma_14", "sales_ewma_28")


# A weight of 3/4 gives exact binary fractions, some just between two floats. Ten decimals first settle these alike in
# both engines; no float changes by it otherwise.
def stable_float(column):
    return f"CAST(ROUND({column}, 10) AS FLOAT) AS {column}"


def stable_floats(df, *columns):
    return df.withColumns({c: F.round(F.col(c), 10).cast("float") for c in columns})


@query("w08_ewma", f"SELECT date, store_nbr, item_nbr, {', '.join(stable_float(c) for c in EWMAS)} FROM rolled")
def ewma(fx):
    return stable_floats(W.ewma(fx.clean, prefix="sales_ewma").select(*KEY, *EWMAS), *EWMAS)


def _oil_query(name, *columns):
    @query(name, f"SELECT date, {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in columns)} FROM oil_feats")
    def run(fx):
        return f32(oil_features(fx.clean).select("date", *columns), *columns)


_oil_query("w09_oil_rolling_mean", "oil_roll_mean_7", "oil_roll_mean_30")
_oil_query("w10_oil_relative_change", "oil_pct_change_7d")
_oil_query("w11_oil_difference", "oil_diff_1d")


@query(
    "w12_transaction_rolling_mean",
    "SELECT store_nbr, date, CAST(trans_roll_mean_7 AS FLOAT) AS trans_roll_mean_7, CAST(trans_roll_mean_28 AS FLOAT) AS trans_roll_mean_28 FROM trans_feats",
)
def transactions(fx):
    return f32(transaction_features(fx.clean), "trans_roll_mean_7", "trans_roll_mean_28")


@query("w13_fill_both_ways", "SELECT date, CAST(dcoilwtico AS FLOAT) AS dcoilwtico FROM oil_days")
def fill(fx):
    return f32(fx.oil_days, "dcoilwtico")


@query(
    "w14_full_rolling_mean",
    """SELECT date, CASE WHEN row_number() OVER (ORDER BY date) >= 30 THEN
         CAST(AVG(total_sales) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS FLOAT) END AS total_sales_roll_mean_30 FROM daily""",
)
def full_mean(fx):
    out = W.trailing_mean(daily_sales(fx.train), "total_sales", (30,), full=True)
    return f32(out.select("date", "total_sales_roll_mean_30"), "total_sales_roll_mean_30")


@query(
    "w15_rolling_correlation",
    # A constant frame has no correlation: null here, NaN in the twin's engine.
    """SELECT date, CASE WHEN n >= 60 AND NOT isnan(c) THEN CAST(c AS FLOAT) END AS rolling_corr FROM (
         SELECT date, COUNT(dcoilwtico) OVER w AS n, corr(dcoilwtico, total_sales) OVER w AS c FROM ("""
    + DAILY_FRAME_SQL
    + ") WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))",
)
def rolling_corr(fx):
    return f32(W.rolling_correlation(daily_frame(fx), "dcoilwtico", "total_sales").select("date", "rolling_corr"), "rolling_corr")


@query(
    "w16_group_totals",
    """SELECT date, store_nbr, item_nbr, CAST(SUM(forecast_sales) OVER g AS FLOAT) AS forecast_sales_sum,
              CAST(STDDEV_SAMP(forecast_sales) OVER g AS FLOAT) AS forecast_sales_std FROM fc WINDOW g AS (PARTITION BY store_nbr, item_nbr)""",
)
def group_totals(fx):
    return _out(W.group_totals(fx.forecast, "forecast_sales"), "forecast_sales_sum", "forecast_sales_std")


FAMILY_DEMAND = "(SELECT family, SUM(unit_sales) AS demand FROM train JOIN items USING (item_nbr) GROUP BY 1)"


def family_demand(fx):
    per_item = fx.train.groupBy("item_nbr").agg(F.sum("unit_sales").alias("_d"))
    return per_item.join(fx.items, "item_nbr").groupBy("family").agg(F.sum("_d").alias("demand"))


@query(
    "w17_pareto",
    f"""SELECT family, demand, CAST(SUM(demand) OVER (ORDER BY demand DESC, family ROWS UNBOUNDED PRECEDING) * 100.0::DOUBLE / SUM(demand) OVER () AS FLOAT) AS cumulative_pct
        FROM {FAMILY_DEMAND}""",
)
def pareto(fx):
    return f32(W.pareto(family_demand(fx), "demand", "family"), "cumulative_pct")


@query(
    "w18_cumulative_forecast",
    """SELECT date, CAST(SUM(f) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS FLOAT) AS cumulative FROM (SELECT date, SUM(forecast_sales) AS f FROM fc GROUP BY 1)""",
)
def cumulative(fx):
    return f32(W.running_total(trajectory(fx.forecast), "forecast_sales").select("date", "cumulative"), "cumulative")


@query("w19_rank", f"SELECT family, demand, CAST(row_number() OVER (ORDER BY demand DESC, family) AS INT) AS rank FROM {FAMILY_DEMAND}")
def rank(fx):
    return rank_by(family_demand(fx), "demand", "family", descending=True)


SKU_DEMAND = "(SELECT store_nbr, item_nbr, store_nbr * 100000 + item_nbr AS sku, SUM(unit_sales) AS demand FROM train GROUP BY 1, 2)"


@query(
    "w17_sku_pareto",
    f"""SELECT store_nbr, item_nbr, CAST(row_number() OVER (ORDER BY demand DESC, sku) AS INT) AS rank,
        CAST(SUM(demand) OVER (ORDER BY demand DESC, sku ROWS UNBOUNDED PRECEDING) * 100.0::DOUBLE / SUM(demand) OVER () AS FLOAT) AS cumulative_pct FROM {SKU_DEMAND}""",
)
def sku_pareto(fx):
    """Rank and cumulative share of every SKU, in ranges of the order."""
    sku = (F.col("store_nbr") * 100000 + F.col("item_nbr")).alias("sku")
    demand = fx.train.groupBy("store_nbr", "item_nbr", sku).agg(F.sum("unit_sales").alias("demand"))
    out = W.pareto(rank_by(demand, "demand", "sku", descending=True), "demand", "sku")
    return f32(out.select("store_nbr", "item_nbr", "rank", "cumulative_pct"), "cumulative_pct")


@query(
    "w20_control_chart",
    """WITH l AS (SELECT AVG(total_sales) AS m, STDDEV_POP(total_sales) AS s FROM daily)
       SELECT date, total_sales, CAST(m AS FLOAT) AS series_mean, CAST(m + 2 * s AS FLOAT) AS upper_limit, CAST(m - 2 * s AS FLOAT) AS lower_limit,
              total_sales > m + 2 * s OR total_sales < m - 2 * s AS is_anomaly FROM daily, l""",
)
def control(fx):
    out = W.control_limits(daily_sales(fx.train).select("date", "total_sales"), "total_sales")
    return f32(out, "series_mean", "upper_limit", "lower_limit")


@query(
    "w21_scaling",
    f"""SELECT family, CAST(CASE WHEN MAX(demand) OVER () > MIN(demand) OVER () THEN (demand - MIN(demand) OVER ()) / (MAX(demand) OVER () - MIN(demand) OVER ()) * 100 ELSE 50 END AS FLOAT) AS demand_scaled,
        CAST(demand / GREATEST(MAX(demand) OVER (), 1) * 100 AS FLOAT) AS of_largest FROM {FAMILY_DEMAND}""",
)
def scaling(fx):
    out = W.max_scale(W.minmax_scale(family_demand(fx), ["demand"]), "demand", alias="of_largest")
    return f32(out.drop("demand"), "demand_scaled", "of_largest")


@query("w22_share", f"SELECT family, CAST(demand * 100.0::DOUBLE / SUM(demand) OVER () AS FLOAT) AS share_pct FROM {FAMILY_DEMAND}")
def share(fx):
    return f32(W.share_of_total(family_demand(fx), "demand").drop("demand"), "share_pct")


_INT = {
    "store_nbr", "item_nbr", "is_return", "cluster", "class", "perishable", "transactions", "is_holiday", "year", "month", "day",
    "day_of_week", "week_of_year", "quarter", "day_of_year", "is_weekend", "promo_lag_1", "promo_lag_7", "is_payday", "is_earthquake_period",
}
_TEXT = {"date", "onpromotion", "city", "state", "type", "family", "holiday_type", "holiday_type_encoded"}
STORE_FLOATS = tuple(c for c in STORE_COLUMNS if c not in _INT and c not in _TEXT)


@query(
    "feature_store",
    "SELECT "
    + ", ".join(stable_float(c) if c in EWMAS else f"CAST({c} AS FLOAT) AS {c}" if c in STORE_FLOATS else c for c in STORE_COLUMNS)
    + " FROM fstore",
)
def feature_store(fx):
    return stable_floats(f32(fx.features, *(c for c in STORE_FLOATS if c not in EWMAS)), *EWMAS)
