"""Registry, test tables and shared SQL of the oracle."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.operators.evaluation import horizon_start
from larder.operators.inventory import horizon_demand, stock_decisions, stock_levels
from larder.plans.clean import build_clean, complete_prices, holiday_days
from larder.plans.feature_store import build_features
from larder.plans.forecast import forecast
from larder.session import settle
from larder.sources import adapters

QUERIES: dict[str, callable] = {}
ORACLES: dict[str, str] = {}

EVENT_WINDOW = ("1998-04-16", "1998-05-16")
HORIZON = 16


class Fixture:
    """Retail tables of one data folder, each built when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name) -> DataFrame:
        return adapters.table(self.spark, self.folder, name)

    def path(self, name) -> str:
        return f"{self.folder}/{name}.parquet"

    @cached_property
    def tables(self):
        names = ("train", "stores", "items", "oil", "transactions")
        return {**{name: getattr(self, name) for name in names}, "holidays_events": self.holidays}

    @cached_property
    def train(self):
        return adapters.train(self.spark, self.folder)

    @cached_property
    def stores(self):
        return adapters.stores(self.spark, self.folder)

    @cached_property
    def items(self):
        return adapters.items(self.spark, self.folder)

    @cached_property
    def oil(self):
        return adapters.oil(self.spark, self.folder)

    @cached_property
    def transactions(self):
        return adapters.transactions(self.spark, self.folder)

    @cached_property
    def holidays(self):
        return adapters.holidays(self.spark, self.folder)

    @cached_property
    def oil_days(self):
        return complete_prices(self.oil, self.train)

    @cached_property
    def holiday_days(self):
        return holiday_days(self.holidays)

    @cached_property
    def written_train(self):
        """The sales table as it is in a warehouse: written once, read by each of the passes of the clean build."""
        return settle(self.train, "train")

    @cached_property
    def clean(self):
        return build_clean({**self.tables, "train": self.written_train})

    @cached_property
    def written_clean(self):
        return settle(self.clean, "clean")

    @cached_property
    def features(self):
        return build_features(self.written_clean, EVENT_WINDOW)

    @cached_property
    def start(self):
        """First date of the forecast horizon."""
        return horizon_start(self.written_train, HORIZON)

    @cached_property
    def forecast(self):
        return forecast(self.clean, start=self.start)

    @cached_property
    def levels(self):
        demand = horizon_demand(
            self.forecast, extra=(F.sum("actual_sales").alias("actual_sales_16d"), F.max("family").alias("family"))
        )
        return adapters.with_stock(stock_levels(demand))

    @cached_property
    def inventory(self):
        return stock_decisions(self.levels)


def query(name: str, sql: str | None = None):
    """Register ``function(fixture)`` under ``name``, with its SQL twin if SQL can say it."""

    def add(function):
        QUERIES[name] = lambda spark, folder: function(Fixture(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return function

    return add


def f32(df: DataFrame, *columns) -> DataFrame:
    """Inexact results in the storage type (float), where both engines agree on every bit."""
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


SHARED_SQL = {
    "stores": """
        SELECT n_nationkey + 1 AS store_nbr, n_name AS city, r_name AS state,
               CASE n_nationkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END AS type,
               n_nationkey % 17 + 1 AS cluster
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "items": """
        SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS item_nbr,
               concat('FAMILY_', CAST(CAST(substr(p_brand, 7) AS INT) % 6 AS VARCHAR)) AS family,
               CAST(substr(p_brand, 7) AS INT) % 10 AS class,
               CASE WHEN CAST(substr(p_brand, 7) AS INT) % 3 = 0 THEN 1 ELSE 0 END AS perishable
        FROM part""",
    "train": """
        SELECT CAST(l_shipdate AS DATE) AS date, s_nationkey + 1 AS store_nbr,
               CAST(substr(p_brand, 7) AS INT) AS item_nbr,
               SUM(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -l_quantity ELSE l_quantity END) AS unit_sales,
               CASE WHEN MAX(l_discount) >= 0.08 THEN 'True' WHEN MAX(l_discount) <= 0.01 THEN NULL ELSE 'False' END AS onpromotion
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        GROUP BY 1, 2, 3""",
    "oil": """
        SELECT CAST(o_orderdate AS DATE) AS date,
               CASE WHEN extract(day FROM o_orderdate) = 11 THEN NULL
                    ELSE CAST(SUM(CAST(o_totalprice * 100 AS DECIMAL(18,0))) AS DOUBLE) / 100 / COUNT(*) / 5000 END AS dcoilwtico
        FROM orders WHERE extract(dow FROM o_orderdate) IN (1,2,3,4,5) GROUP BY o_orderdate""",
    "transactions": """
        SELECT CAST(l_shipdate AS DATE) AS date, s_nationkey + 1 AS store_nbr, COUNT(DISTINCT l_orderkey) AS transactions
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> 7 GROUP BY 1, 2""",
    "holidays": """
        SELECT DISTINCT CAST(o_orderdate AS DATE) AS date,
               CASE extract(day FROM o_orderdate) WHEN 1 THEN 'Holiday' WHEN 12 THEN 'Transfer' WHEN 24 THEN 'Event' ELSE 'Bridge' END AS type,
               extract(day FROM o_orderdate) = 1 AND extract(month FROM o_orderdate) % 4 = 0 AS transferred
        FROM orders WHERE extract(day FROM o_orderdate) IN (1, 12, 24, 26)""",
    "spine": """
        SELECT CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM train""",
    "oil_days": """
        SELECT date, COALESCE(
                 last_value(dcoilwtico IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 first_value(dcoilwtico IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS dcoilwtico
        FROM spine LEFT JOIN oil USING (date)""",
    "holiday_days": """
        SELECT date, 1 AS is_holiday, MIN(type) AS holiday_type FROM holidays
        WHERE NOT (transferred AND type <> 'Transfer') GROUP BY date""",
    "cap": "SELECT quantile_cont(unit_sales, 0.999) AS q FROM train",
    "clean": """
        SELECT t.date, t.store_nbr, t.item_nbr,
               LEAST(GREATEST(t.unit_sales, 0), (SELECT q FROM cap)) AS unit_sales,
               COALESCE(TRY_CAST(t.onpromotion AS BOOLEAN), FALSE) AS onpromotion,
               CASE WHEN t.unit_sales < 0 THEN 1 ELSE 0 END AS is_return,
               s.city, s.state, s.type, s.cluster, i.family, i.class, i.perishable, o.dcoilwtico,
               COALESCE(x.transactions, 0) AS transactions,
               COALESCE(h.is_holiday, 0) AS is_holiday, COALESCE(h.holiday_type, 'Regular') AS holiday_type
        FROM train t LEFT JOIN stores s USING (store_nbr) LEFT JOIN items i USING (item_nbr)
        LEFT JOIN oil_days o ON o.date = t.date
        LEFT JOIN transactions x ON x.date = t.date AND x.store_nbr = t.store_nbr
        LEFT JOIN holiday_days h ON h.date = t.date""",
    "daily": """
        SELECT date, AVG(unit_sales) AS avg_sales, SUM(unit_sales) AS total_sales, COUNT(*) AS n_rows
        FROM train GROUP BY date""",
    "horizon": "SELECT MIN(date) AS start FROM (SELECT DISTINCT date FROM train ORDER BY date DESC LIMIT 16)",
    "fc": """
        SELECT *, ROUND(unit_sales * (1 + CAST(CAST(onpromotion AS INT) AS DOUBLE) * 0.35::DOUBLE), 2) AS forecast_sales,
               unit_sales AS actual_sales
        FROM clean WHERE date >= (SELECT start FROM horizon)""",
    "demand": """
        SELECT store_nbr, item_nbr, CAST(SUM(CAST(ROUND(forecast_sales * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS total_forecast_16d,
               CAST(SUM(CAST(ROUND(forecast_sales * 10000) AS BIGINT)) AS DOUBLE) / 10000 / COUNT(*) AS daily_avg_demand,
               COALESCE(STDDEV_SAMP(forecast_sales), 0) AS demand_std, SUM(actual_sales) AS actual_sales_16d,
               MAX(family) AS family
        FROM fc GROUP BY store_nbr, item_nbr""",
    "ss": "SELECT *, CAST(CEIL(1.65::DOUBLE * demand_std * SQRT(7)) AS BIGINT) AS safety_stock FROM demand",
    "rop": "SELECT *, CAST(CEIL(daily_avg_demand * 7 + safety_stock) AS BIGINT) AS reorder_point FROM ss",
    "levels": """
        SELECT *, CAST(CEIL(reorder_point + daily_avg_demand * 7) AS BIGINT) AS target_stock_level,
               CAST(FLOOR(reorder_point * ((store_nbr * 31 + item_nbr * 17) % 301) / 100) AS BIGINT) AS current_stock
        FROM rop""",
    "inv": """
        SELECT *, CASE WHEN alert_status = 'CRITICAL_UNDERSTOCK'
                       THEN CAST(reorder_point - current_stock AS DOUBLE) / GREATEST(1, reorder_point) ELSE 0 END AS reorder_priority_score
        FROM (SELECT *, GREATEST(0, target_stock_level - current_stock) AS recommended_order_qty,
                     CASE WHEN current_stock < reorder_point THEN 'CRITICAL_UNDERSTOCK'
                          WHEN current_stock > target_stock_level THEN 'OVERSTOCK' ELSE 'OPTIMAL_STOCK' END AS alert_status
              FROM levels)""",
    "dated": """
        SELECT *, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day,
               CAST(dayofweek(date) AS INT) AS day_of_week, CAST(weekofyear(date) AS INT) AS week_of_year,
               CAST(quarter(date) AS INT) AS quarter, CAST(dayofyear(date) AS INT) AS day_of_year,
               CASE WHEN dayofweek(date) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
               SIN(2.0::DOUBLE * 3.14159265::DOUBLE * month(date) / 12) AS sin_month,
               COS(2.0::DOUBLE * 3.14159265::DOUBLE * month(date) / 12) AS cos_month,
               SIN(2.0::DOUBLE * 3.14159265::DOUBLE * dayofweek(date) / 7) AS sin_dow,
               COS(2.0::DOUBLE * 3.14159265::DOUBLE * dayofweek(date) / 7) AS cos_dow,
               CASE WHEN day(date) = 15 OR date = last_day(date) THEN 1 ELSE 0 END AS is_payday,
               CASE WHEN date BETWEEN DATE '1998-04-16' AND DATE '1998-05-16' THEN 1 ELSE 0 END AS is_earthquake_period,
               holiday_type AS holiday_type_encoded
        FROM clean""",
    "smoothed": """
        SELECT store_nbr, item_nbr, unnest(ds) AS date, unnest(e7) AS e7, unnest(e14) AS e14, unnest(e28) AS e28
        FROM (SELECT store_nbr, item_nbr, list(date ORDER BY date) AS ds,
                     list_reduce(list([unit_sales] ORDER BY date), lambda a, x : list_append(a, 0.75::DOUBLE * a[-1] + 0.25::DOUBLE * x[1])) AS e7,
                     list_reduce(list([unit_sales] ORDER BY date), lambda a, x : list_append(a, (13::DOUBLE / 15) * a[-1] + (2::DOUBLE / 15) * x[1])) AS e14,
                     list_reduce(list([unit_sales] ORDER BY date), lambda a, x : list_append(a, (27::DOUBLE / 29) * a[-1] + (2::DOUBLE / 29) * x[1])) AS e28
              FROM clean GROUP BY store_nbr, item_nbr)""",
    "windowed": """
        SELECT *,
               lag(unit_sales, 1) OVER w AS sales_lag_1, lag(unit_sales, 2) OVER w AS sales_lag_2,
               lag(unit_sales, 3) OVER w AS sales_lag_3, lag(unit_sales, 7) OVER w AS sales_lag_7,
               lag(unit_sales, 14) OVER w AS sales_lag_14, lag(unit_sales, 21) OVER w AS sales_lag_21,
               lag(unit_sales, 28) OVER w AS sales_lag_28,
               lag(CAST(onpromotion AS INT), 1) OVER w AS promo_lag_1, lag(CAST(onpromotion AS INT), 7) OVER w AS promo_lag_7,
               AVG(unit_sales) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS sales_roll_mean_7,
               AVG(unit_sales) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS sales_roll_mean_14,
               AVG(unit_sales) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS sales_roll_mean_28,
               AVG(unit_sales) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS sales_roll_mean_60,
               STDDEV_SAMP(unit_sales) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS sales_roll_std_7,
               STDDEV_SAMP(unit_sales) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS sales_roll_std_28,
               MIN(unit_sales) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS sales_roll_min_7,
               MAX(unit_sales) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS sales_roll_max_7,
               MEDIAN(unit_sales) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS sales_roll_median_14,
               AVG(unit_sales) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sales_expanding_mean,
               STDDEV_SAMP(unit_sales) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sales_expanding_std
        FROM dated WINDOW w AS (PARTITION BY store_nbr, item_nbr ORDER BY date)""",
    "rolled": """
        SELECT windowed.*, lag(e7) OVER w AS sales_ewma_7, lag(e14) OVER w AS sales_ewma_14, lag(e28) OVER w AS sales_ewma_28
        FROM windowed JOIN smoothed USING (store_nbr, item_nbr, date) WINDOW w AS (PARTITION BY store_nbr, item_nbr ORDER BY date)""",
    "oil_feats": """
        SELECT date, AVG(v) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS oil_roll_mean_7,
               AVG(v) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS oil_roll_mean_30,
               COALESCE((v - lag(v, 7) OVER (ORDER BY date)) / NULLIF(lag(v, 7) OVER (ORDER BY date), 0), 0) AS oil_pct_change_7d,
               COALESCE(v - lag(v, 1) OVER (ORDER BY date), 0) AS oil_diff_1d
        FROM (SELECT date, MAX(dcoilwtico) AS v FROM clean GROUP BY date)""",
    "trans_feats": """
        SELECT store_nbr, date,
               AVG(v) OVER (PARTITION BY store_nbr ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS trans_roll_mean_7,
               AVG(v) OVER (PARTITION BY store_nbr ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS trans_roll_mean_28
        FROM (SELECT store_nbr, date, ANY_VALUE(transactions) AS v FROM clean GROUP BY ALL)""",
    "fam_promo": "SELECT date, family, AVG(CAST(CAST(onpromotion AS INT) AS DOUBLE)) AS family_promo_ratio FROM clean GROUP BY ALL",
    "store_promo": "SELECT date, store_nbr, AVG(CAST(CAST(onpromotion AS INT) AS DOUBLE)) AS store_promo_ratio FROM clean GROUP BY ALL",
    "fstore": """
        SELECT r.*, COALESCE(oil_roll_mean_7, 0) AS oil_roll_mean_7, COALESCE(oil_roll_mean_30, 0) AS oil_roll_mean_30,
               oil_pct_change_7d, oil_diff_1d,
               COALESCE(family_promo_ratio, 0) AS family_promo_ratio, COALESCE(store_promo_ratio, 0) AS store_promo_ratio,
               COALESCE(trans_roll_mean_7, 0) AS trans_roll_mean_7, COALESCE(trans_roll_mean_28, 0) AS trans_roll_mean_28,
               unit_sales / (transactions + 1) AS sales_per_transaction,
               family_freq, city_freq, state_freq, type_freq, cluster_freq, class_freq,
               COALESCE(sales_lag_1 / (sales_roll_mean_7 + 1e-4::DOUBLE), 0) AS sales_to_roll7_ratio,
               COALESCE(sales_lag_1 / (sales_roll_mean_28 + 1e-4::DOUBLE), 0) AS sales_to_roll28_ratio,
               COALESCE(CAST(CAST(onpromotion AS INT) AS DOUBLE) * sales_roll_mean_7, 0) AS promo_sales_interaction,
               COALESCE(dcoilwtico * sales_roll_mean_28, 0) AS oil_sales_interaction
        FROM (SELECT * REPLACE (
                COALESCE(dcoilwtico, 0) AS dcoilwtico,
                COALESCE(sales_lag_1, 0) AS sales_lag_1, COALESCE(sales_lag_2, 0) AS sales_lag_2,
                COALESCE(sales_lag_3, 0) AS sales_lag_3, COALESCE(sales_lag_7, 0) AS sales_lag_7,
                COALESCE(sales_lag_14, 0) AS sales_lag_14, COALESCE(sales_lag_21, 0) AS sales_lag_21,
                COALESCE(sales_lag_28, 0) AS sales_lag_28,
                COALESCE(sales_roll_mean_7, 0) AS sales_roll_mean_7, COALESCE(sales_roll_mean_14, 0) AS sales_roll_mean_14,
                COALESCE(sales_roll_mean_28, 0) AS sales_roll_mean_28, COALESCE(sales_roll_mean_60, 0) AS sales_roll_mean_60,
                COALESCE(sales_roll_std_7, 0) AS sales_roll_std_7, COALESCE(sales_roll_std_28, 0) AS sales_roll_std_28,
                COALESCE(sales_roll_min_7, 0) AS sales_roll_min_7, COALESCE(sales_roll_max_7, 0) AS sales_roll_max_7,
                COALESCE(sales_roll_median_14, 0) AS sales_roll_median_14,
                COALESCE(sales_expanding_mean, 0) AS sales_expanding_mean, COALESCE(sales_expanding_std, 0) AS sales_expanding_std,
                COALESCE(sales_ewma_7, 0) AS sales_ewma_7, COALESCE(sales_ewma_14, 0) AS sales_ewma_14,
                COALESCE(sales_ewma_28, 0) AS sales_ewma_28)
              FROM rolled) r
        LEFT JOIN oil_feats USING (date) LEFT JOIN fam_promo USING (date, family)
        LEFT JOIN store_promo USING (date, store_nbr) LEFT JOIN trans_feats USING (date, store_nbr)
        LEFT JOIN (SELECT family, COUNT(*) * 1.0::DOUBLE / (SELECT COUNT(*) FROM clean) AS family_freq FROM clean GROUP BY 1) USING (family)
        LEFT JOIN (SELECT city, COUNT(*) * 1.0::DOUBLE / (SELECT COUNT(*) FROM clean) AS city_freq FROM clean GROUP BY 1) USING (city)
        LEFT JOIN (SELECT state, COUNT(*) * 1.0::DOUBLE / (SELECT COUNT(*) FROM clean) AS state_freq FROM clean GROUP BY 1) USING (state)
        LEFT JOIN (SELECT type, COUNT(*) * 1.0::DOUBLE / (SELECT COUNT(*) FROM clean) AS type_freq FROM clean GROUP BY 1) USING (type)
        LEFT JOIN (SELECT cluster, COUNT(*) * 1.0::DOUBLE / (SELECT COUNT(*) FROM clean) AS cluster_freq FROM clean GROUP BY 1) USING (cluster)
        LEFT JOIN (SELECT class, COUNT(*) * 1.0::DOUBLE / (SELECT COUNT(*) FROM clean) AS class_freq FROM clean GROUP BY 1) USING (class)
        WHERE date >= (SELECT MIN(date) + 90 FROM clean)""",
}


def oracle_text(body: str) -> str:
    """``body`` with the shared tables it names, and those they name, as leading CTEs."""
    body = body.strip()
    own = re.sub(r"^WITH\s+", "", body) if body.startswith("WITH ") else ""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in SHARED_SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(SHARED_SQL[name])

    visit(own or body)
    ctes = [f"{name} AS MATERIALIZED ({SHARED_SQL[name].strip()})" for name in SHARED_SQL if name in needed]
    if own:
        return "WITH " + ",\n".join([*ctes, own])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
