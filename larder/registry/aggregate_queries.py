"""Aggregations, reports and validation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import aggregates as ag, quality as q
from larder.operators.ranking import concat_frames
from larder.plans.clean import sales_cap
from larder.plans.feature_store import STORE_COLUMNS
from larder.registry.base import f32, query
from larder.registry.relational_queries import DAILY_FRAME_SQL, daily_frame
from larder.session import settle

KEY = ("date", "store_nbr", "item_nbr")
CLEAN_TYPES = {
    "date": "date", "store_nbr": "int", "item_nbr": "int", "unit_sales": "double", "onpromotion": "boolean", "is_return": "int",
    "city": "string", "state": "string", "type": "string", "cluster": "int", "family": "string", "class": "int", "perishable": "int",
    "dcoilwtico": "double", "transactions": "bigint", "is_holiday": "int", "holiday_type": "string",
}
STORE_NULLS = "(" + " + ".join(f"(COUNT(*) - COUNT({c}))" for c in STORE_COLUMNS) + ")"


@query(
    "a01_group_by",
    "SELECT store_nbr, SUM(unit_sales) AS unit_sales_sum, AVG(unit_sales) AS unit_sales_avg, COUNT(item_nbr) AS item_nbr_count FROM train GROUP BY 1",
)
def group_by(fx):
    return ag.aggregate(fx.train, "store_nbr", {"unit_sales": ["SUM", "AVG"], "item_nbr": "COUNT"})


@query("a02_daily_sales", "SELECT * FROM daily")
def daily(fx):
    return ag.daily_sales(fx.train)


@query(
    "a03_daily_trend",
    """SELECT date, CAST(AVG(unit_sales) AS FLOAT) AS avg_sales, CAST(SUM(is_return) AS BIGINT) AS returns,
              CAST(AVG(CAST(CAST(onpromotion AS INT) AS DOUBLE)) AS FLOAT) AS promo_rate FROM clean GROUP BY date""",
)
def trend(fx):
    return f32(ag.daily_trend(fx.clean), "avg_sales", "promo_rate")


@query(
    "a04_quantiles",
    """SELECT quantile_cont(unit_sales, 0.5) AS median_sales, CAST(quantile_cont(unit_sales, 0.99) AS FLOAT) AS q99,
              CAST(quantile_cont(unit_sales, 0.999) AS FLOAT) AS q999 FROM train""",
)
def quantiles(fx):
    from larder.operators.quantiles import exact_quantiles

    return f32(exact_quantiles(fx.train, "unit_sales", (0.5, 0.99, 0.999), names=("median_sales", "q99", "q999")), "q99", "q999")


@query(
    "a05_outlier_audit",
    """SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE unit_sales < 0) AS negative_sales, MIN(unit_sales) AS min_sales,
              MAX(unit_sales) AS max_sales, CAST(AVG(unit_sales) AS FLOAT) AS mean_sales,
              COUNT(*) FILTER (WHERE unit_sales > (SELECT q FROM cap)) AS outliers_above_q999,
              CAST(quantile_cont(unit_sales, 0.5) AS FLOAT) AS median_sales, CAST(quantile_cont(unit_sales, 0.99) AS FLOAT) AS q99_sales,
              CAST(quantile_cont(unit_sales, 0.999) AS FLOAT) AS q999_sales FROM train""",
)
def outliers(fx):
    return f32(ag.outlier_audit(fx.train), "mean_sales", "median_sales", "q99_sales", "q999_sales")


@query(
    "a06_output_quality",
    """SELECT COUNT(*) AS total_rows, MIN(date) AS min_date, MAX(date) AS max_date, COUNT(DISTINCT store_nbr) AS unique_stores,
              COUNT(DISTINCT item_nbr) AS unique_items, MIN(unit_sales) AS min_sales, CAST(MAX(unit_sales) AS FLOAT) AS max_sales,
              COUNT(*) FILTER (WHERE unit_sales < 0) AS negative_sales, COUNT(*) FILTER (WHERE unit_sales IS NULL) AS null_sales,
              COUNT(*) FILTER (WHERE dcoilwtico IS NULL) AS null_oil, COUNT(*) FILTER (WHERE is_holiday IS NULL) AS null_holiday FROM clean""",
)
def output_quality(fx):
    return f32(q.clean_quality(fx.clean), "max_sales")


@query(
    "a07_dataset_summary",
    """SELECT COUNT(*) AS n_rows, 5 AS n_columns, COUNT(*) FILTER (WHERE onpromotion IS NULL) AS null_count,
              'date: 1, double: 1, int: 2, string: 1' AS types FROM train""",
)
def summary(fx):
    return q.dataset_summary(fx.train)


@query(
    "a08_quality_report",
    "WITH r AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS dtype, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS unique_count, COUNT(*) AS n FROM clean"
        for c, kind in CLEAN_TYPES.items()
    )
    + """)
       SELECT column_name, dtype, null_count, CAST(ROUND(null_count * 100.0::DOUBLE / n, 2) AS FLOAT) AS null_pct, unique_count,
              CAST(0 AS BIGINT) AS inf_count, unique_count <= 1 AS is_constant FROM r""",
)
def report(fx):
    return f32(q.quality_report(fx.written_clean), "null_pct")


STORE_KINDS = {
    **{c: "int" for c in ("store_nbr", "item_nbr", "is_return", "cluster", "class", "perishable", "is_holiday", "year", "month", "day", "day_of_week", "week_of_year",
                          "quarter", "day_of_year", "is_weekend", "promo_lag_1", "promo_lag_7", "is_payday", "is_earthquake_period")},
    **{c: "string" for c in ("city", "state", "type", "family", "holiday_type", "holiday_type_encoded")},
    "date": "date", "onpromotion": "boolean", "transactions": "bigint",
}
#: Inexact columns of the store, rounded like the storage type so that both engines see the same values.
STORE_INEXACT = tuple(c for c in STORE_COLUMNS if c not in STORE_KINDS)
STORED_SQL = "SELECT " + ", ".join(f"CAST(ROUND({c}, 9) AS FLOAT) AS {c}" if c in STORE_INEXACT else c for c in STORE_COLUMNS) + " FROM fstore"


def stored(fx):
    """The written feature store with its 74 columns."""
    return settle(fx.features.withColumns({c: F.round(c, 9).cast("float") for c in STORE_INEXACT}), "store")


@query(
    "a08_store_report",
    f"WITH st AS MATERIALIZED ({STORED_SQL}), r AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{STORE_KINDS.get(c, 'float')}' AS dtype, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS unique_count, COUNT(*) AS n FROM st"
        for c in STORE_COLUMNS
    )
    + """) SELECT column_name, dtype, null_count, CAST(ROUND(null_count * 100.0::DOUBLE / n, 2) AS FLOAT) AS null_pct, unique_count,
                  CAST(0 AS BIGINT) AS inf_count, unique_count <= 1 AS is_constant FROM r""",
)
def store_report(fx):
    return f32(q.quality_report(stored(fx)), "null_pct")


@query(
    "a09_missing_report",
    """SELECT 'onpromotion' AS column_name, COUNT(*) - COUNT(onpromotion) AS missing_count,
              CAST(ROUND((COUNT(*) - COUNT(onpromotion)) * 100.0::DOUBLE / COUNT(*), 2) AS FLOAT) AS missing_pct FROM train""",
)
def missing(fx):
    return f32(q.missing_report(fx.train), "missing_pct")


@query(
    "a10_duplicate_report",
    """WITH g AS (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)
       SELECT CAST(SUM(n - 1) AS BIGINT) AS duplicate_count, CAST(ROUND(SUM(n - 1) * 100.0::DOUBLE / SUM(n), 2) AS FLOAT) AS duplicate_pct,
              SUM(n - 1) > 0 AS has_duplicates FROM g""",
)
def duplicates(fx):
    return f32(q.duplicate_report(fx.raw("lineitem"), ["l_partkey", "l_suppkey"]), "duplicate_pct")


def _numeric_sql(table, column):
    return f"""SELECT '{column}' AS column_name, COUNT({column}) AS count, CAST(AVG({column}) AS FLOAT) AS mean,
        CAST(STDDEV_SAMP({column}) AS FLOAT) AS std, CAST(MIN({column}) AS DOUBLE) AS min, CAST(quantile_cont({column}, 0.25) AS FLOAT) AS q25,
        CAST(quantile_cont({column}, 0.5) AS FLOAT) AS q50, CAST(quantile_cont({column}, 0.75) AS FLOAT) AS q75, CAST(MAX({column}) AS DOUBLE) AS max,
        COUNT(*) FILTER (WHERE {column} = 0) AS zeros,
        CAST(ROUND(COUNT(*) FILTER (WHERE {column} = 0) * 100.0::DOUBLE / COUNT(*), 2) AS FLOAT) AS zeros_pct FROM {table}"""


NUMERIC = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("a11_numeric_summary", " UNION ALL ".join(_numeric_sql("lineitem", c) for c in NUMERIC))
def numeric(fx):
    return f32(q.numeric_summary(fx.raw("lineitem"), NUMERIC), "mean", "std", "q25", "q50", "q75", "zeros_pct")


STORE_NUMBERS = tuple(c for c in STORE_COLUMNS if STORE_KINDS.get(c, "float") in ("int", "bigint", "float"))
_DOUBLES_SQL = "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in STORE_NUMBERS) + f" FROM ({STORED_SQL})"


@query(
    "a11_store_summary",
    f"WITH st AS MATERIALIZED ({_DOUBLES_SQL}) SELECT column_name, count, mean, q25, q50, q75, zeros, zeros_pct FROM ("
    + " UNION ALL ".join(_numeric_sql("st", c) for c in STORE_NUMBERS) + ")",
)
def store_numeric(fx):
    out = q.numeric_summary(stored(fx), STORE_NUMBERS)
    return f32(out.select("column_name", "count", "mean", "q25", "q50", "q75", "zeros", "zeros_pct"), "mean", "q25", "q50", "q75", "zeros_pct")


@query(
    "a10_whole_rows",
    "WITH g AS (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity, l_discount, l_tax, l_shipdate) "
    "SELECT CAST(SUM(n - 1) AS BIGINT) AS duplicate_count, CAST(ROUND(SUM(n - 1) * 100.0::DOUBLE / SUM(n), 2) AS FLOAT) AS duplicate_pct, SUM(n - 1) > 0 AS has_duplicates FROM g",
)
def whole_duplicates(fx):
    """Over all columns of a projection."""
    return f32(q.duplicate_report(fx.raw("lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate")), "duplicate_pct")


@query(
    "a12_skewness",
    """SELECT 'unit_sales' AS column_name, CAST(skewness(unit_sales) AS FLOAT) AS skewness FROM train""",
)
def skew(fx):
    return f32(q.skewness(fx.train, ["unit_sales"]), "skewness")


@query(
    "a13_categorical_summary",
    """WITH c AS (SELECT 'onpromotion' AS column_name, onpromotion AS value, COUNT(*) AS n FROM train GROUP BY 2
                  UNION ALL SELECT 'family', family, COUNT(*) FROM train JOIN items USING (item_nbr) GROUP BY 2),
            r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS i, SUM(n) OVER (PARTITION BY column_name) AS total,
                         COUNT(value) OVER (PARTITION BY column_name) AS unique_values FROM c)
       SELECT column_name, unique_values, value AS top_value, n AS top_frequency, CAST(ROUND(n * 100.0::DOUBLE / total, 2) AS FLOAT) AS top_pct FROM r WHERE i = 1""",
)
def categorical(fx):
    table = fx.train.join(fx.items, "item_nbr")
    return f32(q.categorical_summary(table, ["onpromotion", "family"]), "top_pct")


@query(
    "a14_target_classes",
    """WITH c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE unit_sales > 0) AS p, COUNT(*) FILTER (WHERE unit_sales = 0) AS z,
                         COUNT(*) FILTER (WHERE unit_sales < 0) AS r FROM train)
       SELECT 'positive' AS sales_class, p AS n_rows, CAST(p * 100.0::DOUBLE / n AS FLOAT) AS share_pct FROM c
       UNION ALL SELECT 'zero', z, CAST(z * 100.0::DOUBLE / n AS FLOAT) FROM c UNION ALL SELECT 'returns', r, CAST(r * 100.0::DOUBLE / n AS FLOAT) FROM c""",
)
def classes(fx):
    return f32(ag.target_classes(fx.train), "share_pct")


ENTITIES = {
    "stores": ("stores", "store_nbr"), "cities": ("stores", "city"), "states": ("stores", "state"), "items": ("items", "item_nbr"),
    "families": ("items", "family"), "classes": ("items", "class"), "holiday types": ("holidays", "type"),
}


@query(
    "a15_cardinality",
    " UNION ALL ".join(f"SELECT '{e}' AS entity, COUNT(DISTINCT {c}) AS n_distinct FROM {t}" for e, (t, c) in ENTITIES.items()),
)
def entities(fx):
    frames = {"stores": fx.stores, "items": fx.items, "holidays": fx.holidays}
    return q.cardinality({e: (frames[t], c) for e, (t, c) in ENTITIES.items()})


DATED = ("train", "oil", "transactions", "holidays")


@query(
    "a16_timeline",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, MIN(date) AS first_date, MAX(date) AS last_date FROM {t}" for t in DATED),
)
def timeline(fx):
    return q.timeline({"train": fx.train, "oil": fx.oil, "transactions": fx.transactions, "holidays": fx.holidays})


@query(
    "a17_value_counts",
    """SELECT 'store type' AS label, type AS value, COUNT(*) AS n FROM stores GROUP BY 2
       UNION ALL SELECT 'family', family, COUNT(*) FROM items GROUP BY 2 UNION ALL SELECT 'holiday', type, COUNT(*) FROM holidays GROUP BY 2""",
)
def counts(fx):
    parts = {"store type": (fx.stores, "type"), "family": (fx.items, "family"), "holiday": (fx.holidays, "type")}
    return concat_frames(
        [ag.value_counts(df, c).select(F.lit(name).alias("label"), F.col(c).alias("value"), "n") for name, (df, c) in parts.items()]
    )


@query(
    "a18_monthly_mean",
    """WITH d AS (SELECT * FROM daily)
       SELECT month, CAST(avg_total AS FLOAT) AS total_sales FROM
       (SELECT CAST(unnest(generate_series(date_trunc('month', MIN(date)), date_trunc('month', MAX(date)), INTERVAL 1 MONTH)) AS DATE) AS month FROM d)
       LEFT JOIN (SELECT CAST(date_trunc('month', date) AS DATE) AS month, AVG(total_sales) AS avg_total FROM d GROUP BY 1) USING (month)""",
)
def monthly(fx):
    daily = ag.daily_sales(fx.train)
    return f32(ag.monthly_mean(daily, "total_sales"), "total_sales")


@query(
    "a19_seasonality",
    """SELECT 'weekday' AS period, CAST(dayofweek(date) AS INT) AS position, CAST(AVG(total_sales) AS FLOAT) AS sales FROM daily GROUP BY 2
       UNION ALL SELECT 'month', CAST(month(date) AS INT), CAST(AVG(total_sales) AS FLOAT) FROM daily GROUP BY 2
       UNION ALL SELECT 'year', CAST(year(date) AS INT), CAST(SUM(total_sales) AS FLOAT) FROM daily GROUP BY 2""",
)
def seasonality(fx):
    d = ag.daily_sales(fx.train)
    parts = {
        "weekday": ag.by_weekday(d).select(F.col("day_of_week").alias("position"), F.col("mean_sales").alias("sales")),
        "month": ag.by_month(d).select(F.col("month").alias("position"), F.col("mean_sales").alias("sales")),
        "year": ag.by_year(d).select(F.col("year").alias("position"), F.col("total_sales").alias("sales")),
    }
    return f32(concat_frames([df.withColumn("period", F.lit(name)) for name, df in parts.items()]).select("period", "position", "sales"), "sales")


@query(
    "a20_yearly_growth",
    """WITH y AS (SELECT CAST(year(date) AS INT) AS year, SUM(unit_sales) AS total_sales FROM train GROUP BY 1)
       SELECT year, total_sales, CAST((total_sales - lag(total_sales) OVER (ORDER BY year)) * 100 / lag(total_sales) OVER (ORDER BY year) AS FLOAT) AS growth_pct FROM y""",
)
def growth(fx):
    return f32(ag.yearly_growth(ag.daily_sales(fx.train)), "growth_pct")


POINTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


@query(
    "a21_percentile_ladder",
    " UNION ALL ".join(
        f"SELECT 'p{p}' AS percentile, CAST(quantile_cont(l_extendedprice, {p / 100}) AS FLOAT) AS value FROM lineitem" for p in POINTS
    ),
)
def ladder(fx):
    return f32(ag.percentile_ladder(fx.raw("lineitem"), "l_extendedprice"), "value")


@query(
    "a22_sales_by_store_attribute",
    """SELECT 'type' AS attribute, type AS value, SUM(unit_sales) AS total_sales FROM train JOIN stores USING (store_nbr) GROUP BY 2
       UNION ALL SELECT 'city', city, SUM(unit_sales) FROM train JOIN stores USING (store_nbr) GROUP BY 2
       UNION ALL SELECT 'cluster', CAST(cluster AS VARCHAR), SUM(unit_sales) FROM train JOIN stores USING (store_nbr) GROUP BY 2""",
)
def by_store_attribute(fx):
    return concat_frames(
        [
            ag.sales_by_attribute(fx.train, fx.stores, "store_nbr", [c]).select(
                F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value"), "total_sales"
            )
            for c in ("type", "city", "cluster")
        ]
    )


@query(
    "a23_sales_by_item_attribute",
    """SELECT 'family' AS attribute, family AS value, SUM(unit_sales) AS total_sales FROM train JOIN items USING (item_nbr) GROUP BY 2
       UNION ALL SELECT 'perishable', CAST(perishable AS VARCHAR), SUM(unit_sales) FROM train JOIN items USING (item_nbr) GROUP BY 2""",
)
def by_item_attribute(fx):
    return concat_frames(
        [
            ag.sales_by_attribute(fx.train, fx.items, "item_nbr", [c]).select(
                F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value"), "total_sales"
            )
            for c in ("family", "perishable")
        ]
    )


@query(
    "a24_family_months",
    """WITH f AS (SELECT family, strftime(date, '%Y-%m') AS month, SUM(unit_sales) AS total_sales FROM train JOIN items USING (item_nbr) GROUP BY 1, 2)
       SELECT * FROM f WHERE family IN (SELECT family FROM f GROUP BY 1 ORDER BY SUM(total_sales) DESC, family LIMIT 5)""",
)
def family_months(fx):
    return ag.family_months(fx.train, fx.items)


@query(
    "a25_promotion_lift",
    """WITH a AS (SELECT AVG(unit_sales) FILTER (WHERE onpromotion = 'True') AS p, AVG(unit_sales) FILTER (WHERE onpromotion IS DISTINCT FROM 'True') AS r FROM train)
       SELECT CAST(p AS FLOAT) AS promo_avg, CAST(r AS FLOAT) AS regular_avg, CAST((p - r) * 100 / r AS FLOAT) AS lift_pct FROM a""",
)
def lift(fx):
    return f32(ag.promotion_lift(fx.train), "promo_avg", "regular_avg", "lift_pct")


@query(
    "a26_promotion_rate_by_month",
    """WITH d AS (SELECT date, AVG(CASE WHEN onpromotion = 'True' THEN 1.0::DOUBLE ELSE 0 END) * 100 AS r FROM train GROUP BY 1)
       SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(AVG(r) AS FLOAT) AS promo_rate FROM d GROUP BY 1""",
)
def promo_rate(fx):
    return f32(ag.promotion_rate_by_month(fx.train), "promo_rate")


@query(
    "a27_family_lift",
    """WITH i AS (SELECT item_nbr, onpromotion IS NOT DISTINCT FROM 'True' AS p, AVG(unit_sales) AS m FROM train GROUP BY 1, 2),
            f AS (SELECT family, COALESCE(AVG(m) FILTER (WHERE NOT p), 0) AS r, COALESCE(AVG(m) FILTER (WHERE p), 0) AS a FROM i JOIN items USING (item_nbr) GROUP BY 1)
       SELECT family, CAST(r AS FLOAT) AS regular_avg, CAST(a AS FLOAT) AS promo_avg,
              CAST(ROUND((a - r) / GREATEST(r, 1e-5::DOUBLE) * 100, 1) AS FLOAT) AS lift_pct FROM f""",
)
def family_lift(fx):
    return f32(ag.family_lift(fx.train, fx.items), "regular_avg", "promo_avg", "lift_pct")


@query(
    "a28_correlations",
    "SELECT CAST(corr(dcoilwtico, total_sales) AS FLOAT) AS oil_sales, CAST(corr(transactions, total_sales) AS FLOAT) AS transactions_sales FROM ("
    + DAILY_FRAME_SQL + ")",
)
def correlations(fx):
    frame = daily_frame(fx)
    out = ag.correlation(frame, "dcoilwtico", "total_sales", "oil_sales").withColumn(
        "transactions_sales", ag.correlation(frame, "transactions", "total_sales").scalar()
    )
    return f32(out, "oil_sales", "transactions_sales")


MEASURES = ("total_sales", "avg_sales", "promo_rate", "dcoilwtico", "transactions")


@query(
    "a29_correlation_matrix",
    "WITH f AS (" + DAILY_FRAME_SQL + ") "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS row_name, '{b}' AS column_name, CAST(corr({a}, {b}) AS FLOAT) AS correlation FROM f"
        for a in MEASURES for b in MEASURES if a != b
    )
    + " UNION ALL SELECT unnest(['total_sales', 'avg_sales', 'promo_rate', 'dcoilwtico', 'transactions']) AS a, unnest(['total_sales', 'avg_sales', 'promo_rate', 'dcoilwtico', 'transactions']) AS b, CAST(1 AS FLOAT)",
)
def matrix(fx):
    return f32(ag.correlation_matrix(daily_frame(fx), MEASURES), "correlation")


RANKED = ("store_nbr", "item_nbr", "is_return", "cluster", "class", "perishable", "transactions", "is_holiday")


@query(
    "a30_rank_by_correlation",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(corr({c}, unit_sales) AS FLOAT) AS correlation, CAST(ABS(corr({c}, unit_sales)) AS FLOAT) AS abs_correlation FROM clean"
        for c in RANKED
    ),
)
def ranked(fx):
    return f32(ag.rank_by_correlation(fx.clean, "unit_sales", RANKED), "correlation", "abs_correlation")


@query(
    "a31_holiday_effect",
    """WITH e AS (SELECT total_sales, type, transferred FROM daily LEFT JOIN holidays USING (date))
       SELECT 'is_holiday' AS grouping, CAST(type IS NOT NULL AS VARCHAR) AS value, CAST(AVG(total_sales) AS FLOAT) AS mean_sales FROM e GROUP BY 2
       UNION ALL SELECT 'type', type, CAST(AVG(total_sales) AS FLOAT) FROM e WHERE type IS NOT NULL GROUP BY 2
       UNION ALL SELECT 'transferred', CAST(transferred AS VARCHAR), CAST(AVG(total_sales) AS FLOAT) FROM e WHERE type IS NOT NULL GROUP BY 2""",
)
def holiday_effect(fx):
    d = settle(ag.daily_sales(fx.train), "daily")
    parts = [
        ag.holiday_effect(d, fx.holidays, by).select(F.lit(by).alias("grouping"), F.col(by).cast("string").alias("value"), "mean_sales")
        for by in ("is_holiday", "type", "transferred")
    ]
    return f32(concat_frames(parts), "mean_sales")


@query(
    "a32_transactions",
    """SELECT type, CAST(AVG(transactions) AS FLOAT) AS mean_transactions FROM transactions JOIN stores USING (store_nbr) GROUP BY 1""",
)
def transactions(fx):
    return f32(ag.transactions_by_type(fx.transactions, fx.stores), "mean_transactions")


@query("a33_holiday_days", "SELECT * FROM holiday_days")
def holiday_days(fx):
    return fx.holiday_days


@query("a33_holidays_per_year", "SELECT CAST(year(date) AS INT) AS year, COUNT(*) AS n_holidays FROM holiday_days GROUP BY 1")
def holidays_per_year(fx):
    return ag.holidays_per_year(fx.holiday_days)


@query(
    "a34_constant_per_key",
    """SELECT store_nbr, date, ANY_VALUE(transactions) AS transactions FROM clean GROUP BY 1, 2""",
)
def constant(fx):
    return ag.constant_per_key(fx.clean, ("store_nbr", "date"), "transactions")


@query(
    "a35_promo_ratios",
    """SELECT date, family AS grp, family_promo_ratio AS ratio FROM fam_promo
       UNION ALL SELECT date, CAST(store_nbr AS VARCHAR), store_promo_ratio FROM store_promo""",
)
def promo_ratios(fx):
    family = ag.promo_ratio(fx.clean, ("date", "family"), "ratio").select("date", F.col("family").alias("grp"), "ratio")
    store = ag.promo_ratio(fx.clean, ("date", "store_nbr"), "ratio").select("date", F.col("store_nbr").cast("string").alias("grp"), "ratio")
    return family.unionByName(store)


ENCODED = ("family", "city", "state", "type", "cluster", "class")


@query(
    "a36_frequency_encodings",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) * 1.0::DOUBLE / (SELECT COUNT(*) FROM clean) AS frequency FROM clean GROUP BY {c}"
        for c in ENCODED
    ),
)
def encodings(fx):
    # One pass over the fact rows; the six encodings and their totals read its small result.
    counted = settle(fx.clean.groupBy(*ENCODED).agg(F.count("*").alias("n")), "encodings")
    return concat_frames(
        [
            ag.frequency_encoding(counted, c, "frequency", weight="n").select(
                F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), "frequency"
            )
            for c in ENCODED
        ]
    )


@query(
    "a37_split_report",
    """SELECT CASE WHEN date < DATE '2001-01-01' THEN 'train' ELSE 'validation' END AS part, COUNT(*) AS n_rows, MIN(date) AS first_date,
              MAX(date) AS last_date, CAST(COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM train) AS FLOAT) AS share_pct FROM train GROUP BY 1""",
)
def split(fx):
    return f32(ag.split_report(fx.train, "2001-01-01"), "share_pct")


@query(
    "a38_half_year_rows",
    """SELECT concat(year(date), '-', CASE WHEN month(date) <= 6 THEN 'H1' ELSE 'H2' END) AS half_year, COUNT(*) AS n_rows,
              MIN(date) AS first_date, MAX(date) AS last_date FROM train GROUP BY 1""",
)
def half_years(fx):
    return ag.half_year_rows(fx.train)


@query(
    "a51_store_summary",
    f"""SELECT COUNT(*) AS n_rows, {len(STORE_COLUMNS)} AS n_columns, MIN(date) AS min_date, MAX(date) AS max_date,
              {STORE_NULLS} AS missing_values FROM fstore""",
)
def store_summary(fx):
    return q.store_summary(fx.features)


@query(
    "a53_hierarchy_totals",
    """SELECT type, family, CAST(SUM(unit_sales) AS FLOAT) AS total FROM clean GROUP BY ROLLUP (type, family)""",
)
def hierarchy(fx):
    return f32(ag.hierarchy_totals(fx.clean), "total")


# Validation rules: each query raises if the rule does not hold where it must, and counts violations where it need not.


@query("v01_required_columns", "SELECT 'empty' AS rule, CAST(COUNT(*) = 0 AS BIGINT) AS n_violations FROM train")
def required(fx):
    q.require_table(fx.train, ["date", "store_nbr", "item_nbr", "unit_sales"])
    return fx.train.agg((F.count("*") == 0).cast("bigint").alias("n_violations")).select(F.lit("empty").alias("rule"), "n_violations")


@query(
    "v02_numeric",
    "SELECT 'negative' AS rule, COUNT(*) AS n_violations FROM train WHERE unit_sales < 0",
)
def numeric_rule(fx):
    q.require_numeric(fx.train, ["unit_sales", "store_nbr"])
    return q.violations(fx.train, {"negative": F.col("unit_sales") < 0})


@query("v03_date", "SELECT 'null date' AS rule, COUNT(*) AS n_violations FROM oil WHERE date IS NULL")
def date_rule(fx):
    q.require_date(fx.oil)
    return q.violations(fx.oil, {"null date": F.col("date").isNull()})


@query("v04_target", "SELECT 'null target' AS rule, COUNT(*) AS n_violations FROM train WHERE unit_sales IS NULL")
def target_rule(fx):
    q.require_target(fx.train)
    return q.violations(fx.train, {"null target": F.col("unit_sales").isNull()})


@query(
    "v05_unique",
    """SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_count FROM (SELECT COUNT(*) AS n FROM train GROUP BY date, store_nbr, item_nbr)""",
)
def unique_rule(fx):
    q.require_unique(fx.items, "item_nbr")
    return q.duplicate_report(fx.train, KEY).select("duplicate_count")


@query(
    "v06_types",
    """SELECT * FROM (VALUES ('date', 'date'), ('store_nbr', 'int'), ('item_nbr', 'int'), ('unit_sales', 'double'), ('onpromotion', 'string')) t(column_name, column_type)
       WHERE (SELECT COUNT(*) FROM train) > 0""",
)
def type_rule(fx):
    from larder.sources.readers import describe_columns

    q.require_types(fx.train, {"date": "date", "unit_sales": "double", "store_nbr": "int"})
    described = describe_columns(fx.train).select("column_name", "column_type")
    rows = fx.train.agg(F.count("*")).scalar()
    return described.where(rows > 0)


@query(
    "v07_feature_store_report",
    f"""SELECT TRUE AS has_target, TRUE AS has_date, COUNT(*) AS row_count, {len(STORE_COLUMNS)} AS col_count,
              CAST({STORE_NULLS} * 100.0::DOUBLE / (COUNT(*) * {len(STORE_COLUMNS)}) AS FLOAT) AS missing_pct, TRUE AS is_valid FROM fstore""",
)
def store_report(fx):
    return f32(q.feature_store_report(fx.features), "missing_pct")


@query(
    "v08_clean_rules",
    """SELECT 'negative' AS rule, COUNT(*) FILTER (WHERE unit_sales < 0) AS n_violations FROM clean
       UNION ALL SELECT 'null', COUNT(*) FILTER (WHERE unit_sales IS NULL) FROM clean
       UNION ALL SELECT 'above cap', COUNT(*) FILTER (WHERE unit_sales > (SELECT q FROM cap) + 0.1) FROM clean""",
)
def clean_rules(fx):
    value = F.col("unit_sales")
    capped = fx.clean.withColumn("_cap", sales_cap(fx.train))
    return q.violations(capped, {"negative": value < 0, "null": value.isNull(), "above cap": value > F.col("_cap") + 0.1})


@query("v09_store_target", "SELECT 'null target' AS rule, COUNT(*) FILTER (WHERE unit_sales IS NULL) AS n_violations FROM fstore")
def store_target(fx):
    q.require_feature_store(fx.features)
    return q.violations(fx.features, {"null target": F.col("unit_sales").isNull()})
