"""Projections, filters, joins, sorts, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import calendar as cal, scalars as sc
from larder.operators import evaluation, joins, quality, ranking
from larder.operators.aggregates import daily_sales, daily_transactions
from larder.operators.quantiles import exact_quantiles
from larder.operators.windows import fill_forward, fill_both_ways
from larder.plans import clean as cl
from larder.plans.feature_store import STORE_COLUMNS, drop_warmup, interactions, sales_lags, zero_nulls
from larder.plans.upload import fill_defaults, match_headers, normalise_headers
from larder.operators import windows as W
from larder.registry.base import EVENT_WINDOW, f32, query

KEY = ("date", "store_nbr", "item_nbr")
_NO_FEATURES = {"date", "unit_sales", "onpromotion", "city", "state", "type", "family", "holiday_type", "holiday_type_encoded"}
STORE_NUMBERS = [c for c in STORE_COLUMNS if c not in _NO_FEATURES]


@query("p01_columns", "SELECT date, store_nbr, unit_sales FROM train")
def columns(fx):
    return fx.train.select("date", "store_nbr", "unit_sales")


@query(
    "p02_point_and_range_filter",
    "SELECT date, unit_sales FROM train WHERE store_nbr = 3 AND item_nbr = 7 AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'",
)
def point(fx):
    return fx.train.where(
        "store_nbr = 3 AND item_nbr = 7 AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"
    ).select("date", "unit_sales")


@query(
    "p03_membership_filter",
    "SELECT store_nbr, item_nbr, alert_status, family FROM inv "
    "WHERE alert_status IN ('CRITICAL_UNDERSTOCK', 'OVERSTOCK') AND family IN ('FAMILY_1', 'FAMILY_4')",
)
def membership(fx):
    from larder.operators.inventory import filter_inventory

    return filter_inventory(fx.inventory, ("CRITICAL_UNDERSTOCK", "OVERSTOCK"), ("FAMILY_1", "FAMILY_4")).select(
        "store_nbr", "item_nbr", "alert_status", "family"
    )


@query(
    "p04_clip_and_cap",
    "SELECT date, store_nbr, item_nbr, CAST(LEAST(GREATEST(unit_sales, 0), (SELECT q FROM cap)) AS FLOAT) AS unit_sales FROM train",
)
def clip(fx):
    capped = sc.clip_and_cap(F.col("unit_sales"), cl.sales_cap(fx.train))
    return fx.train.select(*KEY, capped.cast("float").alias("unit_sales"))


@query(
    "p05_return_flag",
    "SELECT date, store_nbr, item_nbr, CASE WHEN unit_sales < 0 THEN 1 ELSE 0 END AS is_return FROM train",
)
def returns(fx):
    return fx.train.select(*KEY, sc.return_flag(F.col("unit_sales")).alias("is_return"))


@query(
    "p06_text_to_boolean",
    """SELECT date, store_nbr, item_nbr, COALESCE(TRY_CAST(onpromotion AS BOOLEAN), FALSE) AS onpromotion,
       COALESCE(TRY_CAST(CASE item_nbr % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'T' WHEN 2 THEN '1' WHEN 3 THEN 'abc' END AS BOOLEAN), FALSE) AS odd_text
       FROM train""",
)
def booleans(fx):
    n = F.col("item_nbr") % 5
    odd = F.when(n == 0, "yes").when(n == 1, "T").when(n == 2, "1").when(n == 3, "abc")
    return fx.train.select(
        *KEY, sc.text_to_boolean(F.col("onpromotion")).alias("onpromotion"), sc.text_to_boolean(odd).alias("odd_text")
    )


@query(
    "p07_default_fill",
    """SELECT t.date, t.store_nbr, t.item_nbr, COALESCE(x.transactions, 0) AS transactions,
              COALESCE(is_holiday, 0) AS is_holiday, COALESCE(holiday_type, 'Regular') AS holiday_type
       FROM train t LEFT JOIN transactions x ON x.date = t.date AND x.store_nbr = t.store_nbr
       LEFT JOIN holiday_days h ON h.date = t.date""",
)
def defaults(fx):
    joined = joins.join_all(
        fx.train.select(*KEY), (fx.transactions, ["date", "store_nbr"]), (fx.holiday_days, ["date"])
    )
    return cl.with_defaults(joined, {"transactions": 0, "is_holiday": 0, "holiday_type": "Regular"}).select(
        *KEY, "transactions", "is_holiday", "holiday_type"
    )


@query(
    "p08_narrow_types",
    """SELECT CAST(store_nbr AS TINYINT) AS store_nbr, city, state, type, CAST(cluster AS TINYINT) AS cluster FROM stores""",
)
def narrowed(fx):
    return cl.narrow_types(fx.stores)


@query(
    "p08_storage_types",
    """SELECT date, CAST(store_nbr AS SMALLINT) AS store_nbr, item_nbr, CAST(unit_sales AS FLOAT) AS unit_sales, onpromotion,
       CAST(is_return AS SMALLINT) AS is_return, city, state, type, CAST(cluster AS SMALLINT) AS cluster, family,
       CAST(class AS SMALLINT) AS class, CAST(perishable AS SMALLINT) AS perishable, CAST(dcoilwtico AS FLOAT) AS dcoilwtico,
       CAST(transactions AS INT) AS transactions, CAST(is_holiday AS SMALLINT) AS is_holiday, holiday_type FROM clean""",
)
def stored(fx):
    return cl.cast_columns(fx.clean, cl.STORED_TYPES)


@query("p09_holiday_filter", "SELECT * FROM holidays WHERE NOT (transferred AND type <> 'Transfer')")
def holiday_filter(fx):
    return cl.drop_moved_holidays(fx.holidays)


@query(
    "p10_drop_warmup",
    "SELECT date, store_nbr, item_nbr, unit_sales FROM train WHERE date >= (SELECT MIN(date) + 90 FROM train)",
)
def warmup(fx):
    return drop_warmup(fx.train, fx.train).select(*KEY, "unit_sales")


@query(
    "p11_zero_nulls",
    """SELECT date, COALESCE(dcoilwtico, 0) AS dcoilwtico, COALESCE(lag(dcoilwtico) OVER (ORDER BY date), 0) AS before FROM oil""",
)
def zeros(fx):
    return zero_nulls(W.lags(fx.oil, "dcoilwtico", (1,), keys=(), prefix="before").withColumnRenamed("before_1", "before"))


@query(
    "p12_fixed_split",
    """SELECT 'train' AS part, COUNT(*) AS n_rows, SUM(unit_sales) AS total FROM train WHERE date < DATE '2001-01-01'
       UNION ALL SELECT 'validation', COUNT(*), SUM(unit_sales) FROM train WHERE date >= DATE '2001-01-01'""",
)
def fixed_split(fx):
    parts = evaluation.split_by_date(fx.train, "2001-01-01")
    return ranking.concat_frames(
        [
            part.agg(F.count("*").alias("n_rows"), F.sum("unit_sales").alias("total")).select(
                F.lit(name).alias("part"), "n_rows", "total"
            )
            for name, part in zip(("train", "validation"), parts)
        ]
    )


@query(
    "p13_model_features",
    f"SELECT unnest({list(STORE_NUMBERS)}) AS feature, (SELECT COUNT(*) FROM fstore) AS n_rows",
)
def features(fx):
    names = quality.model_features(fx.features)
    return fx.features.agg(F.count("*").alias("n_rows")).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"), "n_rows"
    )


@query(
    "p14_sample",
    """SELECT date, store_nbr, item_nbr, unit_sales FROM train
       ORDER BY md5(concat_ws('|', '42', CAST(date AS VARCHAR), CAST(store_nbr AS VARCHAR), CAST(item_nbr AS VARCHAR))) LIMIT 500""",
)
def sample(fx):
    return ranking.sample_rows(fx.train, 500, KEY).select(*KEY, "unit_sales")


@query(
    "p14_large_sample",
    """SELECT date, store_nbr, item_nbr, unit_sales FROM (SELECT *, row_number() OVER (ORDER BY
       md5(concat_ws('|', '7', CAST(date AS VARCHAR), CAST(store_nbr AS VARCHAR), CAST(item_nbr AS VARCHAR)))) AS r, COUNT(*) OVER () AS n FROM train) WHERE r <= n // 2""",
)
def large_sample(fx):
    """Half of the sales table, by a threshold instead of a sort."""
    rows = fx.written_train
    return ranking.sample_rows(rows, rows.count() // 2, KEY, seed=7, small=10).select(*KEY, "unit_sales")


@query("p15_preview", "SELECT * FROM train ORDER BY date, store_nbr, item_nbr LIMIT 5")
def preview(fx):
    return ranking.preview(fx.train, 5, KEY)


def upload_view(fx):
    """An upload made from the sales table: alias headers, labelled ids, some unreadable values."""
    bad = F.col("unit_sales") % 13 == 0
    return fx.train.select(
        F.col("date").cast("string").alias("Date_Time"),
        F.concat(F.lit("Store "), F.col("store_nbr").cast("string")).alias("store_id"),
        F.when(F.col("item_nbr") == 25, "unknown").otherwise(F.concat(F.lit("SKU-"), F.col("item_nbr").cast("string"))).alias("SKU"),
        F.when(bad, "n/a").otherwise(F.col("unit_sales").cast("int").cast("string")).alias(" Sales "),
        (F.col("store_nbr") * 7 + F.col("item_nbr")).cast("string").alias("Stock"),
        F.col("onpromotion").alias("OnPromotion"),
    )


UPLOAD_SQL = """
    SELECT date, CAST(store_nbr AS BIGINT) AS store_nbr,
           CAST(CASE WHEN item_nbr = 25 THEN 103520 ELSE item_nbr END AS BIGINT) AS item_nbr,
           CASE WHEN CAST(unit_sales AS INT) % 13 = 0 THEN 10.0::DOUBLE ELSE CAST(unit_sales AS DOUBLE) END AS unit_sales,
           CAST(store_nbr * 7 + item_nbr AS DOUBLE) AS current_stock,
           CASE WHEN onpromotion = 'True' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS onpromotion
    FROM train
"""


@query(
    "p16_normalise_headers",
    """SELECT CAST(date AS VARCHAR) AS date, concat('Store ', store_nbr) AS store_nbr,
              CASE WHEN item_nbr = 25 THEN 'unknown' ELSE concat('SKU-', item_nbr) END AS item_nbr,
              CASE WHEN CAST(unit_sales AS INT) % 13 = 0 THEN 'n/a' ELSE CAST(CAST(unit_sales AS INT) AS VARCHAR) END AS unit_sales,
              CAST(store_nbr * 7 + item_nbr AS VARCHAR) AS current_stock, onpromotion FROM train""",
)
def headers(fx):
    return normalise_headers(upload_view(fx))


@query(
    "p17_match_headers",
    """SELECT CAST(date AS VARCHAR) AS date, concat('Store ', store_nbr) AS store_nbr,
              CASE WHEN item_nbr = 25 THEN 'unknown' ELSE concat('SKU-', item_nbr) END AS item_nbr,
              CASE WHEN CAST(unit_sales AS INT) % 13 = 0 THEN 'n/a' ELSE CAST(CAST(unit_sales AS INT) AS VARCHAR) END AS unit_sales,
              CAST(store_nbr * 7 + item_nbr AS VARCHAR) AS current_stock, onpromotion FROM train""",
)
def words(fx):
    renamed = upload_view(fx).toDF("Sale Date", "'Store' code", "Item no", "Sales units", "In stock", "onpromotion")
    # The first header with "date" or "sales" wins, as in a left-to-right search.
    return match_headers(renamed)


@query("p18_upload_defaults", UPLOAD_SQL)
def upload_defaults(fx):
    return fill_defaults(normalise_headers(upload_view(fx))).drop("family")


@query(
    "p19_non_finite",
    """SELECT l_orderkey, l_linenumber, ratio, isnan(ratio) OR isinf(ratio) AS bad FROM
       (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE WHEN l_discount = 0 THEN 'nan'::DOUBLE ELSE l_quantity END AS ratio FROM lineitem)""",
)
def non_finite(fx):
    value = (
        F.when(F.col("l_tax") == 0, F.lit(float("inf"))).when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    )
    return (
        fx.raw("lineitem").select("l_orderkey", "l_linenumber", value.alias("ratio"))
        .withColumn("bad", sc.is_non_finite(F.col("ratio")))
    )


@query(
    "p20_zoom_filters",
    """SELECT 'zoom' AS range, unit_sales, COUNT(*) AS n_rows FROM train WHERE unit_sales BETWEEN 0 AND 50 GROUP BY 2
       UNION ALL SELECT 'positive', unit_sales, COUNT(*) FROM train WHERE unit_sales > 0 GROUP BY 2""",
)
def zoom(fx):
    value = F.col("unit_sales")
    return ranking.tagged_union(
        {
            "zoom": fx.train.where(value.between(0, 50)).groupBy("unit_sales").agg(F.count("*").alias("n_rows")),
            "positive": fx.train.where(value > 0).groupBy("unit_sales").agg(F.count("*").alias("n_rows")),
        },
        "range",
    )


# Joins


@query(
    "j01_equi_join",
    "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
)
def equi_join(fx):
    region = fx.raw("region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.join_on(fx.raw("nation"), region, "n_regionkey").select("n_name", "r_name")


def _join_sql(kind):
    return f"""SELECT COALESCE(x.date, o.date) AS date, o.dcoilwtico IS NULL AS no_price, SUM(transactions) IS NULL AS no_transactions,
               COUNT(*) AS n_rows FROM transactions x {kind} JOIN
               oil o ON x.date = o.date GROUP BY 1, 2"""


def _join_kind(fx, how):
    return (
        joins.join_on(fx.transactions, fx.oil, ["date"], how, right_columns=["dcoilwtico"])
        .groupBy("date", F.col("dcoilwtico").isNull().alias("no_price"))
        .agg(F.sum("transactions").isNull().alias("no_transactions"), F.count("*").alias("n_rows"))
    )


for _how in ("left", "inner", "right", "full"):
    query(f"j02_join_{_how}", _join_sql(_how.upper()))(lambda fx, how=_how: _join_kind(fx, how))


@query(
    "j03_star_join",
    """SELECT date, store_nbr, item_nbr, CAST(unit_sales AS FLOAT) AS unit_sales, onpromotion, is_return, city, state, type,
       cluster, family, class, perishable, CAST(dcoilwtico AS FLOAT) AS dcoilwtico, transactions, is_holiday, holiday_type FROM clean""",
)
def star(fx):
    return f32(fx.clean, "unit_sales", "dcoilwtico")


@query(
    "j04_feature_join",
    """SELECT date, store_nbr, item_nbr, CAST(oil_roll_mean_7 AS FLOAT) AS oil_roll_mean_7, CAST(family_promo_ratio AS FLOAT) AS family_promo_ratio,
       CAST(store_promo_ratio AS FLOAT) AS store_promo_ratio, CAST(trans_roll_mean_7 AS FLOAT) AS trans_roll_mean_7,
       CAST(family_freq AS FLOAT) AS family_freq, CAST(class_freq AS FLOAT) AS class_freq FROM fstore""",
)
def feature_join(fx):
    from larder.plans.feature_store import add_dimension_features, day_groups

    from larder.session import settle

    clean = fx.written_clean
    groups = settle(day_groups(clean), "day_groups")
    joined = drop_warmup(add_dimension_features(clean, groups), groups)
    floats = ["oil_roll_mean_7", "family_promo_ratio", "store_promo_ratio", "trans_roll_mean_7", "family_freq", "class_freq"]
    return f32(joined.select(*KEY, *floats), *floats)


@query(
    "j05_attach_one_row",
    """SELECT date, store_nbr, item_nbr, unit_sales > (SELECT quantile_cont(unit_sales, 0.99) FROM train) AS above_q99,
       CAST((SELECT quantile_cont(unit_sales, 0.99) FROM train) AS FLOAT) AS q99 FROM train""",
)
def one_row(fx):
    limits = exact_quantiles(fx.train, "unit_sales", (0.99,), names=("q99",))
    out = joins.attach_row(fx.train, limits).withColumn("above_q99", F.col("unit_sales") > F.col("q99"))
    return f32(out.select(*KEY, "above_q99", "q99"), "q99")


@query("j06_scalar_subquery", "SELECT family, COUNT(*) AS n, (SELECT COUNT(*) FROM items) AS total_rows FROM items GROUP BY family")
def scalar(fx):
    return joins.attach_total(fx.items.groupBy("family").agg(F.count("*").alias("n")), fx.items)


@query("j07_calendar_spine", "SELECT date, CAST(dcoilwtico AS FLOAT) AS dcoilwtico FROM spine LEFT JOIN oil USING (date)")
def spine(fx):
    return f32(joins.on_calendar(fx.oil, joins.date_spine(fx.train)), "dcoilwtico")


@query(
    "j08_daily_inner_join",
    """SELECT date, total_sales, transactions FROM daily JOIN
       (SELECT date, CAST(SUM(transactions) AS BIGINT) AS transactions FROM transactions GROUP BY date) USING (date)""",
)
def daily_join(fx):
    return joins.join_on(daily_sales(fx.train), daily_transactions(fx.transactions), "date", "inner").select(
        "date", "total_sales", "transactions"
    )


@query(
    "j09_event_fan_out",
    """SELECT d.date, total_sales, type, transferred FROM daily d LEFT JOIN
       (SELECT * FROM holidays UNION ALL SELECT date, 'Work Day', FALSE FROM holidays WHERE type = 'Event') h ON h.date = d.date""",
)
def fan_out(fx):
    from larder.operators.aggregates import with_events

    extra = fx.holidays.where("type = 'Event'").select("date", F.lit("Work Day").alias("type"), F.lit(False).alias("transferred"))
    return with_events(daily_sales(fx.train), fx.holidays.unionByName(extra)).select("date", "total_sales", "type", "transferred")


@query(
    "j10_aggregate_then_join",
    "SELECT store_nbr, city, type, SUM(unit_sales) AS total_sales FROM train JOIN stores USING (store_nbr) GROUP BY 1, 2, 3",
)
def aggregate_first(fx):
    totals = fx.train.groupBy("store_nbr").agg(F.sum("unit_sales").alias("total_sales"))
    return joins.join_on(totals, fx.stores, "store_nbr", "inner", ["city", "type"]).select(
        "store_nbr", "city", "type", "total_sales"
    )


DAILY_FRAME_SQL = """
    SELECT date, total_sales, avg_sales, promo_rate, last_value(price IGNORE NULLS) OVER (ORDER BY date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dcoilwtico, transactions
    FROM (SELECT date, SUM(unit_sales) AS total_sales, AVG(unit_sales) AS avg_sales,
                 AVG(CASE WHEN onpromotion = 'True' THEN 1.0::DOUBLE ELSE 0 END) AS promo_rate FROM train GROUP BY date)
    LEFT JOIN (SELECT date, COALESCE(last_value(dcoilwtico IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 first_value(dcoilwtico IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM oil) USING (date)
    LEFT JOIN (SELECT date, CAST(SUM(transactions) AS BIGINT) AS transactions FROM transactions GROUP BY date) USING (date)
"""


def daily_frame(fx):
    daily = fx.train.groupBy("date").agg(
        F.sum("unit_sales").alias("total_sales"),
        F.avg("unit_sales").alias("avg_sales"),
        F.avg(sc.text_to_boolean(F.col("onpromotion")).cast("double")).alias("promo_rate"),
    )
    joined = joins.join_all(
        daily, (fill_both_ways(fx.oil, "dcoilwtico"), ["date"]), (daily_transactions(fx.transactions), ["date"])
    )
    return fill_forward(joined, "dcoilwtico")


@query(
    "j11_daily_frame",
    "SELECT date, total_sales, transactions, CAST(avg_sales AS FLOAT) AS avg_sales, CAST(promo_rate AS FLOAT) AS promo_rate, "
    "CAST(dcoilwtico AS FLOAT) AS dcoilwtico FROM (" + DAILY_FRAME_SQL + ")",
)
def three_way(fx):
    return f32(daily_frame(fx), "avg_sales", "promo_rate", "dcoilwtico")


@query(
    "j12_align_columns",
    """SELECT date, store_nbr, item_nbr, CAST(is_return AS DOUBLE) AS is_return, CAST(0 AS DOUBLE) AS not_there,
              CAST(transactions AS DOUBLE) AS transactions FROM clean""",
)
def align(fx):
    return joins.align_columns(fx.clean, ["is_return", "not_there", "transactions"], keep=KEY)


# Sorts, limits, sets


@query("t01_sorted_write", "SELECT store_nbr, item_nbr, date, unit_sales FROM train")
def sorted_write(fx):
    from larder.session import scratch_path
    from larder.sources.writers import write_sorted

    path = write_sorted(fx.train.select("store_nbr", "item_nbr", "date", "unit_sales"), scratch_path(fx.spark, "sorted"))
    return fx.spark.read.parquet(path)


@query(
    "t02_top_and_bottom",
    """(SELECT 'top' AS label, item_nbr, SUM(unit_sales) AS total FROM train GROUP BY item_nbr ORDER BY total DESC, item_nbr LIMIT 5)
       UNION ALL (SELECT 'bottom', item_nbr, SUM(unit_sales) AS total FROM train GROUP BY item_nbr ORDER BY total, item_nbr LIMIT 5)""",
)
def top_and_bottom(fx):
    totals = fx.train.groupBy("item_nbr").agg(F.sum("unit_sales").alias("total"))
    return ranking.tagged_union(
        {
            "top": ranking.top_rows(totals, "total", 5, ("item_nbr",)),
            "bottom": ranking.top_rows(totals, "total", 5, ("item_nbr",), descending=False),
        }
    ).select("label", "item_nbr", "total")


@query(
    "t03_top_stores",
    """SELECT store_nbr, CAST(total AS FLOAT) AS total FROM (SELECT store_nbr, SUM(forecast_sales) AS total FROM fc GROUP BY 1
       ORDER BY total DESC, store_nbr LIMIT 10)""",
)
def top_stores(fx):
    totals = fx.forecast.groupBy("store_nbr").agg(F.sum("forecast_sales").alias("total"))
    return f32(ranking.top_rows(totals, "total", 10, ("store_nbr",)), "total")


@query(
    "t07_top_categories",
    """SELECT family, CAST(total_demand AS FLOAT) AS total_demand FROM (SELECT family, SUM(forecast_sales) AS total_demand FROM fc GROUP BY 1
       ORDER BY 2 DESC, family LIMIT 7)""",
)
def top_categories(fx):
    from larder.operators.inventory import category_totals

    return f32(ranking.top_rows(category_totals(fx.forecast), "total_demand", 7, ("family",)), "total_demand")


@query(
    "u01_concat",
    "SELECT date, transactions, NULL::DOUBLE AS dcoilwtico FROM transactions UNION ALL SELECT date, NULL, dcoilwtico FROM oil",
)
def concat(fx):
    return ranking.concat_frames([fx.transactions.drop("store_nbr"), fx.oil])


@query(
    "u02_tagged_union",
    "SELECT 'sales' AS label, date FROM (SELECT DISTINCT date FROM train) UNION ALL SELECT 'price', date FROM oil",
)
def tagged(fx):
    return ranking.tagged_union({"sales": fx.train.select("date").distinct(), "price": fx.oil.select("date")})


@query("u03_distinct_keys", "SELECT DISTINCT store_nbr, item_nbr FROM train")
def keys(fx):
    return ranking.distinct_keys(fx.train, "store_nbr", "item_nbr")


# Scalar functions

DAYS = "(SELECT DISTINCT date FROM train)"


def days(fx):
    return fx.train.select("date").distinct()


@query(
    "f01_date_parts",
    f"""SELECT date, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day,
        CAST(quarter(date) AS INT) AS quarter, CAST(dayofyear(date) AS INT) AS day_of_year FROM {DAYS}""",
)
def parts(fx):
    return cal.date_parts(days(fx)).select("date", "year", "month", "day", "quarter", "day_of_year")


@query("f02_day_of_week", f"SELECT date, CAST(dayofweek(date) AS INT) AS day_of_week FROM {DAYS}")
def dow(fx):
    return days(fx).withColumn("day_of_week", cal.day_of_week(F.col("date")))


@query("f03_iso_week", f"SELECT date, CAST(weekofyear(date) AS INT) AS week_of_year FROM {DAYS}")
def week(fx):
    return cal.date_parts(days(fx)).select("date", "week_of_year")


@query("f04_weekend", f"SELECT date, CASE WHEN dayofweek(date) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend FROM {DAYS}")
def weekend(fx):
    return days(fx).withColumn("is_weekend", cal.is_weekend(F.col("date")))


@query(
    "f05_cyclic",
    f"""SELECT date, CAST(SIN(2.0::DOUBLE * 3.14159265::DOUBLE * month(date) / 12) AS FLOAT) AS sin_month,
        CAST(COS(2.0::DOUBLE * 3.14159265::DOUBLE * month(date) / 12) AS FLOAT) AS cos_month,
        CAST(SIN(2.0::DOUBLE * 3.14159265::DOUBLE * dayofweek(date) / 7) AS FLOAT) AS sin_dow,
        CAST(COS(2.0::DOUBLE * 3.14159265::DOUBLE * dayofweek(date) / 7) AS FLOAT) AS cos_dow FROM {DAYS}""",
)
def cyclic(fx):
    names = ("sin_month", "cos_month", "sin_dow", "cos_dow")
    return f32(cal.date_parts(days(fx)).select("date", *names), *names)


@query("f06_payday", f"SELECT date, CASE WHEN day(date) = 15 OR date = last_day(date) THEN 1 ELSE 0 END AS is_payday FROM {DAYS}")
def payday(fx):
    return days(fx).withColumn("is_payday", cal.is_payday(F.col("date")))


@query(
    "f07_event_window",
    f"SELECT date, CASE WHEN date BETWEEN DATE '1998-04-16' AND DATE '1998-05-16' THEN 1 ELSE 0 END AS in_window FROM {DAYS}",
)
def window_flag(fx):
    return days(fx).withColumn("in_window", cal.in_event_window(F.col("date"), EVENT_WINDOW))


@query(
    "f08_date_labels",
    f"""SELECT date, strftime(date, '%A') AS weekday, strftime(date, '%Y-%m') AS year_month, strftime(date, '%m-%d') AS month_day,
        strftime(date, '%Y-%m-%d') AS iso FROM {DAYS}""",
)
def labels(fx):
    d = F.col("date")
    return days(fx).select(
        d, cal.weekday_name(d).alias("weekday"), cal.year_month(d).alias("year_month"),
        cal.month_day(d).alias("month_day"), cal.iso_date(d).alias("iso"),
    )


@query(
    "f09_log_target",
    """SELECT unit_sales, CAST(ln(1 + GREATEST(unit_sales, 0)) AS FLOAT) AS logged,
              CAST(exp(ln(1 + GREATEST(unit_sales, 0))) - 1 AS FLOAT) AS restored FROM (SELECT DISTINCT unit_sales FROM train)""",
)
def logs(fx):
    out = fx.train.select("unit_sales").distinct().withColumn("logged", sc.log_target(F.col("unit_sales")))
    return f32(out.withColumn("restored", sc.unlog_prediction(F.col("logged"))), "logged", "restored")


@query(
    "f10_rounding",
    """SELECT unit_sales, CAST(CEIL(unit_sales / 7) AS BIGINT) AS up, CAST(SQRT(ABS(unit_sales)) AS FLOAT) AS root,
              ROUND(unit_sales / 8, 2) AS rounded, ABS(unit_sales) AS size, GREATEST(unit_sales, 0) AS floored
       FROM (SELECT DISTINCT unit_sales FROM train)""",
)
def rounding(fx):
    v = F.col("unit_sales")
    return fx.train.select("unit_sales").distinct().select(
        v, F.ceil(v / 7).alias("up"), F.sqrt(F.abs(v)).cast("float").alias("root"), F.round(v / 8, 2).alias("rounded"),
        F.abs(v).alias("size"), F.greatest(v, F.lit(0.0)).alias("floored"),
    )


@query(
    "f11_sales_per_transaction",
    """SELECT date, store_nbr, item_nbr, unit_sales / (COALESCE(transactions, 0) + 1) AS sales_per_transaction
       FROM train LEFT JOIN transactions USING (date, store_nbr)""",
)
def per_transaction(fx):
    joined = joins.join_on(fx.train, fx.transactions, ["date", "store_nbr"])
    return joined.select(
        *KEY, sc.sales_per_transaction(F.col("unit_sales"), F.coalesce("transactions", F.lit(0))).alias("sales_per_transaction")
    )


INTERACTIONS = ("sales_to_roll7_ratio", "sales_to_roll28_ratio", "promo_sales_interaction", "oil_sales_interaction")


@query(
    "f12_interactions",
    """SELECT date, store_nbr, item_nbr, CAST(sales_lag_1 / (sales_roll_mean_7 + 1e-4::DOUBLE) AS FLOAT) AS sales_to_roll7_ratio,
              CAST(sales_lag_1 / (sales_roll_mean_28 + 1e-4::DOUBLE) AS FLOAT) AS sales_to_roll28_ratio,
              CAST(CAST(onpromotion AS INT) * sales_roll_mean_7 AS FLOAT) AS promo_sales_interaction,
              CAST(dcoilwtico * sales_roll_mean_28 AS FLOAT) AS oil_sales_interaction FROM rolled""",
)
def interaction(fx):
    out = W.rolling(sales_lags(fx.clean), "mean", (7, 28), prefix="sales_roll_mean")
    return f32(interactions(out).select(*KEY, *INTERACTIONS), *INTERACTIONS)


@query(
    "f13_first_number",
    """SELECT p_partkey, COALESCE(TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT), 103520) AS number,
              COALESCE(TRY_CAST(regexp_extract(p_type, '([0-9]+)', 1) AS BIGINT), 103520) AS fallback FROM part""",
)
def numbers(fx):
    return fx.raw("part").select(
        "p_partkey", sc.first_number(F.col("p_brand"), 103520).alias("number"), sc.first_number(F.col("p_type"), 103520).alias("fallback")
    )


@query(
    "f14_to_number",
    """SELECT event_id, COALESCE(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), 10) AS number FROM events""",
)
def coerced(fx):
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return fx.raw("events").select("event_id", sc.to_number(text, 10).alias("number"))


@query(
    "f15_text_to_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders""",
)
def text_dates(fx):
    """Dates written in the accepted layouts in turn, and some that are none."""
    turn = F.col("o_orderkey") % 7
    text = F.when(turn == 0, "soon").when(turn == 1, F.col("o_orderdate").cast("string"))
    for i, layout in enumerate(("yyyy/MM/dd", "M/d/yyyy", "dd.MM.yyyy", "yyyyMMdd", "d MMM yyyy"), 2):
        text = text.when(turn == i, F.date_format("o_orderdate", layout))
    return fx.raw("orders").select("o_orderkey", sc.to_date(text).alias("date"))


@query(
    "j07_densified_series",
    """WITH s AS (SELECT store_nbr, item_nbr, CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM clean GROUP BY 1, 2)
       SELECT store_nbr, item_nbr, COUNT(*) AS n_days, COUNT(*) FILTER (WHERE COALESCE(unit_sales, 0) = 0) AS zero_days,
              CAST(AVG(COALESCE(unit_sales, 0)) AS FLOAT) AS mean_sales FROM s LEFT JOIN clean USING (store_nbr, item_nbr, date) GROUP BY 1, 2""",
)
def densified(fx):
    per_series = cl.densify(fx.clean).groupBy("store_nbr", "item_nbr").agg(
        F.count("*").alias("n_days"), F.count(F.when(F.col("unit_sales") == 0, 1)).alias("zero_days"), F.avg("unit_sales").alias("mean_sales")
    )
    return f32(per_series, "mean_sales")


@query(
    "f15_numbered_days",
    """SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, COUNT(DISTINCT o_orderkey) AS n_days, DATE '2017-08-01' AS first_day,
              DATE '2017-08-01' + CAST(COUNT(*) - 1 AS INT) AS last_day FROM orders""",
)
def numbered(fx):
    from larder.plans.upload import number_days

    return number_days(fx.raw("orders").select("o_orderkey"), ["o_orderkey"]).agg(
        F.count("*").alias("n_rows"), F.count_distinct("date").alias("n_days"),
        F.min("date").alias("first_day"), F.max("date").alias("last_day"),
    )


@query(
    "f16_labels",
    """SELECT p_partkey, lower(trim(replace(concat(' "', p_name, '" '), '"', ''))) AS header, concat('Store #', p_size) AS store, concat('SKU-', p_partkey) AS sku FROM part""",
)
def text_labels(fx):
    quoted = F.concat(F.lit(' "'), F.col("p_name"), F.lit('" '))
    return fx.raw("part").select(
        "p_partkey", sc.clean_header(quoted).alias("header"), sc.store_label(F.col("p_size")).alias("store"), sc.sku_label(F.col("p_partkey")).alias("sku")
    )


@query(
    "f17_replace_non_finite",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 4 WHEN l_discount = 0 THEN 1.5::DOUBLE ELSE l_quantity END AS value FROM lineitem""",
)
def replaced(fx):
    value = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return fx.raw("lineitem").select("l_orderkey", "l_linenumber", sc.replace_non_finite(value, nan=1.5, posinf=4.0).alias("value"))


@query(
    "f18_error_columns",
    """SELECT date, store_nbr, item_nbr, CAST(ABS(actual_sales - forecast_sales) AS FLOAT) AS abs_error,
              CAST(CASE WHEN actual_sales > 0 THEN ABS(actual_sales - forecast_sales) / actual_sales * 100 ELSE 0 END AS FLOAT) AS pct_error FROM fc""",
)
def errors(fx):
    return f32(evaluation.with_errors(fx.forecast).select(*KEY, "abs_error", "pct_error"), "abs_error", "pct_error")
