"""Forecast horizon, replenishment and procurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import inventory as inv
from larder.plans.upload import prepare_upload, run_upload, unreadable_dates, with_history
from larder.registry.base import f32, query
from larder.registry.relational_queries import UPLOAD_SQL, upload_view

SKU = ("store_nbr", "item_nbr")
LEVELS = ("safety_stock", "reorder_point", "target_stock_level")


def demand_query(name, variant, daily, deviation):
    sql = f"""WITH g AS (SELECT store_nbr, item_nbr, CAST(SUM(CAST(ROUND(forecast_sales * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS t, AVG(forecast_sales) AS m, STDDEV_SAMP(forecast_sales) AS s FROM fc GROUP BY 1, 2)
              SELECT store_nbr, item_nbr, CAST(t AS FLOAT) AS total_forecast_16d, CAST({daily} AS FLOAT) AS daily_avg_demand,
                     CAST({deviation} AS FLOAT) AS demand_std FROM g"""

    @query(name, sql)
    def run(fx):
        out = inv.horizon_demand(fx.forecast, variant)
        return f32(out, "total_forecast_16d", "daily_avg_demand", "demand_std")


demand_query("i08_demand_mean", "mean", "m", "COALESCE(s, 0)")
demand_query("i09_demand_per_horizon", "per_horizon", "GREATEST(0.5, t / 16)", "COALESCE(s, 0.25 * t / 16)")
demand_query("i10_demand_flat", "flat", "GREATEST(0.5, t / 16)", "0.25 * GREATEST(0.5, t / 16)")
demand_query("i11_deviation_floor", "service", "m", "GREATEST(0.1, COALESCE(s, 0))")


@query(
    "a39_sku_horizon",
    """SELECT store_nbr, item_nbr, CAST(total_forecast_16d AS FLOAT) AS total_forecast_16d, CAST(daily_avg_demand AS FLOAT) AS daily_avg_demand,
              CAST(demand_std AS FLOAT) AS demand_std, CAST(actual_sales_16d AS FLOAT) AS actual_sales_16d FROM demand""",
)
def horizon(fx):
    out = inv.horizon_demand(fx.forecast, extra=(F.sum("actual_sales").alias("actual_sales_16d"),))
    return f32(out, "total_forecast_16d", "daily_avg_demand", "demand_std", "actual_sales_16d")


@query("i01_safety_stock", "SELECT store_nbr, item_nbr, safety_stock FROM levels")
def safety(fx):
    return fx.levels.select(*SKU, "safety_stock")


@query("i02_reorder_point", "SELECT store_nbr, item_nbr, reorder_point FROM levels")
def point(fx):
    return fx.levels.select(*SKU, "reorder_point")


@query("i03_target_level", "SELECT store_nbr, item_nbr, target_stock_level FROM levels")
def target(fx):
    return fx.levels.select(*SKU, "target_stock_level")


@query("i04_order_quantity", "SELECT store_nbr, item_nbr, current_stock, recommended_order_qty FROM inv")
def quantity(fx):
    return fx.inventory.select(*SKU, "current_stock", "recommended_order_qty")


@query("i05_status", "SELECT store_nbr, item_nbr, alert_status FROM inv")
def status(fx):
    return fx.inventory.select(*SKU, "alert_status")


@query("i06_priority", "SELECT store_nbr, item_nbr, reorder_priority_score, reorder_priority_score * 100 AS priority_pct FROM inv")
def priority(fx):
    return fx.inventory.select(*SKU, "reorder_priority_score", (F.col("reorder_priority_score") * 100).alias("priority_pct"))


@query(
    "i07_service_level",
    """SELECT store_nbr, item_nbr, level, CAST(CEIL(z * demand_std * SQRT(7)) AS BIGINT) AS safety_stock FROM demand,
       (VALUES (90.0::DOUBLE, 1.28::DOUBLE), (95, 1.65), (97.5, 1.96), (98, 2.05), (99, 2.33), (80, 1.65)) v(level, z)""",
)
def service(fx):
    levels = F.array(*[F.lit(float(x)) for x in (90, 95, 97.5, 98, 99, 80)])
    out = inv.horizon_demand(fx.forecast).withColumn("level", F.explode(levels))
    return out.select(*SKU, "level", inv.safety_stock(inv.service_z(F.col("level")), F.col("demand_std"), 7).alias("safety_stock"))


def stock_records(fx):
    """One stock record per sales row."""
    stock = (F.dayofyear("date") * 3 + F.col("store_nbr") + F.col("item_nbr")).cast("bigint")
    return fx.train.select("date", *SKU, stock.alias("current_stock"))


STOCK_SQL = """SELECT date, store_nbr, item_nbr, CAST(dayofyear(date) * 3 + store_nbr + item_nbr AS BIGINT) AS current_stock FROM train"""


@query("i12_first_stock", f"SELECT store_nbr, item_nbr, arg_min(current_stock, date) AS current_stock FROM ({STOCK_SQL}) GROUP BY 1, 2")
def first_stock(fx):
    return inv.first_stock(stock_records(fx))


CASES = (("calm", 0, 0, 7, 95), ("promotion", 25, 0, 7, 97.5), ("shock", 0, 60, 10, 99), ("both", 40, 100, 14, 90))


@query(
    "i13_scenarios",
    """WITH c(scenario, lift, shock, lead_days, service_level, z) AS (VALUES ('calm', 0.0::DOUBLE, 0.0::DOUBLE, 7, 95.0::DOUBLE, 1.65::DOUBLE), ('promotion', 25, 0, 7, 97.5, 1.96),
              ('shock', 0, 60, 10, 99, 2.33), ('both', 40, 100, 14, 90, 1.28)),
            a AS (SELECT *, daily_avg_demand * (1 + lift / 100) AS adj FROM demand, c),
            d AS (SELECT store_nbr, item_nbr, scenario, STDDEV_POP(CASE WHEN day BETWEEN 8 AND 10 THEN adj * (1 + shock / 100) ELSE adj END) AS sd
                  FROM a, (SELECT unnest(generate_series(1, 16)) AS day) GROUP BY 1, 2, 3),
            s AS (SELECT a.*, CAST(CEIL(ROUND(z * sd * SQRT(lead_days), 9)) AS BIGINT) AS scenario_safety, CAST(CEIL(1.65::DOUBLE * (daily_avg_demand * 0.25) * SQRT(7)) AS BIGINT) AS base_safety
                  FROM a JOIN d USING (store_nbr, item_nbr, scenario)),
            r AS (SELECT *, CAST(CEIL(adj * lead_days + scenario_safety) AS BIGINT) AS scenario_reorder, CAST(CEIL(daily_avg_demand * 7 + base_safety) AS BIGINT) AS base_reorder FROM s)
       SELECT store_nbr, item_nbr, scenario, lead_days, service_level, CAST(adj AS FLOAT) AS adjusted_demand, scenario_safety, scenario_reorder,
              CAST(CEIL(scenario_reorder + adj * 7) AS BIGINT) AS scenario_target, base_safety, base_reorder,
              CAST(CEIL(base_reorder + daily_avg_demand * 7) AS BIGINT) AS base_target FROM r""",
)
def scenarios(fx):
    out = inv.scenarios(inv.horizon_demand(fx.forecast), CASES)
    return f32(out.drop("daily_avg_demand", "demand_std"), "adjusted_demand")


@query(
    "i14_purchase_orders",
    """SELECT store_nbr, item_nbr, concat('Store #', store_nbr) AS store, concat('SKU-', item_nbr) AS sku, recommended_order_qty AS order_qty
       FROM inv WHERE alert_status = 'CRITICAL_UNDERSTOCK'""",
)
def orders(fx):
    return inv.purchase_orders(fx.inventory)


@query(
    "i14_purchase_order_total",
    """SELECT COUNT(*) AS n_orders, CAST(COALESCE(SUM(recommended_order_qty), 0) AS BIGINT) AS total_units FROM inv WHERE alert_status = 'CRITICAL_UNDERSTOCK'""",
)
def order_total(fx):
    return inv.purchase_order_total(fx.inventory)


@query(
    "i15_threshold_kpis",
    f"""SELECT CAST(SUM(GREATEST(0, 150 - current_stock)) AS BIGINT) AS total_reorder, COUNT(*) FILTER (WHERE current_stock < 50) AS critical_skus,
        COUNT(*) FILTER (WHERE current_stock BETWEEN 50 AND 200) AS optimal_skus, COUNT(*) FILTER (WHERE current_stock > 200) AS overstock_skus FROM ({STOCK_SQL})""",
)
def thresholds(fx):
    return inv.threshold_kpis(stock_records(fx))


UPLOAD_BASE = f"""
    WITH u AS ({UPLOAD_SQL}),
         p AS (SELECT *, ROUND(unit_sales * (1 + onpromotion * 0.35::DOUBLE), 2) AS f FROM u),
         g AS (SELECT store_nbr, item_nbr, CAST(SUM(CAST(ROUND(f * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS t, STDDEV_SAMP(f) AS s, arg_min(current_stock, date) AS current_stock FROM p GROUP BY 1, 2),
         d AS (SELECT *, GREATEST(0.5::DOUBLE, t / 16) AS da, COALESCE(s, t / 16 * 0.25::DOUBLE) AS sd FROM g),
         e AS (SELECT *, CAST(CEIL(1.65::DOUBLE * sd * SQRT(7)) AS BIGINT) AS safety_stock FROM d),
         h AS (SELECT *, CAST(CEIL(da * 7 + safety_stock) AS BIGINT) AS reorder_point FROM e),
         k AS (SELECT *, CAST(CEIL(reorder_point + da * 7) AS BIGINT) AS target_stock_level FROM h),
         x AS (SELECT *, CAST(FLOOR(GREATEST(0, target_stock_level - current_stock)) AS BIGINT) AS recommended_order_qty,
                      CASE WHEN current_stock < reorder_point THEN 'CRITICAL_UNDERSTOCK' WHEN current_stock > target_stock_level THEN 'OVERSTOCK' ELSE 'OPTIMAL_STOCK' END AS alert_status FROM k)
"""


@query(
    "i16_upload_items",
    UPLOAD_BASE
    + """SELECT store_nbr, item_nbr, CAST(t AS FLOAT) AS total_forecast_16d, CAST(da AS FLOAT) AS daily_avg_demand, CAST(sd AS FLOAT) AS demand_std,
                current_stock, safety_stock, reorder_point, target_stock_level, recommended_order_qty, alert_status FROM x""",
)
def upload_items(fx):
    floats = ("total_forecast_16d", "daily_avg_demand", "demand_std")
    return f32(run_upload(upload_view(fx))["items"].drop("family", "reorder_priority_score"), *floats)


@query(
    "i16_upload_kpis",
    UPLOAD_BASE
    + """SELECT CAST(SUM(t) AS FLOAT) AS total_forecast_units, CAST(SUM(recommended_order_qty) AS BIGINT) AS recommended_reorder_qty,
                COUNT(*) FILTER (WHERE alert_status = 'CRITICAL_UNDERSTOCK') AS critical_understock_skus,
                COUNT(*) FILTER (WHERE alert_status = 'OPTIMAL_STOCK') AS optimal_stock_skus FROM x""",
)
def upload_kpis(fx):
    return f32(run_upload(upload_view(fx))["kpis"], "total_forecast_units")


@query("i16_upload_trajectory", UPLOAD_BASE + "SELECT date, CAST(SUM(f) AS FLOAT) AS forecast FROM p GROUP BY date")
def upload_trajectory(fx):
    return f32(run_upload(upload_view(fx))["trajectory"], "forecast")


#: Days of history under an upload, and the window columns that it must give, as SQL over w (a SKU's days in order).
HISTORY_DAYS = 60
_PRIOR = "OVER (w ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
SERIES_SQL = {
    **{f"sales_lag_{n}": f"lag(unit_sales, {n}) OVER w" for n in (1, 2, 3, 7, 14, 21, 28)},
    **{f"promo_lag_{n}": f"lag(onpromotion, {n}) OVER w" for n in (1, 7)},
    **{f"sales_roll_mean_{n}": f"AVG(unit_sales) {_PRIOR.format(n)}" for n in (7, 14, 28, 60)},
    **{f"sales_roll_std_{n}": f"STDDEV_SAMP(unit_sales) {_PRIOR.format(n)}" for n in (7, 28)},
    "sales_roll_min_7": f"MIN(unit_sales) {_PRIOR.format(7)}", "sales_roll_max_7": f"MAX(unit_sales) {_PRIOR.format(7)}",
    "sales_roll_median_14": f"MEDIAN(unit_sales) {_PRIOR.format(14)}",
    "sales_expanding_mean": f"AVG(unit_sales) {_PRIOR.format('UNBOUNDED')}", "sales_expanding_std": f"STDDEV_SAMP(unit_sales) {_PRIOR.format('UNBOUNDED')}",
}
SMOOTHED = {7: "0.75::DOUBLE * a[-1] + 0.25::DOUBLE * x[1]", 14: "(13::DOUBLE / 15) * a[-1] + (2::DOUBLE / 15) * x[1]", 28: "(27::DOUBLE / 29) * a[-1] + (2::DOUBLE / 29) * x[1]"}
KEPT = ("city", "cluster", "family", "dcoilwtico")
_WINDOWED = ", ".join(f"{sql} AS {name}" for name, sql in SERIES_SQL.items())
_CARRIED_SQL = ", ".join(f"last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in KEPT)
_FLOATS = (*SERIES_SQL, *(f"sales_ewma_{n}" for n in SMOOTHED), "sales_to_roll7_ratio", "sales_to_roll28_ratio", "promo_sales_interaction", "oil_sales_interaction")


def upload_days(fx):
    """The days of the horizon as a user would upload them."""
    rows = upload_view(fx)
    return rows.where(F.col("Date_Time").cast("date") >= fx.start)


@query(
    "i16_upload_features",
    f"""WITH u AS (SELECT * FROM ({UPLOAD_SQL}) WHERE date >= (SELECT start FROM horizon)),
            b AS (SELECT store_nbr, item_nbr, MIN(date) AS begins FROM u GROUP BY 1, 2),
            a AS (SELECT date, CAST(store_nbr AS BIGINT) AS store_nbr, CAST(item_nbr AS BIGINT) AS item_nbr, unit_sales, CAST(CAST(onpromotion AS INT) AS DOUBLE) AS onpromotion, {', '.join(KEPT)}, FALSE AS up
                  FROM clean JOIN b USING (store_nbr, item_nbr) WHERE date < begins AND date >= begins - {HISTORY_DAYS}
                  UNION ALL SELECT date, store_nbr, item_nbr, unit_sales, onpromotion, NULL, NULL, NULL, NULL, TRUE FROM u),
            l AS (SELECT store_nbr, item_nbr, list(date ORDER BY date) AS ds, {', '.join(f"list_reduce(list([unit_sales] ORDER BY date), lambda a, x : list_append(a, {e})) AS e{n}" for n, e in SMOOTHED.items())}
                  FROM a GROUP BY 1, 2),
            e AS (SELECT store_nbr, item_nbr, unnest(ds) AS date, {', '.join(f"unnest(e{n}) AS e{n}" for n in SMOOTHED)} FROM l),
            w AS (SELECT date, store_nbr, item_nbr, up, unit_sales, onpromotion, {_WINDOWED}, {', '.join(f"lag(e{n}) OVER w AS sales_ewma_{n}" for n in SMOOTHED)}, {_CARRIED_SQL}
                  FROM a JOIN e USING (store_nbr, item_nbr, date) WINDOW w AS (PARTITION BY store_nbr, item_nbr ORDER BY date)),
            f AS (SELECT *, sales_lag_1 / (sales_roll_mean_7 + 1e-4::DOUBLE) AS sales_to_roll7_ratio, sales_lag_1 / (sales_roll_mean_28 + 1e-4::DOUBLE) AS sales_to_roll28_ratio,
                         onpromotion * sales_roll_mean_7 AS promo_sales_interaction, dcoilwtico * sales_roll_mean_28 AS oil_sales_interaction FROM w WHERE up)
       SELECT date, store_nbr, item_nbr, city, cluster, family, {', '.join(f"CAST(ROUND({c}, 9) AS FLOAT) AS {c}" for c in (*_FLOATS, "dcoilwtico"))} FROM f""",
)
def upload_features(fx):
    """Features of an upload's own series: the horizon as the upload, the clean table as its history."""
    rows = with_history(prepare_upload(upload_days(fx)), fx.written_clean, HISTORY_DAYS)
    return rows.select("date", *SKU, "city", "cluster", "family", *[F.round(c, 9).cast("float").alias(c) for c in (*_FLOATS, "dcoilwtico")])


@query(
    "i16_upload_history_items",
    UPLOAD_BASE.replace(f"({UPLOAD_SQL})", f"(SELECT * FROM ({UPLOAD_SQL}) WHERE date >= (SELECT start FROM horizon))")
    + """SELECT store_nbr, item_nbr, CAST(t AS FLOAT) AS total_forecast_16d, current_stock, reorder_point, target_stock_level, alert_status FROM x""",
)
def upload_history_items(fx):
    """Decisions of an upload with history under the rule, which needs none of it: the rows must be the same."""
    items = run_upload(upload_days(fx), history=fx.written_clean)["items"]
    return f32(items.select(*SKU, "total_forecast_16d", "current_stock", "reorder_point", "target_stock_level", "alert_status"), "total_forecast_16d")


@query(
    "f15_unreadable_dates",
    """SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE item_nbr % 5 = 0) AS unreadable_dates FROM train""",
)
def unreadable(fx):
    text = F.when(F.col("item_nbr") % 5 == 0, F.lit("soon")).when(F.col("item_nbr") % 5 != 1, F.col("date").cast("string"))
    return unreadable_dates(fx.train.select(text.alias(" Timestamp"), "store_nbr", "item_nbr"))


@query(
    "i17_requested_skus",
    """WITH q AS (SELECT DISTINCT store_nbr, item_nbr, (store_nbr * 5 + item_nbr) AS current_stock FROM (SELECT store_nbr, item_nbr FROM train UNION ALL SELECT store_nbr, item_nbr + 100 FROM train)),
            g AS (SELECT store_nbr, item_nbr, GREATEST(0.5::DOUBLE, CAST(SUM(CAST(ROUND(forecast_sales * 10000) AS BIGINT)) AS DOUBLE) / 10000 / 16) AS da FROM fc GROUP BY 1, 2),
            d AS (SELECT q.*, COALESCE(da, 0.5::DOUBLE) AS da, GREATEST(0.1::DOUBLE, COALESCE(da, 0.5::DOUBLE) * 0.25::DOUBLE) AS sd FROM q LEFT JOIN g USING (store_nbr, item_nbr)),
            e AS (SELECT *, CAST(CEIL(1.65::DOUBLE * sd * SQRT(7)) AS BIGINT) AS safety_stock FROM d),
            h AS (SELECT *, CAST(CEIL(da * 7 + safety_stock) AS BIGINT) AS reorder_point FROM e),
            k AS (SELECT *, CAST(CEIL(reorder_point + da * 7) AS BIGINT) AS target_stock_level FROM h)
       SELECT store_nbr, item_nbr, current_stock, safety_stock, reorder_point, target_stock_level, CAST(GREATEST(0, target_stock_level - current_stock) AS BIGINT) AS recommended_order_qty,
              CASE WHEN current_stock < reorder_point THEN 'CRITICAL_UNDERSTOCK' WHEN current_stock > target_stock_level THEN 'OVERSTOCK' ELSE 'OPTIMAL_STOCK' END AS alert_status FROM k""",
)
def requests(fx):
    known = fx.train.select(*SKU).distinct()
    unknown = known.withColumn("item_nbr", F.col("item_nbr") + 100)
    asked = known.union(unknown).withColumn("current_stock", F.col("store_nbr") * 5 + F.col("item_nbr"))
    return inv.replenish_requests(asked, fx.forecast).select(*SKU, "current_stock", *LEVELS, "recommended_order_qty", "alert_status")


@query(
    "replenishment_plan",
    """SELECT store_nbr, item_nbr, CAST(total_forecast_16d AS FLOAT) AS total_forecast_16d, CAST(daily_avg_demand AS FLOAT) AS daily_avg_demand, CAST(demand_std AS FLOAT) AS demand_std,
              CAST(actual_sales_16d AS FLOAT) AS actual_sales_16d, safety_stock, reorder_point, target_stock_level, current_stock, recommended_order_qty, alert_status, reorder_priority_score FROM inv""",
)
def plan(fx):
    return f32(fx.inventory.drop("family"), "total_forecast_16d", "daily_avg_demand", "demand_std", "actual_sales_16d")


QUEUE = "SELECT store_nbr, item_nbr, alert_status, recommended_order_qty, reorder_priority_score FROM inv"
QUEUE_COLUMNS = (*SKU, "alert_status", "recommended_order_qty", "reorder_priority_score")


@query("t04_priority_queue", QUEUE)
def queue(fx):
    return inv.priority_queue(fx.inventory).select(*QUEUE_COLUMNS)


@query(
    "t05_critical_reorders",
    QUEUE + " WHERE alert_status = 'CRITICAL_UNDERSTOCK' ORDER BY reorder_priority_score DESC, store_nbr, item_nbr LIMIT 25",
)
def critical(fx):
    return inv.critical_reorders(fx.inventory, 25).select(*QUEUE_COLUMNS)


DEFICITS = "SELECT store_nbr, item_nbr, reorder_point - current_stock AS deficit_units FROM inv WHERE alert_status = 'CRITICAL_UNDERSTOCK'"


@query("t06_deficits", DEFICITS)
def deficits(fx):
    return inv.deficits(fx.inventory).select(*SKU, "deficit_units")


@query("t06_top_deficits", DEFICITS + " ORDER BY deficit_units DESC, store_nbr, item_nbr LIMIT 15")
def top_deficits(fx):
    return inv.deficits(fx.inventory, 15).select(*SKU, "deficit_units")


@query(
    "a40_trajectory",
    """SELECT date, CAST(SUM(forecast_sales) AS FLOAT) AS forecast_sales, CAST(SUM(actual_sales) AS FLOAT) AS actual_sales,
              CAST(SUM(forecast_sales) * 0.9 AS FLOAT) AS lower_band, CAST(SUM(forecast_sales) * 1.1 AS FLOAT) AS upper_band FROM fc GROUP BY date""",
)
def trajectory(fx):
    return f32(inv.trajectory(fx.forecast), "forecast_sales", "actual_sales", "lower_band", "upper_band")


STATUS_COUNTS = """COUNT(*) FILTER (WHERE alert_status = 'CRITICAL_UNDERSTOCK') AS critical_skus,
    COUNT(*) FILTER (WHERE alert_status = 'OPTIMAL_STOCK') AS optimal_skus, COUNT(*) FILTER (WHERE alert_status = 'OVERSTOCK') AS overstock_skus"""


@query(
    "a41_store_overview",
    f"""SELECT store_nbr, CAST(forecast_16d AS FLOAT) AS forecast_16d, critical_skus, optimal_skus, overstock_skus, city, state, type, cluster
        FROM (SELECT store_nbr, SUM(forecast_sales) AS forecast_16d FROM fc GROUP BY 1) LEFT JOIN (SELECT store_nbr, {STATUS_COUNTS} FROM inv GROUP BY 1) USING (store_nbr)
        LEFT JOIN stores USING (store_nbr)""",
)
def overview(fx):
    return f32(inv.store_overview(fx.forecast, fx.inventory, fx.stores), "forecast_16d")


@query(
    "a42_category_totals",
    """SELECT family, NULL::DATE AS date, CAST(SUM(forecast_sales) AS FLOAT) AS total_demand FROM fc GROUP BY 1
       UNION ALL SELECT family, date, CAST(SUM(forecast_sales) AS FLOAT) FROM fc GROUP BY 1, 2""",
)
def categories(fx):
    both = inv.category_totals(fx.forecast).withColumn("date", F.lit(None).cast("date")).unionByName(
        inv.category_totals(fx.forecast, ("family", "date"))
    )
    return f32(both, "total_demand").select("family", "date", "total_demand")


@query(
    "a43_alert_shares",
    "SELECT alert_status, COUNT(*) AS n_skus, CAST(COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM inv) AS FLOAT) AS share_pct FROM inv GROUP BY 1",
)
def alerts(fx):
    return f32(inv.alert_shares(fx.inventory), "share_pct")


@query(
    "a43_kpis",
    f"""SELECT COUNT(*) AS total_skus, CAST(SUM(total_forecast_16d) AS FLOAT) AS total_forecast_16d,
               CAST(SUM(recommended_order_qty) AS BIGINT) AS total_recommended_reorder, {STATUS_COUNTS} FROM inv""",
)
def kpis(fx):
    return f32(inv.inventory_kpis(fx.inventory), "total_forecast_16d")


@query("a44_category_status", "SELECT family, alert_status, COUNT(*) AS n_skus FROM inv GROUP BY 1, 2")
def category_status(fx):
    return inv.category_status(fx.inventory)


_PROFILE = {"avg_demand": "daily_avg_demand", "avg_safety": "safety_stock", "avg_reorder": "reorder_point", "avg_stock": "current_stock", "avg_order": "recommended_order_qty"}


@query(
    "a45_category_profile",
    "WITH m AS (SELECT family, " + ", ".join(f"AVG({c}) AS {n}" for n, c in _PROFILE.items()) + " FROM inv GROUP BY 1) SELECT family, "
    + ", ".join(
        f"CAST({n} AS FLOAT) AS {n}, CAST(CASE WHEN MAX({n}) OVER () > MIN({n}) OVER () THEN ({n} - MIN({n}) OVER ()) / (MAX({n}) OVER () - MIN({n}) OVER ()) * 100 ELSE 50 END AS FLOAT) AS {n}_scaled"
        for n in _PROFILE
    )
    + " FROM m",
)
def profile(fx):
    return f32(inv.category_profile(fx.inventory), *_PROFILE, *(f"{n}_scaled" for n in _PROFILE))


@query(
    "a46_category_risk",
    """WITH f AS (SELECT family, SUM(total_forecast_16d) AS d, COUNT(*) AS n_skus, COUNT(*) FILTER (WHERE alert_status = 'CRITICAL_UNDERSTOCK') AS c FROM inv GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7)
       SELECT family, CAST(d AS FLOAT) AS total_demand, n_skus, CAST(d / GREATEST(MAX(d) OVER (), 1) * 100 AS FLOAT) AS demand_scaled, CAST(c * 100.0::DOUBLE / n_skus AS FLOAT) AS critical_pct FROM f""",
)
def risk(fx):
    return f32(inv.category_risk(fx.inventory), "total_demand", "demand_scaled", "critical_pct")


@query(
    "a47_category_order_share",
    """SELECT family, CAST(SUM(recommended_order_qty) AS BIGINT) AS order_qty,
              CAST(SUM(recommended_order_qty) * 100.0::DOUBLE / (SELECT SUM(recommended_order_qty) FROM inv) AS FLOAT) AS share_pct FROM inv GROUP BY 1""",
)
def order_share(fx):
    return f32(inv.category_order_share(fx.inventory), "share_pct")


@query(
    "a48_procurement_funnel",
    """SELECT 'monitored' AS stage, COUNT(*) AS n_skus FROM inv UNION ALL SELECT 'needs_attention', COUNT(*) FROM inv WHERE alert_status <> 'OPTIMAL_STOCK'
       UNION ALL SELECT 'critical', COUNT(*) FROM inv WHERE alert_status = 'CRITICAL_UNDERSTOCK'""",
)
def funnel(fx):
    return inv.procurement_funnel(fx.inventory)


@query(
    "a49_box_summary",
    """WITH f AS (SELECT family, quantile_cont(reorder_point, 0.25) AS q25, quantile_cont(reorder_point, 0.5) AS median, quantile_cont(reorder_point, 0.75) AS q75 FROM inv GROUP BY 1),
            j AS (SELECT f.*, CAST(reorder_point AS DOUBLE) AS v, reorder_point BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM inv JOIN f USING (family))
       SELECT family, MIN(v) FILTER (WHERE inside) AS low, ANY_VALUE(q25) AS q25, ANY_VALUE(median) AS median, ANY_VALUE(q75) AS q75,
              MAX(v) FILTER (WHERE inside) AS high, COUNT(*) FILTER (WHERE NOT inside) AS n_outliers FROM j GROUP BY 1""",
)
def box(fx):
    return inv.box_summary(fx.inventory, "reorder_point", "family")


@query(
    "a50_forecast_summary",
    """WITH d AS (SELECT date, SUM(forecast_sales) AS f FROM fc GROUP BY 1)
       SELECT CAST(SUM(f) AS FLOAT) AS total, CAST(AVG(f) AS FLOAT) AS mean_day, arg_max(date, f) AS peak_date, CAST(MAX(f) AS FLOAT) AS peak_value FROM d""",
)
def forecast_summary(fx):
    return f32(inv.forecast_summary(inv.trajectory(fx.forecast)), "total", "mean_day", "peak_value")
