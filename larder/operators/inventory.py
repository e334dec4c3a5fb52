"""Replenishment: safety stock, reorder point, target level, order quantity, status, priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.scalars import percent, sku_label, store_label
from larder.operators.quantiles import exact_quantiles
from larder.operators.windows import max_scale, minmax_scale, share_of_total

CRITICAL, OPTIMAL, OVER = "CRITICAL_UNDERSTOCK", "OPTIMAL_STOCK", "OVERSTOCK"

# Service level in percent to normal quantile.
SERVICE_Z = {90.0: 1.28, 95.0: 1.65, 97.5: 1.96, 98.0: 2.05, 99.0: 2.33}
DEFAULT_Z = 1.65
HORIZON_DAYS = 16


def service_z(level_pct: Column) -> Column:
    """Z of a service level in percent; unknown levels count as 95."""
    table = F.create_map(*[F.lit(x) for pair in SERVICE_Z.items() for x in pair])
    return F.coalesce(F.try_element_at(table, level_pct.cast("double")), F.lit(DEFAULT_Z))


def safety_stock(z, deviation: Column, lead_days) -> Column:
    return F.ceil(_c(z) * deviation * F.sqrt(_c(lead_days).cast("double"))).cast("bigint")


def reorder_point(demand: Column, safety: Column, lead_days) -> Column:
    return F.ceil(demand * _c(lead_days) + safety).cast("bigint")


def target_level(point: Column, demand: Column, review_days) -> Column:
    return F.ceil(point + demand * _c(review_days)).cast("bigint")


def order_quantity(target: Column, stock: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), target - stock)).cast("bigint")


def stock_status(stock: Column, point: Column, target: Column) -> Column:
    return F.when(stock < point, CRITICAL).when(stock > target, OVER).otherwise(OPTIMAL)


def priority(stock: Column, point: Column, status: Column) -> Column:
    """Missing share of the reorder point, 0 unless critical."""
    share = (point - stock) / F.greatest(F.lit(1), point)
    return F.when(status == CRITICAL, share).otherwise(F.lit(0.0))


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def horizon_demand(
    forecast: DataFrame, variant="mean", keys=("store_nbr", "item_nbr"), value="forecast_sales", extra=()
) -> DataFrame:
    """Demand per SKU over the horizon.

    ``mean``: mean and sample deviation of the rows, null deviation 0.
    ``per_horizon``: sum/16, at least 0.5; deviation of the rows, null is a quarter of the unfloored demand.
    ``flat``: sum/16, at least 0.5; deviation a quarter of the demand.
    ``service``: as ``mean`` with a deviation of at least 0.1.
    """
    # Whole ten-thousandths are summed: the total, and so every later ceiling, does not depend on the order of rows.
    total = forecast.groupBy(*keys).agg(
        F.expr(f"sum(CAST(round(`{value}` * 10000) AS BIGINT)) / 10000D AS total_forecast_16d"),
        F.count(value).alias("_n"),
        F.stddev_samp(value).alias("_std"),
        *extra,
    )
    mean = F.col("total_forecast_16d") / F.col("_n")
    daily = F.col("total_forecast_16d") / HORIZON_DAYS
    floored = F.greatest(F.lit(0.5), daily)
    choices = {
        "mean": (mean, F.coalesce("_std", F.lit(0.0))),
        "per_horizon": (floored, F.coalesce(F.col("_std"), daily * 0.25)),
        "flat": (floored, floored * 0.25),
        "service": (mean, F.greatest(F.lit(0.1), F.coalesce("_std", F.lit(0.0)))),
    }
    average, deviation = choices[variant]
    return total.withColumns({"daily_avg_demand": average, "demand_std": deviation}).drop("_n", "_std")


def stock_levels(demand: DataFrame, z=DEFAULT_Z, lead_days=7, review_days=7) -> DataFrame:
    """Safety stock, reorder point and target level from ``daily_avg_demand`` and ``demand_std``."""
    out = demand.withColumn("safety_stock", safety_stock(z, F.col("demand_std"), lead_days))
    out = out.withColumn("reorder_point", reorder_point(F.col("daily_avg_demand"), F.col("safety_stock"), lead_days))
    return out.withColumn(
        "target_stock_level", target_level(F.col("reorder_point"), F.col("daily_avg_demand"), review_days)
    )


def stock_decisions(levels: DataFrame) -> DataFrame:
    """Order quantity, status and priority against ``current_stock``."""
    stock, point, target = F.col("current_stock"), F.col("reorder_point"), F.col("target_stock_level")
    out = levels.withColumns(
        {"recommended_order_qty": order_quantity(target, stock), "alert_status": stock_status(stock, point, target)}
    )
    return out.withColumn("reorder_priority_score", priority(stock, point, F.col("alert_status")))


def replenish(
    demand: DataFrame, stock: DataFrame, z=DEFAULT_Z, lead_days=7, review_days=7, keys=("store_nbr", "item_nbr")
) -> DataFrame:
    """Levels and decisions; SKUs without a stock record count as empty."""
    levels = stock_levels(demand, z, lead_days, review_days)
    joined = levels.join(stock.select(*keys, "current_stock"), list(keys), "left")
    return stock_decisions(joined.withColumn("current_stock", F.coalesce("current_stock", F.lit(0))))


def first_stock(records: DataFrame, keys=("store_nbr", "item_nbr"), order="date") -> DataFrame:
    """Stock on the first day of each SKU; two records of one day give the smaller."""
    return records.groupBy(*keys).agg(
        F.min_by("current_stock", F.struct(order, "current_stock")).alias("current_stock")
    )


def priority_queue(inventory: DataFrame) -> DataFrame:
    return inventory.orderBy(F.desc("reorder_priority_score"), "store_nbr", "item_nbr")


def critical_reorders(inventory: DataFrame, n=10) -> DataFrame:
    """The most urgent critical SKUs, 1 to 100 of them."""
    if not 1 <= n <= 100:
        raise ValueError("n must be between 1 and 100")
    return priority_queue(inventory.where(F.col("alert_status") == CRITICAL)).limit(n)


def deficits(inventory: DataFrame, n=None) -> DataFrame:
    """Critical SKUs by missing units."""
    out = (
        inventory.where(F.col("alert_status") == CRITICAL)
        .withColumn("deficit_units", F.col("reorder_point") - F.col("current_stock"))
        .orderBy(F.desc("deficit_units"), "store_nbr", "item_nbr")
    )
    return out if n is None else out.limit(n)


def purchase_orders(inventory: DataFrame) -> DataFrame:
    return inventory.where(F.col("alert_status") == CRITICAL).select(
        "store_nbr", "item_nbr",
        store_label(F.col("store_nbr")).alias("store"),
        sku_label(F.col("item_nbr")).alias("sku"),
        F.col("recommended_order_qty").alias("order_qty"),
    )


def purchase_order_total(inventory: DataFrame) -> DataFrame:
    return purchase_orders(inventory).agg(
        F.count("*").alias("n_orders"), F.coalesce(F.sum("order_qty"), F.lit(0)).alias("total_units")
    )


def filter_inventory(inventory: DataFrame, statuses=None, families=None) -> DataFrame:
    if statuses is not None:
        inventory = inventory.where(F.col("alert_status").isin(list(statuses)))
    if families is not None:
        inventory = inventory.where(F.col("family").isin(list(families)))
    return inventory


def _count(status):
    return F.count(F.when(F.col("alert_status") == status, 1))


def status_counts():
    return (
        _count(CRITICAL).alias("critical_skus"), _count(OPTIMAL).alias("optimal_skus"), _count(OVER).alias("overstock_skus")
    )


def alert_shares(inventory: DataFrame) -> DataFrame:
    return share_of_total(inventory.groupBy("alert_status").agg(F.count("*").alias("n_skus")), "n_skus")


def inventory_kpis(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count("*").alias("total_skus"),
        F.sum("total_forecast_16d").alias("total_forecast_16d"),
        F.sum("recommended_order_qty").alias("total_recommended_reorder"),
        *status_counts(),
    )


def trajectory(forecast: DataFrame, band_pct=10.0) -> DataFrame:
    """Forecast and actual totals per date with a band of ``band_pct`` percent."""
    daily = forecast.groupBy("date").agg(
        F.sum("forecast_sales").alias("forecast_sales"), F.sum("actual_sales").alias("actual_sales")
    )
    return with_band(daily, "forecast_sales", band_pct)


def with_band(df: DataFrame, value, band_pct=10.0) -> DataFrame:
    """A fixed percentage band (not a confidence interval), never below 0."""
    return df.withColumns(
        {
            "lower_band": F.greatest(F.lit(0.0), F.col(value) * (1 - band_pct / 100)),
            "upper_band": F.col(value) * (1 + band_pct / 100),
        }
    )


def forecast_summary(daily: DataFrame, value="forecast_sales") -> DataFrame:
    """Total, mean day and peak day (the earlier one on ties)."""
    peak = F.max_by(F.struct("date", value), F.struct(F.col(value), -F.unix_date("date")))
    return daily.agg(F.sum(value).alias("total"), F.avg(value).alias("mean_day"), peak.alias("_peak")).select(
        "total", "mean_day", F.col("_peak.date").alias("peak_date"), F.col(f"_peak.{value}").alias("peak_value")
    )


def store_overview(forecast: DataFrame, inventory: DataFrame, stores: DataFrame) -> DataFrame:
    """Per store: forecast total and SKU counts by status, with the store's attributes."""
    totals = forecast.groupBy("store_nbr").agg(F.sum("forecast_sales").alias("forecast_16d"))
    counts = inventory.groupBy("store_nbr").agg(*status_counts())
    return totals.join(counts, "store_nbr", "left").join(
        stores.select("store_nbr", "city", "state", "type", "cluster"), "store_nbr", "left"
    )


def category_totals(forecast: DataFrame, by=("family",), value="forecast_sales") -> DataFrame:
    return forecast.groupBy(*by).agg(F.sum(value).alias("total_demand"))


def category_status(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("family", "alert_status").agg(F.count("*").alias("n_skus"))


def category_profile(inventory: DataFrame) -> DataFrame:
    """Mean of five measures per category, each scaled to 0..100 over the categories."""
    measures = {
        "avg_demand": "daily_avg_demand", "avg_safety": "safety_stock", "avg_reorder": "reorder_point",
        "avg_stock": "current_stock", "avg_order": "recommended_order_qty",
    }
    means = inventory.groupBy("family").agg(*[F.avg(c).alias(name) for name, c in measures.items()])
    return minmax_scale(means, list(measures))


def category_risk(inventory: DataFrame, top=7) -> DataFrame:
    """The largest categories: percent critical, demand in percent of the largest."""
    per_family = inventory.groupBy("family").agg(
        F.sum("total_forecast_16d").alias("total_demand"), F.count("*").alias("n_skus"), _count(CRITICAL).alias("_critical")
    )
    largest = per_family.orderBy(F.desc("total_demand"), "family").limit(top)
    scaled = max_scale(largest, "total_demand", alias="demand_scaled")
    return scaled.withColumn("critical_pct", percent(F.col("_critical"), F.col("n_skus"))).drop("_critical")


def category_order_share(inventory: DataFrame) -> DataFrame:
    totals = inventory.groupBy("family").agg(F.sum("recommended_order_qty").alias("order_qty"))
    return share_of_total(totals, "order_qty")


def procurement_funnel(inventory: DataFrame) -> DataFrame:
    row = inventory.agg(
        F.count("*").alias("monitored"),
        F.count(F.when(F.col("alert_status") != OPTIMAL, 1)).alias("needs_attention"),
        _count(CRITICAL).alias("critical"),
    )
    return row.unpivot([], ["monitored", "needs_attention", "critical"], "stage", "n_skus")


def box_summary(df: DataFrame, value, by) -> DataFrame:
    """Quartiles, the extreme rows inside 1.5 interquartile ranges, and the number of rows outside."""
    quartiles = exact_quantiles(df, value, (0.25, 0.5, 0.75), by=(by,), names=("q25", "median", "q75"))
    fence = quartiles.withColumn("_reach", (F.col("q75") - F.col("q25")) * 1.5)
    joined = df.select(by, F.col(value).cast("double").alias("_v")).join(fence, by)
    inside = F.col("_v").between(F.col("q25") - F.col("_reach"), F.col("q75") + F.col("_reach"))
    return joined.groupBy(by).agg(
        F.min(F.when(inside, F.col("_v"))).alias("low"),
        F.first("q25").alias("q25"),
        F.first("median").alias("median"),
        F.first("q75").alias("q75"),
        F.max(F.when(inside, F.col("_v"))).alias("high"),
        F.count(F.when(~inside, 1)).alias("n_outliers"),
    )


def threshold_kpis(stock: DataFrame, target=150, low=50, high=200) -> DataFrame:
    """KPIs from stock alone. The three stock limits."""
    s = F.col("current_stock")
    return stock.agg(
        F.sum(F.greatest(F.lit(0), F.lit(target) - s)).alias("total_reorder"),
        F.count(F.when(s < low, 1)).alias("critical_skus"),
        F.count(F.when(s.between(low, high), 1)).alias("optimal_skus"),
        F.count(F.when(s > high, 1)).alias("overstock_skus"),
    )


def scenarios(demand: DataFrame, cases, horizon=HORIZON_DAYS) -> DataFrame:
    """Stock levels per SKU and scenario next to the baseline.

    ``cases``: (name, promo lift %, demand shock %, lead days, service level %). The shock hits the
    three middle days. A SKU's row fans out to the short list of cases; nothing is joined.
    """
    case = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"), F.lit(float(lift)).alias("lift"), F.lit(float(shock)).alias("shock"),
                F.lit(int(lead)).alias("lead_days"), F.lit(float(level)).alias("service_level"),
            )
            for name, lift, shock, lead, level in cases
        ]
    )
    base = F.col("daily_avg_demand")
    out = demand.select("store_nbr", "item_nbr", "daily_avg_demand", F.inline(case))
    adjusted = base * (1 + F.col("lift") / 100)
    # Population deviation of a series with three shocked days among equal ones.
    hit = 3 / horizon
    spread = F.sqrt(F.lit(hit * (1 - hit)))
    out = out.withColumns({"adjusted_demand": adjusted, "demand_std": adjusted * F.col("shock") / 100 * spread})
    z, lead = service_z(F.col("service_level")), F.col("lead_days")
    out = out.withColumn("scenario_safety", safety_stock(z, F.col("demand_std"), lead))
    out = out.withColumn("scenario_reorder", reorder_point(F.col("adjusted_demand"), F.col("scenario_safety"), lead))
    out = out.withColumn("scenario_target", target_level(F.col("scenario_reorder"), F.col("adjusted_demand"), 7))
    out = out.withColumn("base_safety", safety_stock(DEFAULT_Z, base * 0.25, 7))
    out = out.withColumn("base_reorder", reorder_point(base, F.col("base_safety"), 7))
    return out.withColumn("base_target", target_level(F.col("base_reorder"), base, 7)).drop("lift", "shock")


def replenish_requests(requests: DataFrame, forecast: DataFrame, service_level=95.0, lead_days=7) -> DataFrame:
    """Levels and decisions for a table of requested SKUs (``store_nbr, item_nbr, current_stock``).

    Demand is the forecast total over 16, at least 0.5; its deviation a quarter of that, at least 0.1. A request without
    forecast rows is answered with the least demand.
    """
    keys = ["store_nbr", "item_nbr"]
    wanted = forecast.join(requests.select(*keys).distinct(), keys, "left_semi")
    asked = requests.join(horizon_demand(wanted, "flat"), keys, "left")
    demand = asked.withColumn("daily_avg_demand", F.coalesce("daily_avg_demand", F.lit(0.5)))
    demand = demand.withColumn("demand_std", F.greatest(F.lit(0.1), F.coalesce("demand_std", F.col("daily_avg_demand") * 0.25)))
    return stock_decisions(stock_levels(demand, service_z(F.lit(float(service_level))), lead_days))


def summary_row(inventory: DataFrame, lead_days=7, service_level="95%") -> DataFrame:
    """The one-row export summary."""
    return inventory_kpis(inventory).withColumns(
        {"lead_time_days": F.lit(lead_days), "service_level_target": F.lit(service_level)}
    )
