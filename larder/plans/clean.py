"""The clean fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from larder.functions.scalars import clip_and_cap, return_flag, text_to_boolean
from larder.operators.joins import date_spine, join_all, on_calendar
from larder.operators.quantiles import exact_quantiles
from larder.operators.windows import fill_both_ways
from larder.schemas import CLEAN_COLUMNS


def drop_moved_holidays(holidays: DataFrame) -> DataFrame:
    """Drop days whose celebration was moved, except the transfer day itself."""
    return holidays.where(~(F.col("transferred") & (F.col("type") != "Transfer")))


def holiday_days(holidays: DataFrame, by=("date",)) -> DataFrame:
    """One row per date: flag 1 and the alphabetically first type."""
    return drop_moved_holidays(holidays).groupBy(*by).agg(
        F.lit(1).alias("is_holiday"), F.min("type").alias("holiday_type")
    )


def local_holiday_days(holidays: DataFrame, stores: DataFrame) -> DataFrame:
    """One row per date and store the event applies to: national, or the store's state or city."""
    kept = drop_moved_holidays(holidays)
    national = kept.where("locale = 'National'").select("date", "type").distinct()
    regional = kept.where("locale = 'Regional'").select("date", "type", F.col("locale_name").alias("state"))
    local = kept.where("locale = 'Local'").select("date", "type", F.col("locale_name").alias("city"))
    # Every store observes a national day, so those stay keyed by date.
    per_store = (
        regional.join(stores.select("state", "store_nbr"), "state")
        .select("date", "store_nbr", "type")
        .unionByName(local.join(stores.select("city", "store_nbr"), "city").select("date", "store_nbr", "type"))
        .groupBy("date", "store_nbr")
        .agg(F.min("type").alias("local_type"))
    )
    return national.groupBy("date").agg(F.min("type").alias("national_type")), per_store


def complete_prices(prices: DataFrame, sales: DataFrame, value="dcoilwtico") -> DataFrame:
    """A price for every calendar day of the sales: filled forward, then backward."""
    return fill_both_ways(on_calendar(prices.select("date", value), date_spine(sales)), value)


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Values for what an outer join did not match."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def sales_cap(sales: DataFrame, probability=0.999):
    """The cap as a scalar subquery column."""
    return exact_quantiles(sales, "unit_sales", (probability,), names=("cap",)).scalar()


def build_clean(tables: dict[str, DataFrame], cap_probability=0.999, by_locale=False) -> DataFrame:
    """Sales with store, item, price, transaction and holiday columns; clipped and capped. Records of one day are combined first.

    ``by_locale`` marks a holiday only in the stores of its state or city.
    """
    sales, stores = one_row_per_day(tables["train"]), tables["stores"]
    value = F.col("unit_sales")
    base = sales.select(
        "date",
        "store_nbr",
        "item_nbr",
        clip_and_cap(value, sales_cap(sales, cap_probability)).alias("unit_sales"),
        text_to_boolean(F.col("onpromotion")).alias("onpromotion"),
        return_flag(value).alias("is_return"),
    )
    joined = join_all(
        base,
        (stores, ["store_nbr"]),
        (tables["items"], ["item_nbr"]),
        (complete_prices(tables["oil"], sales), ["date"]),
        (tables["transactions"], ["date", "store_nbr"]),
    )
    if by_locale:
        national, local = local_holiday_days(tables["holidays_events"], stores)
        kind = F.least("national_type", "local_type")
        joined = (
            joined.join(national, "date", "left")
            .join(local, ["date", "store_nbr"], "left")
            .withColumns({"holiday_type": kind, "is_holiday": F.when(kind.isNotNull(), 1)})
        )
    else:
        joined = joined.join(holiday_days(tables["holidays_events"]), "date", "left")
    filled = with_defaults(joined, {"transactions": 0, "is_holiday": 0, "holiday_type": "Regular"})
    return filled.select(*CLEAN_COLUMNS)


# Storage types: what the values fit in.
STORED_TYPES = {
    "store_nbr": "smallint", "item_nbr": "int", "unit_sales": "float", "is_return": "smallint",
    "cluster": "smallint", "class": "smallint", "perishable": "smallint", "dcoilwtico": "float",
    "transactions": "int", "is_holiday": "smallint",
}


def cast_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items() if c in df.columns})


def narrow_types(df: DataFrame) -> DataFrame:
    """Whole-number columns in the smallest type that holds their range; doubles as floats."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    kinds = {f.name: "float" for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    if whole:
        bounds = df.agg(
            *[F.min(c).alias(f"{c}__min") for c in whole], *[F.max(c).alias(f"{c}__max") for c in whole]
        ).first()
        for c in whole:
            low, high = bounds[f"{c}__min"], bounds[f"{c}__max"]
            for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)):
                if low is None or (-(2**bits) <= low and high < 2**bits):
                    kinds[c] = kind
                    break
    return cast_columns(df, kinds)


def one_row_per_day(sales: DataFrame, keys=("date", "store_nbr", "item_nbr")) -> DataFrame:
    """Combine duplicate records of a day, before any shuffle where possible.

    Series windows need this: afterwards a series is no longer than its calendar, whatever share of the
    raw rows one store or item holds.
    """
    return sales.groupBy(*keys).agg(
        F.sum("unit_sales").alias("unit_sales"), F.max("onpromotion").alias("onpromotion")
    )


def densify(clean: DataFrame, keys=("store_nbr", "item_nbr")) -> DataFrame:
    """Insert zero-sales rows for the days missing inside each series' own span."""
    spans = clean.groupBy(*keys).agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    days = spans.select(*keys, F.explode(F.expr("sequence(_first, _last, interval 1 day)")).alias("date"))
    return days.join(clean, [*keys, "date"], "left").withColumn(
        "unit_sales", F.coalesce("unit_sales", F.lit(0.0))
    )
