"""Schemas of the source and derived tables, as DDL text for Spark readers."""

TRAIN = "id BIGINT, date DATE, store_nbr INT, item_nbr INT, unit_sales DOUBLE, onpromotion STRING"
TEST = "id BIGINT, date DATE, store_nbr INT, item_nbr INT, onpromotion STRING"
STORES = "store_nbr INT, city STRING, state STRING, type STRING, cluster INT"
ITEMS = "item_nbr INT, family STRING, class INT, perishable INT"
OIL = "date DATE, dcoilwtico DOUBLE"
TRANSACTIONS = "date DATE, store_nbr INT, transactions BIGINT"
HOLIDAYS = "date DATE, type STRING, locale STRING, locale_name STRING, description STRING, transferred BOOLEAN"
PREDICTIONS = "date DATE, store_nbr INT, item_nbr INT, forecast_sales DOUBLE, actual_sales DOUBLE"

SOURCES = {
    "train": TRAIN,
    "test": TEST,
    "stores": STORES,
    "items": ITEMS,
    "oil": OIL,
    "transactions": TRANSACTIONS,
    "holidays_events": HOLIDAYS,
}

KEYS = ("store_nbr", "item_nbr")
TARGET = "unit_sales"

CLEAN_COLUMNS = (
    "date", "store_nbr", "item_nbr", "unit_sales", "onpromotion", "is_return", "city", "state", "type",
    "cluster", "family", "class", "perishable", "dcoilwtico", "transactions", "is_holiday", "holiday_type",
)
