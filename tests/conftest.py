import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larder.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "larder-tests", "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def series(spark, values, store=1, item=1, start=0):
    rows = [(day(start + i), store, item, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date DATE, store_nbr INT, item_nbr INT, unit_sales DOUBLE")


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).select(order, name).collect()]
