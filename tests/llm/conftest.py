import pytest

from tests.conftest import SMALL

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, ids STRING, score STRING, doc STRING, kept_text INT, rep INT, gram INT"


def frame(spark, rows, schema=SCHEMA):
    """Documents with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), "x", "y", "z", 1, 2, 3) for i, t, lang in rows], schema)


LONG = " ".join(f"word{i * 7919 % 10007}" for i in range(30_000))
PASSAGE = "the very same passage that stands in several of these documents again and again and is longer than one hundred bytes. "
ROWS = [
    (1, None, None), (2, "", "en"), (3, "one two three four five six", "en"), (4, "one two three four five six", None),
    (4, "one two three four five six", None), (5, LONG, "fr"), (6, PASSAGE + PASSAGE + "é" + PASSAGE, "fr"), (7, "x" + PASSAGE + "y", "en"),
    (None, "no id but text", "en"), (None, None, None), (8, "short", "de"), (9, " \n\t ", "de"), (10, "12 345 !!", "de"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r)) if columns else df.collect()
