"""Source divergence audit against its SQL twin over many small cells, and defined cases."""

import random

import duckdb
import numpy as np
import pyarrow as pa

from larder.llm import divergence
from tests.compare import compare
from tests.llm.conftest import ROWS

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, term STRING, slab INT, block INT, p INT"


def both(df, min_docs, **sizes):
    """None when the operator gives the rows of the SQL twin."""
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pandas(df.toPandas()[["doc_id", "text", "lang", "source"]], schema=pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])))
    sql = divergence.ORACLE.replace(f">= {divergence.MIN_DOCS}", f">= {min_docs}")
    return compare(divergence.audit(df, min_docs, **sizes), con, sql)


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 40)
    random.seed(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Über", "STRASSE", "naïve", "a1b", "日本"]
    rows = [
        (i, " ".join(random.choices(words, weights=range(len(words), 0, -1), k=random.randint(0, 60))), random.choice(["en", "de", None]),
         random.choice([None, *"abcdefghij"]), "x", 1, 2, 3)
        for i in range(150)
    ]
    docs = spark.createDataFrame(rows + rows[:9], SCHEMA).repartition(3)
    assert both(docs, 3, block=2, slab=16) is None and both(docs, 3) is None


def test_odd_rows(odd, empty):
    assert both(odd, 2, block=1, slab=1) is None
    assert {(r["part"], r["value"]) for r in divergence.audit(odd, len(ROWS) + 1).collect()} <= {("pair", 0)}
    assert divergence.audit(empty).count() == 0


def test_exact_beyond_doubles(spark):
    row = spark.range(1).selectExpr("9007199254740993 AS n", "36028797018963971 AS total", "1000L AS v")
    p = row.select(divergence.share("n", "total", "v").alias("p")).first()["p"]
    assert p == 1 + 1_000_000_000 * (9007199254740993 + 2) // (36028797018963971 + 2000)


def test_cell_counts_absent_terms():
    left, right = np.array([[5, 9]]), np.array([[2, 9], [5, 1]])
    sums = divergence.cell_sums(left, right, np.array([3]), np.array([1, 3]), 4)
    assert sums.tolist() == [[9 // 7 + 0 + 4 * (4 // 4), 0 + 64 // 10 + 0]]
