"""Near-duplicate vectors by p-stable hashing: quantised Gaussian projections in several tables, then exact cosines.

Normalised vectors at cosine c are sqrt(2 - 2c) apart. Per table a vector gets ``k`` cells floor((a.x + b) / w); it meets in
a bucket those that share all of them. ``plan_tables`` takes ``k`` from the number of vectors, so that unrelated vectors
stay few per bucket at every size, and the number of tables from the miss rate allowed at the threshold itself.

A bucket is cut into blocks of at most ``BLOCK`` rows by hash of the vector, and each pair of blocks is one task group, so
a bucket of any size is compared completely without lying in one task. A pair counts only in the first table in which its
vectors share a bucket. Out of a block pair come link counts per vector and a spanning forest, never all pairs.
Equal vectors are one class, compared once and weighted by their number.

Vectors of different lengths have no cosine; each length found (few) has hash tables of its own.

Defined cases: null, zero or non-finite vectors link with nothing; null ids are compared as others, but have no own component id
(null); repeated rows are several vectors; very long vectors are read whole; further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import connected_components, map_arrow, partitions
from larder.session import settle

WIDTH = 2.0
MISSED = 0.02  # allowed share of pairs missed at exactly the threshold
STRANGERS = 0.05  # unrelated (orthogonal) vectors expected in a vector's bucket
BLOCK = 512
SEED = 7


def collision(distance: float, width=WIDTH) -> float:
    """Probability that one quantised projection agrees at ``distance``."""
    r = width / max(distance, 1e-12)
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(rows: int, threshold: float, width=WIDTH) -> tuple[int, int]:
    """Projections per table and number of tables."""
    far = collision(math.sqrt(2), width)
    k = math.ceil(math.log(max(rows, 2) / STRANGERS) / -math.log(far))
    near = collision(math.sqrt(2 - 2 * threshold), width) ** k
    return k, math.ceil(math.log(MISSED) / math.log1p(-near))


def unit_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, unit, key): double-precision unit vectors as bytes, null where a vector cannot be compared."""

    def work(batches):
        for batch in batches:
            out = []
            for x in batch.column("embedding").to_pylist():
                v = None if x is None or any(y is None for y in x) else np.array(x, np.float64)
                length = 0.0 if v is None or not np.isfinite(v).all() else float(np.abs(v).max(initial=0.0))
                if length:
                    v = v / length
                    out.append((v / np.sqrt((v * v).sum())).tobytes())
                else:
                    out.append(None)
            yield {"vec_id": batch.column("vec_id"), "unit": out}

    source = df.select(F.col("vec_id").cast("long"), "embedding")
    return map_arrow(source, work, "vec_id LONG, unit BINARY").withColumn("key", F.xxhash64("unit"))


def projections(size: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return random.standard_normal((size, k * tables)), random.uniform(0, WIDTH, k * tables)


def hashed(classes: DataFrame, size: int, k: int, tables: int) -> DataFrame:
    """(key, unit, weight, cells) with one 64-bit bucket per table."""
    a, b = projections(size, k, tables)
    scale = np.random.default_rng(SEED + 1).integers(1, 2**63, k, np.int64).astype(np.uint64) | np.uint64(1)

    def work(batches):
        for batch in batches:
            units = batch.column("unit").to_pylist()
            x = np.frombuffer(b"".join(units), np.float64).reshape(len(units), size)
            cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(units), tables, k)
            with np.errstate(over="ignore"):
                mixed = (cells * scale).sum(axis=2, dtype=np.uint64)
            yield {"key": batch.column("key"), "unit": batch.column("unit"), "weight": batch.column("weight"), "cells": list(mixed.view(np.int64))}

    return map_arrow(classes, work, "key LONG, unit BINARY, weight LONG, cells ARRAY<LONG>")


def compare_blocks(x, y, cells_x, cells_y, table, threshold, same):
    """Links (i, j) between two blocks that no earlier table already has."""
    near = x @ y.T >= threshold
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if table and len(i):
        first = ~(cells_x[i, :table] == cells_y[j, :table]).any(axis=1)
        i, j = i[first], j[first]
    return i, j


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that span the components of the links."""
    parent, kept = list(range(n)), []
    for a, b in zip(i.tolist(), j.tolist()):
        p, q = a, b
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        while parent[q] != q:
            parent[q] = q = parent[parent[q]]
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((a, b))
    return kept


def block_pairs(classes: DataFrame) -> DataFrame:
    """(table, bucket, left, right, own, key, ...): every row once for each pair of blocks that its block takes part in."""
    rows = classes.select("key", F.posexplode("cells").alias("table", "bucket"))
    sizes = rows.groupBy("table", "bucket").agg(F.count("*").alias("rows")).where("rows > 1")
    rows = rows.join(sizes, ["table", "bucket"])
    rows = rows.withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("long"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("table", "bucket", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "key")
    return rows.join(classes, "key")


def links_of(comparable: DataFrame, size: int, count: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of ``count`` vectors with ``size`` components: (key, weight) of their classes, and (a, b, links) between classes.

    Rows with a = b count a class's links to others; the others span the components.
    """
    k, tables = plan_tables(count, threshold)
    classes = comparable.groupBy("key").agg(F.first("unit").alias("unit"), F.count("*").alias("weight"))
    classes = settle(hashed(classes, size, k, tables), "hashed")
    spark = comparable.sparkSession
    rows = block_pairs(classes).repartition(partitions(spark), "table", "bucket", "left", "right")
    rows = rows.sortWithinPartitions("table", "bucket", "left", "right", "own", "key")
    rows = rows.select("table", "bucket", "left", "right", "own", "key", "unit", "weight", "cells")

    def work(batches):
        group, members = None, []

        def close():
            table, _, left, right = group
            at = [n for n, m in enumerate(members) if m[0] == left], [n for n, m in enumerate(members) if m[0] == right]
            x = np.frombuffer(b"".join(m[2] for m in members), np.float64).reshape(len(members), size)
            cells = np.array([m[4] for m in members], np.int64)
            p, q = np.array(at[0], int), np.array(at[1], int)
            i, j = compare_blocks(x[p], x[q], cells[p], cells[q], table, threshold, left == right)
            i, j = p[i], q[j]
            weight = np.array([m[3] for m in members], np.int64)
            links = np.bincount(i, weight[j], len(members)) + np.bincount(j, weight[i], len(members))
            out = [(members[n][1], members[n][1], int(links[n])) for n in np.flatnonzero(links)]
            return out + [(members[a][1], members[b][1], 0) for a, b in forest(i, j, len(members))]

        done = []
        for batch in batches:
            for table, bucket, left, right, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (table, bucket, left, right) != group:
                    if len(members) > 1:
                        done += close()
                    group, members = (table, bucket, left, right), []
                members.append(row)
            if len(done) > 10_000:
                yield dict(zip(("a", "b", "links"), map(list, zip(*done))))
                done = []
        if len(members) > 1:
            done += close()
        yield dict(zip(("a", "b", "links"), map(list, zip(*done)))) if done else {"a": [], "b": [], "links": []}

    return classes.select("key", "weight"), settle(map_arrow(rows, work, "a LONG, b LONG, links LONG"), "links")


def similar_vectors(df: DataFrame, threshold=0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    units = settle(unit_vectors(df), "units")
    lengths = units.where("unit IS NOT NULL").groupBy(F.length("unit").alias("size")).count().orderBy("size").collect()  # few lengths
    if not lengths:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    parts = [links_of(units.where(F.length("unit") == r["size"]), r["size"] // 8, r["count"], threshold) for r in lengths]
    classes, found = (reduce(DataFrame.union, side) for side in zip(*parts))
    comparable = units.where("unit IS NOT NULL")
    counts = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    names = settle(comparable.groupBy("key").agg(F.min("vec_id").alias("rep")), "names")
    left = names.select(F.col("key").alias("a"), F.col("rep").alias("p"))
    right = names.select(F.col("key").alias("b"), F.col("rep").alias("q"))
    edges = found.where("a <> b").join(left, "a").join(right, "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    groups = settle(connected_components(edges), "groups")
    named = names.join(groups, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component"))
    weights = classes.select("key", "weight").join(counts, F.col("key") == F.col("a"), "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    per_class = named.join(weights, "key")
    rows = units.withColumn("key", F.when(F.col("unit").isNotNull(), F.col("key"))).join(per_class, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return rows.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
