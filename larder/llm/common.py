"""Shared helpers: columns and folders, batches through Arrow, file access from tasks, components of a graph."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larder.session import scratch_path, settle

TRAINING_REMAINDER = 2  # documents whose crc32(doc_id) mod 4 is this are held out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(key="doc_id"):
    """True for the rows that no model may learn from; a row without id counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == TRAINING_REMAINDER, F.lit(True))


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` whole rows chosen by a hash of ``keys``, or all of a smaller frame; neither sorts nor shuffles."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(rows / total * (1 << 30)))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_larder_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    path = scratch_path(spark, "code") + ".zip"
    fs, inner = filesystem(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inner) as out:
        out.write(packed.getvalue())
    context.addPyFile(path)
    context._larder_shipped = True


def as_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    arrays = [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type) for f in arrow]
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def release_memory() -> None:
    """Give what a finished task has freed back to the machine: workers are reused and would hold on to their peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_MEMO: dict = {}


def memo(owner: str, make: Callable):
    """What this process remembers for ``owner``. Workers serve stage after stage: an owner's first call drops what another left."""
    if _MEMO.get("owner") != owner:
        _MEMO.clear()
        _MEMO.update(owner=owner, value=make())
    return _MEMO["value"]


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields a dict of columns for each batch."""
    ship_package(df.sparkSession)
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        try:
            for columns in work(batches):
                yield as_batch(columns, arrow)
        finally:
            release_memory()

    return df.mapInArrow(run, kind)


def keep_rows(df: DataFrame, decide: Callable[[list[str]], np.ndarray], rows=500) -> DataFrame:
    """The rows of ``df`` whose texts ``decide`` says to keep, with all their columns as they are."""
    ship_package(df.sparkSession)

    def run(batches):
        try:
            for batch in (piece for whole in batches for piece in pieces(whole, rows)):
                yield batch.filter(pa.array(np.asarray(decide(texts(batch)), bool)))
        finally:
            release_memory()

    return df.mapInArrow(run, df.schema)


def texts(batch: pa.RecordBatch, name="text") -> list[str]:
    """The texts of a batch; null becomes empty."""
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]


def pieces(batch: pa.RecordBatch, rows=500) -> Iterator[pa.RecordBatch]:
    """A batch in parts, where the work on one row takes many times its size."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def bit_filter(wanted: DataFrame, key: str, bits=1 << 26):
    """Broadcast table of ``bits`` bits, set where a hash of a wanted key falls; its size does not depend on the data."""
    bit = f"pmod(xxhash64({key}), {bits})"
    words = wanted.select(F.expr(f"shiftright({bit}, 5)").alias("word"), F.expr(f"shiftleft(1L, CAST(pmod({bit}, 32) AS INT))").alias("bits"))
    filled = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most bits / 32 rows
    table = np.zeros(bits // 32, np.uint32)
    table[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).astype(np.uint32)
    return wanted.sparkSession.sparkContext.broadcast(table)


def passes(shared, bit: pa.Array) -> np.ndarray:
    """Rows whose ``bit`` (``bit_of``) is set in a ``bit_filter``: all wanted ones, and few others while it is sparse."""
    at = bit.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.flatnonzero((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1)


def bit_of(key: str, bits=1 << 26):
    return F.pmod(F.xxhash64(key), F.lit(bits))


def blob(parts: list) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def hash_bytes(data: bytes) -> int:
    """Signed 64-bit digest of bytes, the same in every process."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit words over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def filesystem(path: str):
    """Arrow file system and path of a shared folder, for files that tasks write themselves."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def connected_components(edges: DataFrame, rounds=40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: each is a minimum per node (combined map-side)
    joined back to the edges, so a node with very many edges never sits in one group. The number
    of rounds grows with the logarithm of the longest path. Each round is written to the shared folder.
    """
    edges = settle(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    current = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")

    def least_of(pairs):
        return pairs.groupBy("a").agg(F.min("b").alias("low"))

    def summary(df):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s")).first()
        return row["n"], row["s"]

    state = summary(current)
    for _ in range(rounds):
        if not state[0]:
            break
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least_of(both).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = least_of(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(low.select("a", F.col("low").alias("b"))).distinct()
        current = settle(small, "star")
        after = summary(current)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("the components did not settle")
    label = current.groupBy("a").agg(F.min("b").alias("low"))
    return nodes.join(label, nodes.node == label.a, "left").select("node", F.coalesce("low", "node").alias("component"))
