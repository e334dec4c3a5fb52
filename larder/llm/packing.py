"""Packing: concatenate all token streams and cut them into fixed windows.

Pass one tokenizes every document where it lies and writes ids and token counts. The prefix sums of the partition
totals (one number per partition) give each document its global offset. Pass two cuts at the window boundaries, each task
for itself; a document that crosses a boundary has one boundary record (piece) on either side. Nothing is shuffled.

Defined cases: a null or empty text is the end id alone; null ids are packed like others; equal rows are packed once per
row; an empty table gives no pieces. Only the last window is shorter than ``window`` and would be padded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import blob, map_arrow, texts
from larder.llm.word_tokens import END_ID, encoder, vocabulary_path
from larder.session import settle

WINDOW = 4096
PIECES = "doc_id LONG, start LONG, length LONG, doc_tokens LONG, sequence_id LONG, offset LONG, ids BINARY"


def tokenize(df: DataFrame, path=None, end_id=END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids, part, local) per row; ids are little-endian unsigned 32-bit, closed by ``end_id``.

    ``local`` counts the ids of the rows before it in the same partition ``part``.
    """
    path, tail = path or vocabulary_path(), np.array([end_id], "<u4").tobytes()

    def work(batches):
        part, local = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [x + tail for x in encoder(path).encode(texts(batch))]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            before = local + np.cumsum(counts) - counts
            local += int(counts.sum())
            yield {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids": blob(ids), "part": np.full(len(ids), part), "local": before}

    return map_arrow(df.select(F.col("doc_id").cast("long"), "text"), work, "doc_id LONG, n_tokens LONG, ids BINARY, part INT, local LONG")


def prefix_sums(totals: list[tuple[int, int]]) -> dict[int, int]:
    """Exclusive prefix sums of (partition, total)."""
    offsets, at = {}, 0
    for part, total in sorted(totals):
        offsets[part] = at
        at += total
    return offsets


def cuts(n: np.ndarray, at: np.ndarray, window: int):
    """(document, start in it, length, sequence, offset there) of the pieces of documents with ``n`` ids that begin at ``at``."""
    number = np.where(n > 0, (at + n - 1) // window - at // window + 1, 0)
    doc = np.repeat(np.arange(len(n)), number)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    sequence = at[doc] // window + step
    begin = np.maximum(sequence * window, at[doc])
    end = np.minimum((sequence + 1) * window, (at + n)[doc])
    return doc, begin - at[doc], end - begin, sequence, begin - sequence * window


def pack(df: DataFrame, window=WINDOW, path=None, end_id=END_ID) -> DataFrame:
    """The pieces of all documents (``PIECES``): which ids lie where in which sequence."""
    tokens = settle(tokenize(df, path, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total")).collect()  # one number per partition
    offsets = prefix_sums([(r["part"], r["total"]) for r in totals])

    def work(batches):
        for batch in batches:
            n, part, local = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("n_tokens", "part", "local"))
            before = np.fromiter(map(offsets.__getitem__, part.tolist()), np.int64, len(part))
            doc, start, length, sequence, offset = cuts(n, before + local, window)
            ids = batch.column("ids").to_pylist()
            low, high = (4 * start).tolist(), (4 * (start + length)).tolist()
            yield {
                "doc_id": batch.column("doc_id").take(pa.array(doc)), "start": start, "length": length, "doc_tokens": n[doc],
                "sequence_id": sequence, "offset": offset, "ids": [ids[d][a:b] for d, a, b in zip(doc.tolist(), low, high)],
            }

    return map_arrow(tokens, work, PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The thin columns of the registered query: ids become their crc32."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
