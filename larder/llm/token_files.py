"""Token-id files: documents compressed one by one with a shared zstandard dictionary, readable one by one.

The dictionary is trained on the id arrays of a bounded sample (about ``SAMPLE`` documents chosen by hash); it only
affects sizes, never content. Documents are range-partitioned by id and every task writes one shard.

Shard layout, all little-endian: ``LZID0001`` | sha256 of the dictionary (32 bytes) | frames | index of
(doc_id i64, offset u64, n_tokens u64, has_id u64) per document | number of documents u64 | index offset u64.

Tasks may run twice: each attempt writes its own file name, and only the files named in the settled manifest are read.

Defined cases: a null or empty text is the end id alone; null ids come first and stay null; equal ids are kept as several
documents, ordered by a hash of their text; an empty table writes no shard and reads back as no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import bounded_sample, filesystem, map_arrow, partitions, texts
from larder.llm.packing import prefix_sums, tokenize
from larder.llm.word_tokens import END_ID, encoder, vocabulary_path
from larder.session import scratch_path, settle

MAGIC = b"LZID0001"
SAMPLE = 1_000
DICTIONARY_BYTES = 112_640
LEVEL = 3
_MANIFEST = "shard INT, path STRING, n_docs LONG, n_tokens LONG, n_bytes LONG"
_INDEX = np.dtype([("doc", "<i8"), ("at", "<u8"), ("n", "<u8"), ("has_id", "<u8")])


def train_dictionary(samples: list[bytes]) -> bytes:
    """Trained dictionary; with too few samples to train, their bytes as a raw dictionary, or none."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def write_token_files(df: DataFrame, folder: str, path=None, end_id=END_ID) -> DataFrame:
    """Write all documents below ``folder`` in ascending id order; returns the settled manifest, one row per shard."""
    path, tail = path or vocabulary_path(), np.array([end_id], "<u4").tobytes()
    source = df.select(F.col("doc_id").cast("long"), "text")
    sample = bounded_sample(source, SAMPLE, "doc_id", "text")
    fits = [bytes(r["ids"]) for r in tokenize(sample, path, end_id).select(F.expr("substring(ids, 1, 65536)").alias("ids")).collect()]
    dictionary = train_dictionary(fits)
    digest = hashlib.sha256(dictionary).digest()
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{digest.hex()}.dict") as out:
        out.write(dictionary)

    def work(batches):
        compress, shard, index, at, out = _codec(dictionary)[0].compress, TaskContext.get().partitionId(), [], 40, None
        fs, root = filesystem(folder)
        name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.lzid"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = fs.open_output_stream(name)
                out.write(MAGIC + digest)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).encode(texts(batch))):
                frame = compress(ids + tail)
                out.write(frame)
                index.append((doc or 0, at, len(ids) // 4 + 1, doc is not None))
                at += len(frame)
        if out is not None:
            rows = np.array(index, _INDEX)
            out.write(rows.tobytes() + struct.pack("<QQ", len(rows), at))
            out.close()
            yield {"shard": [shard], "path": [name], "n_docs": [len(rows)], "n_tokens": [int(rows["n"].sum())], "n_bytes": [at + rows.nbytes + 16]}

    spread = source.repartitionByRange(partitions(df.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return settle(map_arrow(spread.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")), work, _MANIFEST), "manifest")


class Shard:
    """One shard file: ``docs`` is its index, ``ids(i)`` reads and decompresses only document ``i``."""

    def __init__(self, path: str, fs, dictionaries: dict):
        self.file = fs.open_input_file(path)
        head, size = self.file.read_at(40, 0), self.file.size()
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        count, self.end = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        self.docs = np.frombuffer(self.file.read_at(count * _INDEX.itemsize, self.end), _INDEX)
        self.limits = np.append(self.docs["at"][1:], self.end).astype(np.int64)
        key = head[8:].hex()
        if key not in dictionaries:
            with fs.open_input_stream(f"{path.rpartition('/')[0]}/{key}.dict") as found:
                data = found.read()
            if hashlib.sha256(data).hexdigest() != key:
                raise ValueError(f"{path}: its dictionary was changed")
            dictionaries[key] = _codec(data)[1]
        self.decompress = dictionaries[key].decompress

    def ids(self, i: int) -> bytes:
        at = int(self.docs["at"][i])
        return self.decompress(self.file.read_at(int(self.limits[i]) - at, at))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in file order; ``start`` counts all ids before it."""
    shards = manifest.select("shard", "path", "n_tokens").collect()  # one row per file
    starts = prefix_sums([(r["shard"], r["n_tokens"]) for r in shards])
    spark = manifest.sparkSession
    rows = [(r["path"], starts[r["shard"]]) for r in sorted(shards)]
    files = spark.createDataFrame(rows, "path STRING, start LONG").repartition(max(1, len(rows)))

    def work(batches):
        dictionaries: dict = {}
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(path, filesystem(path)[0], dictionaries)
                n = shard.docs["n"].astype(np.int64)
                before = start + np.cumsum(n) - n
                for i in range(0, len(n), 500):
                    part = range(i, min(i + 500, len(n)))
                    yield {
                        "doc_id": [int(shard.docs["doc"][k]) if shard.docs["has_id"][k] else None for k in part],
                        "start": before[i : i + 500], "n_tokens": n[i : i + 500], "ids": [shard.ids(k) for k in part],
                    }

    return map_arrow(files, work, "doc_id LONG, start LONG, n_tokens LONG, ids BINARY")


def token_file_digests(df: DataFrame, path=None) -> DataFrame:
    """Write the files, read them back, and reduce each document to its counts and crc32."""
    back = read_token_files(write_token_files(df, scratch_path(df.sparkSession, "token-files"), path))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
