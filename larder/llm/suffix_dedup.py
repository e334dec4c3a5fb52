"""Exact removal of repeated byte strings: every byte covered by a ``WINDOW``-byte string that also starts earlier.

Earlier means in a document with a smaller id, or further left in the same one. Strings never cross documents.

1. Each task finds the anchors of its texts (``anchors``): equal windows have the same anchor, so runs of windows meet by
   anchor hash. Runs that repeat within a batch are settled there (map-side); one entry per different run goes on, packed
   into blocks by anchor hash.
2. A block keeps the first of equal runs and marks the others. Runs that share an anchor but differ are contested.
3. The bytes of contested runs are fetched, and the column-wise suffix construction (``suffix_order``) over the
   collection of a task tells which of their windows are equal; the first of each is kept, the others are marked.
4. Marks are merged per document and cut out.

A construction over whole documents would take one round over all files per byte of the longest document; contested runs
have at most 168 bytes, so 168 rounds do. README has the figures.

Defined cases: a null text is empty and keeps nothing; null ids come after all others; rows with equal id and text are one
document and get the same result, rows with equal id and other text are ordered by a hash of the text; texts shorter
than ``WINDOW`` bytes stay whole; an empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from larder.llm.anchors import GRAM, PIECE, WINDOW, runs
from larder.llm.common import bit_filter, bit_of, fresh_name, map_arrow, partitions, passes
from larder.llm.suffix_order import equal_windows
from larder.session import settle

LAST_ID = 1 << 42
_ENTRY = np.dtype([("anchor", "<u8"), ("digest", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("stop", "<u4")])
_MARK = np.dtype([("doc", "<i8"), ("start", "<u4"), ("stop", "<u4")])
_ROWS = "doc LONG, start INT, stop INT, anchor LONG"
#: Bytes on either side of the anchor of which a window always covers one side whole.
SIDE = (WINDOW - GRAM) // 2


def keyed(df: DataFrame) -> DataFrame:
    """(doc_id, doc, text): ``doc`` numbers different documents in their order, and is the id where ids are unique."""
    docs = df.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(LAST_ID)))
    ids = docs.groupBy("doc").agg(F.count("*").alias("rows"), F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    if ids.where("a <> b").limit(1).count() == 0:
        return docs
    order = Window.partitionBy("doc").orderBy("h")
    parts = docs.select("doc", F.xxhash64("text").alias("h")).distinct().withColumn("nth", F.row_number().over(order) - 1)
    docs = docs.withColumn("h", F.xxhash64("text")).join(parts, ["doc", "h"])
    return settle(docs.select("doc_id", (F.col("doc") * (1 << 20) + F.col("nth")).alias("doc"), "text"), "keyed")


def text_pieces(docs: list[int], texts: list[str]):
    """Concatenated pieces of texts: (documents, starts in them, lengths, bytes); every window lies whole in one piece."""
    group, size = [], 0
    for doc, text in zip(docs, texts):
        data = text.encode()
        if len(data) < WINDOW:
            continue
        for start in range(0, len(data) - WINDOW + 1, PIECE):
            part = data[start : start + PIECE + WINDOW - 1]
            if group and size + len(part) > PIECE + WINDOW:
                yield group
                group, size = [], 0
            group.append((doc, start, part))
            size += len(part)
    if group:
        yield group


def batch_entries(docs: list[int], texts: list[str]) -> np.ndarray:
    """Entries of all runs of a batch, ordered by document and place."""
    out = []
    for group in text_pieces(docs, texts):
        lengths = np.array([len(part) for _, _, part in group], np.int64)
        first, last, _, anchor, digest = runs(np.frombuffer(b"".join(part for _, _, part in group), np.uint8), lengths)
        begins = np.cumsum(lengths) - lengths
        owner = np.searchsorted(begins, first, side="right") - 1
        shift = np.array([start for _, start, _ in group], np.int64)[owner] - begins[owner]
        entries = np.empty(len(first), _ENTRY)
        entries["anchor"], entries["digest"] = anchor, digest
        entries["doc"] = np.array([doc for doc, _, _ in group], np.int64)[owner]
        entries["start"], entries["stop"] = first + shift, last + shift + WINDOW
        out.append(entries)
    entries = np.concatenate(out) if out else np.zeros(0, _ENTRY)
    return entries[np.lexsort((entries["start"], entries["doc"]))]


def split_first(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first entry of each run, the later ones) of entries ordered by document and place."""
    order = np.lexsort((entries["digest"], entries["anchor"]))  # stable, so places stay in order
    entries = entries[order]
    same = (entries["anchor"][1:] == entries["anchor"][:-1]) & (entries["digest"][1:] == entries["digest"][:-1])
    new = np.append(True, ~same) if len(entries) else np.zeros(0, bool)
    lead = entries[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(entries) else entries
    later = ~new & ((entries["doc"] != lead["doc"]) | (entries["start"] != lead["start"]))
    return entries[new], entries[later]


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Marks merged where they overlap or touch, per document."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    if not len(doc):
        return doc, start, stop
    number = np.cumsum(np.append(0, doc[1:] != doc[:-1])) * (1 << 33)
    reach = np.maximum.accumulate(stop + number) - number
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:] - 1, len(doc) - 1)]


def marks(docs: DataFrame) -> DataFrame:
    """``_ROWS``: marks (no anchor), and contested runs (with their anchor)."""
    blocks = partitions(docs.sparkSession)

    def collect(batches):
        for batch in batches:
            order = np.argsort(batch.column("doc").to_numpy(), kind="stable")
            batch = batch.take(order)
            kept, later = split_first(batch_entries(batch.column("doc").to_pylist(), batch.column("text").to_pylist()))
            doc, start, stop = merged(later["doc"], later["start"], later["stop"])
            done = np.empty(len(doc), _MARK)
            done["doc"], done["start"], done["stop"] = doc, start, stop
            target = (kept["anchor"] >> np.uint64(11)) % np.uint64(blocks)
            order = np.argsort(target, kind="stable")
            kept, bounds = kept[order], np.searchsorted(target[order], np.arange(blocks + 1))
            rows = [(i, False, kept[a:b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
            for i in range(0, len(done), 20_000):
                rows.append((int(done["doc"][i]) % blocks, True, done[i : i + 20_000]))
            # Columns one after another pack better than rows.
            yield {
                "block": [r[0] for r in rows], "done": [r[1] for r in rows],
                "data": [b"".join(np.ascontiguousarray(r[2][c]).tobytes() for c in r[2].dtype.names) for r in rows],
            }

    def unpack(data: bytes, kind: np.dtype) -> np.ndarray:
        out, at = np.empty(len(data) // kind.itemsize, kind), 0
        for name in kind.names:
            column = np.frombuffer(data, kind[name], len(out), at)
            out[name], at = column, at + column.nbytes
        return out

    def settle_blocks(batches):
        entries = []
        for batch in batches:
            for done, data in zip(batch.column("done").to_pylist(), batch.column("data").to_pylist()):
                if done:
                    found = unpack(data, _MARK)
                    yield {"doc": found["doc"], "start": found["start"].astype(np.int32), "stop": found["stop"].astype(np.int32), "anchor": [None] * len(found)}
                else:
                    entries.append(unpack(data, _ENTRY))
        if not entries:
            return
        entries = np.concatenate(entries)
        entries = entries[np.lexsort((entries["start"], entries["doc"]))]
        kept, later = split_first(entries)
        del entries
        doc, start, stop = merged(later["doc"], later["start"], later["stop"])
        yield {"doc": doc, "start": start.astype(np.int32), "stop": stop.astype(np.int32), "anchor": [None] * len(doc)}
        same = kept["anchor"][1:] == kept["anchor"][:-1]
        kept = kept[np.append(False, same) | np.append(same, False)] if len(kept) else kept
        yield {"doc": kept["doc"], "start": kept["start"].astype(np.int32), "stop": kept["stop"].astype(np.int32), "anchor": kept["anchor"].view(np.int64) if len(kept) else []}

    packed = map_arrow(docs.select("doc", "text"), collect, "block INT, done BOOLEAN, data BINARY")
    return settle(map_arrow(packed.repartition(blocks, "block"), settle_blocks, _ROWS), "marks")


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, text) of the documents ``wanted`` (doc), each once, and of few others."""
    shared = bit_filter(wanted, "doc")

    def work(batches):
        for batch in batches:
            batch = batch.take(passes(shared, batch.column("bit")))
            yield {"doc": batch.column("doc"), "text": batch.column("text")}

    return map_arrow(docs.select("doc", "text", bit_of("doc").alias("bit")), work, "doc LONG, text STRING")


def agreeing(anchor: np.ndarray, strings: list[bytes], place: np.ndarray) -> np.ndarray:
    """Strings that share a whole side of their anchor with another one; only these can share a window."""
    out = np.zeros(len(strings), bool)
    for low, high in ((-SIDE, 0), (GRAM, GRAM + SIDE)):
        keys: dict = {}
        for i, (text, at) in enumerate(zip(strings, place.tolist())):
            if at + low >= 0 and at + high <= len(text):
                keys.setdefault((anchor[i], text[at + low : at + high]), []).append(i)
        for group in keys.values():
            if len(group) > 1:
                out[group] = True
    return out


def contested_marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Marks of the windows of contested runs that also start earlier."""
    contested = found.where("anchor IS NOT NULL")
    text = fetch(docs, contested.select("doc").distinct()).dropDuplicates(["doc"])
    data = F.expr("substring(CAST(text AS BINARY), start + 1, stop - start)")
    rows = contested.join(text, "doc").select("anchor", "doc", "start", data.alias("data"))

    def work(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        anchor, doc, start = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(3))
        strings = [x for b in parts for x in b.column(3).to_pylist()]
        keep = np.flatnonzero(agreeing(anchor, strings, _anchor_places(strings, anchor)))
        doc, start, strings = doc[keep], start[keep].astype(np.int64), [strings[i] for i in keep.tolist()]
        if not strings:
            return
        classes, string, offset = equal_windows(strings, WINDOW)
        doc, at = doc[string], start[string] + offset
        order = np.lexsort((at, doc, classes))
        classes, doc, at = classes[order], doc[order], at[order]
        lead = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))[np.cumsum(np.append(0, classes[1:] != classes[:-1]))]
        later = (doc != doc[lead]) | (at != at[lead])
        doc, begin, end = merged(doc[later], at[later], at[later] + WINDOW)
        yield {"doc": doc, "start": begin.astype(np.int32), "stop": end.astype(np.int32)}

    return map_arrow(rows.repartition(partitions(docs.sparkSession), "anchor"), work, "doc LONG, start INT, stop INT")


def _anchor_places(strings: list[bytes], anchor: np.ndarray) -> np.ndarray:
    """Place of the anchor in each string: the last possible one is ``GRAM`` before the end of the first window."""
    from larder.llm.anchors import gram_hashes

    lengths = np.array([len(s) for s in strings], np.int64)
    begins = np.cumsum(lengths) - lengths
    hashes = gram_hashes(np.frombuffer(b"".join(strings), np.uint8))
    owner = np.repeat(np.arange(len(strings)), lengths)[: len(hashes)]
    inside = np.arange(len(hashes)) + GRAM <= (begins + lengths)[owner]
    hit = np.flatnonzero(inside & (hashes == anchor.view(np.uint64)[owner]))
    place = np.zeros(len(strings), np.int64)
    place[owner[hit[::-1]]] = hit[::-1] - begins[owner[hit[::-1]]]  # the leftmost
    return place


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, spans) of keyed documents that lose bytes; marks may still overlap."""
    found = marks(docs)
    spans = found.where("anchor IS NULL").select("doc", "start", "stop").union(settle(contested_marks(docs, found), "contested"))
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its maximal removed runs."""
    pairs = np.array(spans, np.int64).reshape(-1, 2)
    _, start, stop = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
    kept, at = [], 0
    for a, b in zip(start.tolist(), stop.tolist()):
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), list(zip(start.tolist(), stop.tolist()))


def dedup_text(docs: DataFrame) -> DataFrame:
    """(doc, kept BINARY, text, spans) of keyed documents that lose bytes; ``text`` lacks characters that a cut goes through."""
    spans = settle(repeated_spans(docs), "spans")
    text = fetch(docs, spans.select("doc")).dropDuplicates(["doc"])

    def work(batches):
        for batch in batches:
            got = [cut_out(text.encode(), [(s["start"], s["stop"]) for s in spans]) for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            left = [kept for kept, _ in got]
            yield {"doc": batch.column("doc"), "kept": left, "text": [x.decode("utf-8", "ignore") for x in left], "spans": [[{"start": a, "stop": b} for a, b in found] for _, found in got]}

    return map_arrow(spans.join(text, "doc").select("doc", "text", "spans"), work, "doc LONG, kept BINARY, text STRING, spans ARRAY<STRUCT<start: LONG, stop: LONG>>")


def keep_first(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with what is left of their text (and its length in ``n_chars`` if there is such a column).

    Characters that a cut goes through are dropped; rows that lose their whole text go, rows that had none stay.
    """
    docs = keyed(df)
    text, ident, mark = (fresh_name(df, name) for name in ("kept_text", "kept_id", "kept_hash"))
    lost = dedup_text(docs).select("doc", F.col("text").alias(text))
    names = docs.select("doc", F.col("doc_id").alias(ident), F.xxhash64("text").alias(mark)).distinct()
    lost = names.join(lost, "doc").drop("doc")
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = df.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (own == F.col(mark)), "left")
    rows = rows.where(F.col(text).isNull() | (F.col(text) != ""))
    new = F.coalesce(text, "text")
    return rows.select(*(new.alias("text") if c == "text" else F.length(new).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in df.columns))


def removal_digests(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    docs = keyed(df)
    lost = dedup_text(docs).select("doc", F.length("kept").cast("long").alias("left"), F.size("spans").cast("long").alias("n"), F.sha2("kept", 256).alias("sha"))
    rows = docs.select("doc_id", "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    return rows.join(lost, "doc", "left").select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.coalesce("left", "n_bytes")).alias("n_removed"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
    )
