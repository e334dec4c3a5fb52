"""Near-duplicate groups by exact Jaccard similarity of word n-grams: blocked sparse products of document by n-gram incidence.

1. Documents with equal n-gram sets form a class; only class representatives (smallest id) are compared.
2. First product: classes whose smallest n-gram agrees, under one of ``ORDERS`` hash orders, lie in one bucket. Buckets are cut
   into blocks of about ``BLOCK`` rows, large ones by bands of sizes first; rows whose sketches rule out all others of their block
   leave it, and each block multiplies the incidence matrix of its rows with its transpose. Only a spanning forest of the links found leaves a task. Then blocks of a bucket are
   multiplied with each other, but for those whose rows are one group by now and those whose sizes differ too much to be
   similar. This settles all pairs of a bucket, of any size.
3. Second product, complete: two sets can only be similar enough if they share an n-gram among the first few of each in
   one global order (frequent n-grams last, then by hash). Only pairs of rows in different groups and no common bucket matter.
   N-grams of at most ``SHORT`` sets accumulate how many of them each pair shares, and pairs whose count cannot reach the
   bound that follows from their sizes are discarded; longer lists pass the pairs that their sketches cannot rule out, whatever they
   share elsewhere. What is left is intersected exactly.
4. Links of both products go through connected components.

A sketch is the parity of a set's n-grams per bucket of a hash. Where two sketches differ the sets differ, each difference in one bucket,
so their intersection is at most half of what their sizes exceed the number of differing buckets by: no similar pair is ruled out.

Frequent n-grams are counted over all documents; at most ``MOST_FREQUENT`` are broadcast (the limit rises with the data, and
the order may be any order, so this never changes a result).

Defined cases: null or empty texts have no n-gram, link with nothing and are their own component; null ids are compared
with nothing and get a null component; rows with equal id and text repeat; rows with equal id and different texts are documents of
their own, each in the group of its text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from larder.llm.common import (
    bit_filter, bit_of, connected_components, fresh_name, map_arrow, mix, partitions, passes, pieces, release_memory, ship_package, texts,
)
from larder.llm.shingles import shingle_sets
from larder.session import settle

BLOCK = 512
ORDERS = 3
MOST_FREQUENT = 1 << 20
FREQUENT = 64
COLUMNS = 4096
SHORT = 4
SKETCH = 64  # bytes at least; larger for sets of more than 16 n-grams a byte


def prefix_length(n, percent):
    """How many n-grams of a set must be indexed so that every similar set shares one."""
    return n - (percent * n + 99) // 100 + 1


def needed_overlap(a, b, percent):
    """Least intersection of similar sets of sizes ``a`` and ``b``."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def digest_of(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def in_order(values: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set in the global order: those not in ``frequent`` first, each part by hash."""
    if not len(frequent):
        return values
    at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
    late = frequent[at] == values
    return np.concatenate([values[~late], values[late]])


def smallest(values: np.ndarray) -> list[int]:
    """The smallest n-gram of a set under each order; the first order is the hash itself."""
    seeds = np.arange(1, ORDERS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [int(_signed(values[:1])[0]), *(int(_signed(mix(values ^ seed).min(keepdims=True))[0]) for seed in seeds)]


def sketch(values: np.ndarray) -> bytes:
    """Parity of the n-grams in each bucket; as many buckets as half the set at least, a power of two."""
    buckets = 8 * SKETCH
    while 2 * buckets < len(values):
        buckets *= 2
    at = (values & np.uint64(buckets - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=buckets) & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of rows; ``possible`` tells which pairs of rows they leave. Longer ones are folded to the shorter one's length."""

    def __init__(self, blobs: list[bytes], sizes: np.ndarray, percent: int):
        self.blobs, self.sizes, self.percent = blobs, sizes, percent
        self.bytes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of the table of each row, sketches folded to ``size`` bytes) of all rows with sketches as long or longer."""
        if size not in self.tables:
            place, parts, first = np.zeros(len(self.blobs), np.int64), [], 0
            for long in np.unique(self.bytes[self.bytes >= size]).tolist():
                rows = np.flatnonzero(self.bytes == long)
                whole = np.frombuffer(b"".join([self.blobs[i] for i in rows.tolist()]), np.uint64)
                parts.append(np.bitwise_xor.reduce(whole.reshape(len(rows), long // size, size // 8), axis=1))
                place[rows] = np.arange(first, first + len(rows))
                first += len(rows)
            self.tables[size] = place, np.concatenate(parts)
        return self.tables[size]

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = self.sizes[i] + self.sizes[j]
        # At most so many n-grams stand in one set alone.
        most = total - 2 * needed_overlap(self.sizes[i], self.sizes[j], self.percent)
        out, shorter = most >= np.abs(self.sizes[i] - self.sizes[j]), np.minimum(self.bytes[i], self.bytes[j])
        for size in np.unique(shorter[out]).tolist():
            place, table = self.table(size)
            for at in np.array_split(mine := np.flatnonzero(out & (shorter == size)), 1 + len(mine) * size // (1 << 24)):
                differing = np.bitwise_count(table[place[i[at]]] ^ table[place[j[at]]]).sum(axis=1, dtype=np.int64)
                out[at] = differing <= most[at]
        return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def scan(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, digest, firsts, low, sketch) per row: set size, digest, smallest n-grams, the first n-grams by hash, sketch."""

    def work(batches):
        for batch in (piece for whole in batches for piece in pieces(whole)):
            sets = shingle_sets(texts(batch), size)
            yield {
                "doc_id": batch.column("doc_id"), "n": [len(s) for s in sets], "digest": [digest_of(s) for s in sets],
                "firsts": [smallest(s) if len(s) else [] for s in sets],
                "low": [_signed(s[: prefix_length(len(s), percent)]) if len(s) else [] for s in sets],
                "sketch": list(map(sketch, sets)),
            }

    return map_arrow(docs, work, "doc_id LONG, n LONG, digest LONG, firsts ARRAY<LONG>, low ARRAY<LONG>, sketch BINARY")


def some_sets(docs: DataFrame, wanted: DataFrame, size: int, by_digest: bool) -> DataFrame:
    """(node, values) of the documents ``wanted`` (rep) and of few others; a bit filter of fixed size spares these the work."""
    shared = bit_filter(wanted, "rep")

    def work(batches):
        for batch in batches:
            for piece in pieces(batch.take(passes(shared, batch.column("bit")))):
                sets = shingle_sets(texts(piece), size)
                node = [digest_of(s) for s in sets] if by_digest else piece.column("doc_id")
                yield {"node": node, "values": [s.tobytes() for s in sets]}

    source = docs.where("doc_id IS NOT NULL").withColumn("bit", bit_of("doc_id"))
    found = map_arrow(source, work, "node LONG, values BINARY")
    return found.dropDuplicates(["node"]) if by_digest else found


def find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def block_links(sets: list[np.ndarray], percent: int, left=0) -> list[tuple[int, int]]:
    """Spanning forest of the links within a block: its incidence matrix, column block by column block, times its transpose.

    With ``left``, links between the first ``left`` rows and the others.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    end = left or len(sets)
    overlap = np.zeros((end, len(sets) - left), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        block = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - start)), np.float32)
        block[row[a:b], column[a:b] - start] = 1
        overlap += block[:end] @ block[left:].T
    near = overlap >= needed_overlap(sizes[:end, None], sizes[None, left:], percent)
    parent, forest = np.arange(len(sets)), []
    for i, j in zip(*np.nonzero(near if left else np.triu(near, 1))):
        i, j = int(i), int(j) + left
        a, b = find(parent, i), find(parent, j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            forest.append((i, j))
    return forest


def buckets(classes: DataFrame, percent: int) -> DataFrame:
    """(order, first, rows, band, node, rep): classes that share a smallest n-gram, by bucket.

    Of buckets with equal nodes one stays. In buckets beyond ``BLOCK`` rows, sets similar enough lie in the same or in neighbouring bands of sizes.
    """
    rows = classes.select("node", "rep", "n", F.posexplode("firsts").alias("order", "first"))
    nodes = [F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("mixed"), F.min("node").alias("least"), F.max("node").alias("most")]
    found = rows.groupBy("order", "first").agg(*nodes).where("rows > 1")
    found = found.groupBy("rows", "mixed", "least", "most").agg(F.min(F.struct("order", "first")).alias("at")).select("at.order", "at.first", "rows")
    width = np.log(100 / percent) + 1e-9
    band = F.when(F.col("rows") > BLOCK, F.floor(F.log("n") / float(width))).otherwise(F.lit(0).cast("long"))
    return rows.join(found, ["order", "first"]).select("order", "first", "rows", band.alias("band"), "node", "rep")


def promising(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The rows (block, side, node, rep) that some other row of their block, on the other side if it has two, may be similar to."""
    names = ("block", "side", "node", "rep")
    rows = rows.join(classes.select("node", "n", "sketch"), "node").select(*names, "n", "sketch")
    rows = rows.repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block", "side", "node")

    def work(batches):
        key, block = None, []

        def kept():
            sides, nodes, sizes, sketches = ([r[k] for r in block] for k in (1, 2, 4, 5))
            left = sides.count(0) if sides and sides[-1] else 0
            found = Sketches(sketches, np.array(sizes, np.int64), percent)
            i, j = np.indices((left, len(block) - left)).reshape(2, -1) if left else np.triu_indices(len(block), 1)
            j = j + left
            near = found.possible(i, j) & (np.array(nodes, np.int64)[i] != np.array(nodes, np.int64)[j])
            mine = np.unique(np.concatenate([i[near], j[near]])).tolist()
            return {name: [block[k][c] for k in mine] for c, name in enumerate(names)}

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key:
                    if len(block) > 1:
                        yield kept()
                    key, block = row[0], []
                block.append(row)
        if len(block) > 1:
            yield kept()

    return settle(map_arrow(rows, work, "block LONG, side INT, node LONG, rep LONG"), "promising")


def block_product(docs: DataFrame, rows: DataFrame, classes: DataFrame, size: int, percent: int, by_digest: bool) -> DataFrame:
    """Links (a, b) within each block of ``rows`` (block, side, node, rep); where a block has two sides, those between them."""
    rows = promising(rows, classes, percent)
    sets = some_sets(docs, rows.select("rep").distinct(), size, by_digest)
    rows = rows.join(sets, "node").select("block", "side", "node", "values")
    rows = rows.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "side", "node")

    def work(batches):
        key, nodes, sets, sides = None, [], [], []

        def links():
            left = sides.count(0) if sides and sides[-1] else 0
            found = block_links(sets, percent, left) if len(sets) > 1 else []
            return {"a": [nodes[i] for i, _ in found], "b": [nodes[j] for _, j in found]}

        for batch in batches:
            for block, side, node, values in zip(*(c.to_pylist() for c in batch.columns)):
                if block != key:
                    yield links()
                    key, nodes, sets, sides = block, [], [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(values, np.uint64))
                    sides.append(side)
        yield links()

    return settle(map_arrow(rows, work, "a LONG, b LONG"), "links")


def first_product(docs: DataFrame, placed: DataFrame, classes: DataFrame, size: int, percent: int, by_digest: bool) -> DataFrame:
    """Links (a, b) within blocks of about ``BLOCK`` rows of one bucket and band; each row lies in one block of each of its buckets."""
    bands = placed.groupBy("order", "first", "band").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    rows = placed.join(bands, ["order", "first", "band"])
    block = F.xxhash64("order", "first", "band", F.pmod(F.xxhash64("node", "order"), F.col("blocks")))
    rows = settle(rows.select(block.alias("block"), F.lit(0).alias("side"), "node", "rep"), "blocks")
    return block_product(docs, rows, classes, size, percent, by_digest)


def across_blocks(docs: DataFrame, placed: DataFrame, groups: DataFrame, classes: DataFrame, size: int, percent: int, by_digest: bool) -> DataFrame | None:
    """Links (a, b) between the blocks of a bucket, for rows still in different groups; None where no bucket needs it.

    Rows of a group that fills blocks of a band get blocks of their own, which need not meet each other; bands further apart than one never meet.
    """
    at = ["order", "first", "band"]
    hot = placed.where(F.col("rows") > BLOCK).join(groups, "node", "left")
    hot = settle(hot.select(*at, "node", "rep", F.coalesce("component", "node").alias("group")), "hot")
    large = F.col("count") >= BLOCK
    kinds = hot.groupBy(*at, "group").count().select(*at, "group", large.alias("pure"), F.when(large, F.col("group")).otherwise(0).alias("kind"))
    rows = hot.join(kinds, [*at, "group"])
    cells = rows.groupBy(*at, "pure", "kind").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    one = cells.select(*at, "pure", "kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))
    one = one.select(*at, "pure", "kind", F.xxhash64(*at, "pure", "kind", "k").alias("id"))
    other = one.select("order", "first", F.col("band").alias("own"), *(F.col(c).alias(f"other_{c}") for c in ("pure", "kind", "id")))
    other = other.withColumn("band", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    meet = one.join(other, at).where("(own > band OR id <= other_id) AND NOT (pure AND other_pure AND kind = other_kind)")
    meet = settle(meet.select(F.xxhash64("id", "other_id").alias("block"), "id", "other_id"), "meetings")
    if meet.isEmpty():
        return None
    sides = meet.select("block", "id", F.lit(0).alias("side")).union(meet.where("id <> other_id").select("block", "other_id", F.lit(1)))
    rows = rows.join(cells, [*at, "pure", "kind"])
    rows = rows.select(F.xxhash64(*at, "pure", "kind", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("id"), "node", "rep")
    return block_product(docs, settle(rows.join(sides, "id").select("block", "side", "node", "rep"), "sides"), classes, size, percent, by_digest)


def prefix_entries(docs: DataFrame, frequent, size: int, percent: int) -> DataFrame:
    """(gram, digest, n): the first n-grams of each distinct set of a batch in the global order."""

    def work(batches):
        for batch in batches:
            seen = set()
            for piece in pieces(batch):
                grams, digests, sizes = [], [], []
                for s in shingle_sets(texts(piece), size):
                    if len(s) and (digest := digest_of(s)) not in seen:
                        seen.add(digest)
                        head = in_order(s, frequent.value)[: prefix_length(len(s), percent)]
                        grams.append(_signed(head))
                        digests.append(np.full(len(head), digest))
                        sizes.append(np.full(len(head), len(s)))
                if grams:
                    yield {"gram": np.concatenate(grams), "digest": np.concatenate(digests), "n": np.concatenate(sizes)}

    return map_arrow(docs, work, "gram LONG, digest LONG, n LONG")


def _columns(batches, names):
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64) for _ in names]


def shared_entries(entries: DataFrame) -> DataFrame:
    """(gram, digest, n, sets): entries whose n-gram lies in at least two different sets, with their number."""

    def work(batches):
        gram, digest, n = _columns(batches, "gdn")
        order = np.lexsort((digest, gram))
        gram, digest, n = gram[order], digest[order], n[order]
        new = np.append(True, (gram[1:] != gram[:-1]) | (digest[1:] != digest[:-1])) if len(gram) else np.zeros(0, bool)
        gram, digest, n = gram[new], digest[new], n[new]
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        number = np.diff(np.append(starts, len(gram)))
        sets = np.repeat(number, number)
        keep = sets > 1
        yield {"gram": gram[keep], "digest": digest[keep], "n": n[keep], "sets": sets[keep]}

    return map_arrow(entries.repartition(partitions(entries.sparkSession), "gram"), work, "gram LONG, digest LONG, n LONG, sets LONG")


def partial_counts(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, c): pairs not compared yet in a block of n-grams, and how many of these n-grams they share.

    Rows of long lists come with their sketches; a pair that these leave counts as sharing all, so it reaches any bound.
    """

    def work(batches):
        batches = [b for b in batches if b.num_rows]
        gram, rep, group, n, *firsts = _columns(batches, range(4 + ORDERS))
        order = np.lexsort((rep, n, gram))
        gram, rep, group, n = gram[order], rep[order], group[order], n[order]
        firsts = np.stack([f[order] for f in firsts])
        blobs = [x or b"" for b in batches for x in b.column("sketch").to_pylist()]
        sketches = Sketches([blobs[i] for i in order.tolist()], n, percent)
        del blobs
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        end = np.repeat(np.append(starts[1:], len(gram)), np.diff(np.append(starts, len(gram)))) if len(gram) else starts
        # Within an n-gram rows are ordered by size: partners of i are those up to the largest size that can be similar.
        limit = np.array([], np.int64)
        if len(gram):
            key = np.cumsum(np.append(0, gram[1:] != gram[:-1])).astype(np.int64) * (1 << 40)
            limit = np.minimum(np.searchsorted(key + n, key + (100 * n) // percent, side="right"), end)
        at = np.arange(len(gram))
        step, found = 0, []
        while True:
            step += 1
            at = at[at + step < limit[at]]
            if not len(at):
                break
            i, j = at, at + step
            apart = (group[i] != group[j]) & (firsts[:, i] != firsts[:, j]).all(axis=0)
            i, j = i[apart], j[apart]
            known = sketches.bytes[i] > 0  # a whole list has sketches or none has
            left = ~known
            left[known] = sketches.possible(i[known], j[known])
            i, j, known = i[left], j[left], known[left]
            swap = rep[i] > rep[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            found.append(np.stack([rep[i], rep[j], n[i], n[j], np.where(known, np.minimum(n[i], n[j]), 1)], 1))
            if sum(map(len, found)) > 500_000:
                found = [_counted(found)]
                if len(found[0]) > 250_000:
                    yield _named(found.pop())
        yield _named(_counted(found))

    rows = entries.repartition(partitions(entries.sparkSession), "gram")
    return map_arrow(rows, work, "a LONG, b LONG, na LONG, nb LONG, c LONG")


def _counted(found):
    """Rows (a, b, na, nb, c) with the counts of equal pairs added."""
    pairs = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    starts = np.flatnonzero(np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1))) if len(pairs) else np.zeros(0, np.int64)
    out = pairs[starts]
    if len(starts):
        out[:, 4] = np.add.reduceat(pairs[:, 4], starts)
    return out


def _named(pairs):
    return {name: pairs[:, k] for k, name in enumerate(("a", "b", "na", "nb", "c"))}


def second_product(docs, low, classes, groups, size, percent, by_digest) -> DataFrame:
    """All links (a, b) between the nodes of classes that the first product left in different groups."""
    spark = docs.sparkSession
    grams = low.select(F.explode("low").alias("gram"))
    total = low.select(F.sum(F.size("low"))).first()[0] or 0
    least = max(FREQUENT, total // MOST_FREQUENT + 1)
    often = grams.groupBy("gram").count().where(F.col("count") >= least).select("gram").toPandas()["gram"].to_numpy(np.int64)
    frequent = spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))
    entries = settle(shared_entries(prefix_entries(docs, frequent, size, percent)), "entries")
    grouped = classes.join(groups, "node", "left").select("digest", "node", F.coalesce("component", "node").alias("group"), "firsts", "sketch")
    named = entries.join(grouped, "digest").select(
        "gram", "node", "group", "n", *(F.col("firsts")[i].alias(f"first{i}") for i in range(ORDERS)), F.when(F.col("sets") > SHORT, F.col("sketch")).alias("sketch")
    )
    pairs = partial_counts(named, percent).groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    rest = lambda n: F.col(n) - (F.col(n) - F.ceil(F.col(n) * percent / 100) + 1)
    bound = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    pairs = settle(pairs.where(F.col("c") + F.greatest(rest("na"), rest("nb")) >= bound).select("a", "b"), "candidates")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = settle(some_sets(docs, wanted.join(classes, "node").select("rep"), size, by_digest), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("values").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("values").alias("y"))

    def work(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for i, (p, q) in enumerate(zip(x, y)):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if len(np.intersect1d(p, q, assume_unique=True)) >= needed_overlap(len(p), len(q), percent):
                    keep.append(i)
            yield {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}

    return settle(map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), work, "a LONG, b LONG"), "links")


def labelled(df: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, digest, group, component) per row; ``group`` is one value for each group of similar sets, null for an empty set."""
    docs = df.select(F.col("doc_id").cast("long"), "text")
    low = settle(scan(docs, size, percent), "sets")
    classes = low.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("firsts").alias("firsts"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = settle(classes, "classes")
    # Where an id stands on rows with different texts it may represent several classes, which are then told apart by digest.
    by_digest = classes.groupBy("rep").count().where("count > 1").limit(1).count() > 0
    classes = classes.withColumn("node", F.col("digest" if by_digest else "rep"))
    placed = settle(buckets(classes, percent), "placed")
    links = first_product(docs, placed, classes, size, percent, by_digest)
    groups = settle(connected_components(links), "groups")
    across = across_blocks(docs, placed, groups, classes, size, percent, by_digest)
    if across is not None:
        links = links.union(across)
        groups = settle(connected_components(links), "groups")
    more = second_product(docs, low, classes, groups, size, percent, by_digest)
    final = settle(connected_components(links.union(more)), "groups")
    named = classes.join(final, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("group"))
    if by_digest:
        named = settle(named, "named")
        named = named.join(named.groupBy("group").agg(F.min("rep").alias("component")), "group")
    else:
        named = named.withColumn("component", F.col("group"))
    rows = low.select("doc_id", "n", "digest").join(named.select("digest", "group", "component"), "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n", "digest", "group", F.when(F.col("doc_id").isNotNull(), component).alias("component"))


def jaccard_components(df: DataFrame, size=4, percent=85) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row."""
    return labelled(df, size, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def with_digest(df: DataFrame, name: str, size: int) -> DataFrame:
    """``df`` with the digest of each row's set in the column ``name``."""
    ship_package(df.sparkSession)

    def run(batches):
        try:
            for batch in (piece for whole in batches for piece in pieces(whole)):
                digests = pa.array([digest_of(s) for s in shingle_sets(texts(batch), size)], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, digests], [*batch.schema.names, name])
        finally:
            release_memory()

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, LongType())]))


def keep_one(df: DataFrame, size=5, percent=80) -> DataFrame:
    """The rows of ``df`` that stay when each group of near-duplicates keeps its smallest id; rows without id stay.

    Of rows in one group that share this id one stays, and so does one of the rows with equal id and no n-gram.
    """
    groups = settle(labelled(df, size, percent), "groups")
    name = fresh_name(df, "kept_id")
    kept = groups.where("doc_id = component")
    rows = df.join(kept.select(F.col("doc_id").alias(name)).distinct(), F.col("doc_id").cast("long") == F.col(name), "left_semi")
    if groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        own = fresh_name(df, "set_digest")
        kept = kept.groupBy(F.col("doc_id").alias(name), "group").agg(F.min("digest").alias("kept_digest"))
        rows = with_digest(rows, own, size)
        rows = rows.join(kept, (F.col("doc_id").cast("long") == kept[name]) & (rows[own] == kept["kept_digest"]), "left_semi")
        rows = rows.dropDuplicates(["doc_id", own]).drop(own)
    return rows.unionByName(df.where("doc_id IS NULL"))
