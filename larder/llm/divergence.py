"""How far sources of one language differ in their words: exact term shares compared between all groups in a cube of cells.

A group is a (lang, source). Each language keeps the terms that occur in at least ``MIN_DOCS`` of its documents. A group gives
every kept term the share p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)); two shares differ by floor((p - q)^2 / (p + q)).

The groups of a language are cut into blocks by hash of the source and its kept terms into slabs by hash of the term. A cell
(block, block, slab) owns all pairs of groups of its two blocks over the terms of its slab: it receives the slices of both
blocks, replicated once per partner block, and returns one partial sum per pair. Terms that a cell receives from no group have the
share of count 0 on both sides, so their number is enough. The partial sums are reduced along the slabs. About
``2 * BLOCK * SLAB`` rows are the most that a cell can hold; a hot source or term is combined before the first shuffle.

Defined cases: null text, lang and source are empty; null or repeated ids and repeated rows are documents of their own; a text without
terms still makes its group occur; a language without kept terms has value 0 for all pairs and no row of part ``term``; very long
texts are counted whole; ties rank by item; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from larder.llm.common import map_arrow, ship_package, texts
from larder.session import settle

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
BLOCK = 32  # groups per block, about
SLAB = 8192  # terms per slab, about
#: Counts that a task holds before it passes them on; a memory setting, results do not depend on it.
HELD = 400_000
#: A-Z lower-cased, other letters and all bytes of longer characters kept, the rest blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(df: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term."""

    def work(batches):
        counts, docs, held = defaultdict(Counter), defaultdict(Counter), 0

        def rows():
            for (lang, source), found in counts.items():
                if found:
                    size, having = len(found), docs[lang, source]
                    yield {
                        "lang": [lang] * size, "source": [source] * size, "term": list(found),
                        "n": np.fromiter(found.values(), np.int64, size), "docs": np.fromiter(map(having.__getitem__, found), np.int64, size),
                    }

        for batch in batches:
            for lang, source, text in zip(texts(batch, "lang"), texts(batch, "source"), texts(batch)):
                words = text.encode().translate(LETTERS).split()
                found = counts[lang, source]
                before = len(found)
                found.update(words)
                docs[lang, source].update(set(words))
                held += len(found) - before
                if held > HELD:
                    yield from rows()
                    counts.clear()
                    docs.clear()
                    held = 0
        yield from rows()

    source = df.select(F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    partial = map_arrow(source, work, "lang STRING, source STRING, term STRING, n LONG, docs LONG")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count, total, terms):
    """Exact integer share of a term."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0))) div CAST({total} + 2 * {terms} AS DECIMAL(20,0))")


def cell_sums(left: np.ndarray, right: np.ndarray, left_none: np.ndarray, right_none: np.ndarray, absent: int) -> np.ndarray:
    """Divergence of each pair of rows (shares per term), and of ``absent`` terms more with the shares of count 0."""
    out = np.empty((len(left), len(right)), np.int64)
    for i, (p, none) in enumerate(zip(left, left_none)):
        out[i] = ((right - p) ** 2 // (right + p)).sum(axis=1) + absent * ((right_none - none) ** 2 // (right_none + none))
    return out


def _cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    lang, first, second, _ = (k.as_py() for k in key)
    heads = table.filter(pc.is_null(table["term"]))
    names, block, none = heads["source"].to_pylist(), heads["block"].to_numpy(), heads["p"].to_numpy()
    terms = heads["terms"][0].as_py()
    rows = table.filter(pc.is_valid(table["term"]))
    at = {name: i for i, name in enumerate(names)}
    encoded = rows["term"].combine_chunks().dictionary_encode()
    shares = np.repeat(none[:, None], len(encoded.dictionary), axis=1)
    shares[np.fromiter(map(at.__getitem__, rows["source"].to_pylist()), np.int64, rows.num_rows), encoded.indices.to_numpy()] = rows["p"].to_numpy()
    a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
    sums = cell_sums(shares[a], shares[b], none[a], none[b], terms - shares.shape[1])
    i, j = np.nonzero(np.triu(np.ones(sums.shape, bool), 1) if first == second else np.ones(sums.shape, bool))
    name = np.array(names, object)
    return pa.table({
        "lang": pa.array([lang] * len(i), pa.string()), "a": pa.array(name[a[i]], pa.string()),
        "b": pa.array(name[b[j]], pa.string()), "part": pa.array(sums[i, j], pa.int64()),
    })


def audit(df: DataFrame, min_docs=MIN_DOCS, top=TOP, block=None, slab=None) -> DataFrame:
    """(lang, source, part, item, value, rank): every group against each other source of its language, and its ``top`` own terms."""
    ship_package(df.sparkSession)
    block, slab = block or BLOCK, slab or SLAB
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = df.select(text("lang"), text("source"), text("text"))
    counts = settle(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = settle(kept.select("lang", "term", "total"), "kept-terms")
    held = settle(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept-counts")

    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    groups = docs.select("lang", "source").distinct().join(held.groupBy("lang", "source").agg(F.sum("n").alias("own_total")), ["lang", "source"], "left")
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    groups = groups.join(sizes, "lang").join(langs, "lang", "left").na.fill(0, ["own_total", "terms", "lang_total"])
    groups = groups.withColumn("slabs", F.greatest(F.lit(1), F.ceil(F.col("terms") / slab)).cast("long"))
    groups = settle(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))), "groups")

    in_slab = F.pmod(F.xxhash64("term", F.lit("slab")), F.col("slabs")).alias("slab")
    known = held.join(groups, ["lang", "source"]).withColumn("p", share("n", "own_total", "terms")).withColumn("q", share("total", "lang_total", "terms"))
    slices = known.select("lang", "source", "term", "p", "block", "blocks", in_slab, F.lit(None).cast("long").alias("terms"))
    per_slab = kept.join(groups.select("lang", "slabs").distinct(), "lang").groupBy("lang", in_slab).agg(F.count("*").alias("in_slab"))
    heads = groups.withColumn("p", F.when(F.col("terms") > 0, share("0", "own_total", "terms")).otherwise(F.lit(1)))
    heads = heads.drop("terms").withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slabs") - 1))).join(per_slab, ["lang", "slab"], "left")
    heads = heads.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), "p", "block", "blocks", "slab", F.coalesce("in_slab", F.lit(0)).alias("terms")
    )
    rows = slices.unionByName(heads).withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(
        "lang", F.least("block", "partner").alias("first"), F.greatest("block", "partner").alias("second"), "slab", "source", "term", "p", "block", "terms"
    )
    cells = rows.groupBy("lang", "first", "second", "slab").applyInArrow(_cell, "lang STRING, a STRING, b STRING, part LONG")
    sums = cells.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", sides.alias("side"), "value").select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    own = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    return pairs.select("*", rank).union(own.select("*", rank).where(F.col("rank") <= top))


ORACLE = f"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS doc FROM documents),
words AS (
  SELECT lang, source, doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
         1 + ({SCALE}::HUGEINT * (coalesce(c, 0) + 2)) // (coalesce(t.n, 0) + 2 * v)::HUGEINT AS p,
         1 + ({SCALE}::HUGEINT * (total + 2)) // (l.n + 2 * v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts USING (lang, source, term) LEFT JOIN totals t USING (lang, source)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(f), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, ((x.p - y.p) * (x.p - y.p)) // (x.p + y.p) AS f
             FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term) z ON z.lang = a.lang AND z.s = a.source AND z.t = b.source
  GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE c > 0 AND p > q),
both_parts AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT) FROM terms)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= {TOP}
"""
