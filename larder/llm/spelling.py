"""Words that differ by one character, grouped under their most frequent form, by pivotal grams.

Every occurrence of a word is counted; ``misspelt`` deletes one character of a fixed share of them. The bigrams of all words have
one global order, rare ones first. A word's prefix is its three first bigrams in that order (and further places of
the third); its pivots are two disjoint bigrams of the prefix, chosen by dynamic programming for the least total frequency.
One edit leaves one pivot of two near words whole, and that bigram is in the prefix of the word whose prefix ends later.

The position limit is exact: a surviving bigram stands at the same place from the front, with all text before it equal,
when the edit comes after it, and at the same place from the back, with all text after it equal, when the edit comes
before it. So each prefix bigram is indexed under either fixed text, pivots are met by prefix bigrams there, and the remaining
texts are verified. Near remainders are found by their forms without one character, never by comparing all pairs of a list.
Lists longer than ``LONG_LIST`` are spread over the cluster by those forms; no list is cut.

Defined cases: a null text has no words; a null id is written as empty text in ``misspelt``; repeated rows count again; very long
texts and words are treated whole; ties of a form go to the smallest word; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import map_arrow, partitions, texts
from larder.session import settle

SHORTEST = 7  # code points
LEAST = 2  # occurrences
TIMES = 10  # how much more frequent a form must be
MISSPELT = 31  # one in so many occurrences loses a character
GRAMS_IN_PREFIX = 3  # (edits + 1) * 2 - 1: always holds two disjoint bigrams
LONG_LIST = 20_000
#: Distinct words that a task holds before it passes them on; a memory setting, results do not depend on it.
HELD = 400_000
#: Latin-1 bytes: A-Z lower-cased, other letters of the pattern kept, the rest blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def misspelt(word: bytes, start: int) -> bytes:
    """The Latin-1 ``word``, without one character if the crc32 begun with ``start`` says so."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % MISSPELT:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(df: DataFrame) -> DataFrame:
    """(word, n) of the words of at least ``SHORTEST`` code points with at least ``LEAST`` occurrences."""

    def work(batches):
        held: Counter = Counter()

        def rows():
            return {"word": [w.decode("latin-1") for w in held], "n": np.fromiter(held.values(), np.int64, len(held))}

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                # One byte per code point; what lies outside Latin-1 ends a word.
                found = Counter(text.encode("latin-1", "replace").translate(LETTERS).split())
                for word, n in found.items():
                    if len(word) >= SHORTEST:
                        word = misspelt(word, start)
                        if len(word) >= SHORTEST:
                            held[word] += n
            if len(held) > HELD:
                yield rows()
                held.clear()
        yield rows()

    partial = map_arrow(df.select("doc_id", "text"), work, "word STRING, n LONG")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """Number of places of every bigram over all distinct words; there are at most 90 * 90 bigrams of these letters."""

    def work(batches):
        counts: Counter = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                counts.update(map(str.__add__, word, word[1:]))
        yield {"gram": list(counts), "n": np.fromiter(counts.values(), np.int64, len(counts))}

    found = map_arrow(words.select("word"), work, "gram STRING, n LONG").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in found.collect()}


def choose_pivots(places: list[int], weights: list[int], pivots=2) -> list[int]:
    """Indices of ``pivots`` pairwise disjoint bigrams of least total weight; ``places`` ascend.

    Dynamic programming over (bigrams so far, pivots taken): a bigram is skipped, or taken after those that end before it.
    """
    best = [[(0, ())] + [None] * pivots]
    for i, (place, weight) in enumerate(zip(places, weights)):
        free = max((k + 1 for k in range(i) if places[k] + 2 <= place), default=0)
        row = list(best[i])
        for taken in range(1, pivots + 1):
            before = best[free][taken - 1]
            if before is not None and (row[taken] is None or before[0] + weight < row[taken][0]):
                row[taken] = before[0] + weight, (*before[1], i)
        best.append(row)
    return list(best[-1][pivots][1])


def prefix_and_pivots(word: str, rank: dict[str, int], weight: dict[str, int]) -> list[tuple[int, bool]]:
    """(place, is a pivot) of the bigrams in the word's prefix."""
    ranked = sorted([(rank[g], at) for at, g in enumerate(map(str.__add__, word, word[1:]))])
    last = ranked[GRAMS_IN_PREFIX - 1][0]
    places = sorted(at for _, at in ranked[:GRAMS_IN_PREFIX])
    pivots = {places[i] for i in choose_pivots(places, [weight[word[at : at + 2]] for at in places])}
    return [(at, at in pivots) for r, at in ranked if r <= last]


def lists(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(list, rest, pivot, n): every prefix bigram under the text up to its end and under the text from its start."""
    rank = {g: i for i, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0])))}

    def work(batches):
        for batch in batches:
            key, rest, pivot, count = [], [], [], []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for at, is_pivot in prefix_and_pivots(word, rank, counts):
                    key += ("<" + word[: at + 2], ">" + word[at:])
                    rest += (word[at + 2 :], word[:at])
                    pivot += (is_pivot, is_pivot)
                    count += (n, n)
            yield {"list": key, "rest": rest, "pivot": pivot, "n": count}

    return map_arrow(words, work, "list STRING, rest STRING, pivot BOOLEAN, n LONG")


def near_rests(rests: list[str], pivots: list[bool]):
    """(i, j) of the distinct texts that differ by one inserted, deleted or replaced character, one of them a pivot's."""
    at = {rest: i for i, rest in enumerate(rests)}
    replaced = defaultdict(list)
    for i, rest in enumerate(rests):
        shorter = {rest[:k] + rest[k + 1 :] for k in range(len(rest))}
        for form in shorter:
            j = at.get(form)
            if j is not None and (pivots[i] or pivots[j]):
                yield i, j
        for k in range(len(rest)):
            replaced[k, rest[:k] + rest[k + 1 :]].append(i)
    for same in replaced.values():
        for x, i in enumerate(same):
            for j in same[x + 1 :]:
                if pivots[i] or pivots[j]:
                    yield i, j


_PAIRS = "a STRING, b STRING, n_a LONG, n_b LONG"


def _pairs_of(key: str, members: list[tuple[str, bool, int]], found=near_rests):
    rests, pivots, counts = map(list, zip(*members))
    front, fixed = key[0] == "<", key[1:]
    out = []
    for i, j in found(rests, pivots):
        a, b = (fixed + rests[i], fixed + rests[j]) if front else (rests[i] + fixed, rests[j] + fixed)
        out.append((a, b, counts[i], counts[j]) if a < b else (b, a, counts[j], counts[i]))
    return out


def _grouped(rows: DataFrame, width: int, pairs) -> DataFrame:
    """``pairs(key, members)`` of the runs of rows that agree in their first ``width`` columns."""

    def columns(done):
        return dict(zip(("a", "b", "n_a", "n_b"), map(list, zip(*done)))) if done else {"a": [], "b": [], "n_a": [], "n_b": []}

    def work(batches):
        group, members, done = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:width] != group:
                    if len(members) > 1:
                        done += pairs(group, members)
                    group, members = row[:width], []
                members.append(row[width:])
            if len(done) > 20_000:
                yield columns(done)
                done = []
        if len(members) > 1:
            done += pairs(group, members)
        yield columns(done)

    return map_arrow(rows, work, _PAIRS)


def _pairs_by_form(rows: DataFrame) -> DataFrame:
    """The pairs of long lists: their remainders meet by their forms without one character.

    ``at`` is the place of the replaced character, or -1 where a whole remainder meets the longer ones. A group holds one
    remainder per character that can stand at one place (of 90), or those with one character more.
    """

    def work(batches):
        for batch in batches:
            out = {name: [] for name in ("list", "at", "form", "rest", "pivot", "n")}
            for key, rest, pivot, n in zip(*(c.to_pylist() for c in batch.columns)):
                forms = [(-1, rest)] + [(-1, f) for f in {rest[:k] + rest[k + 1 :] for k in range(len(rest))}]
                forms += [(k, rest[:k] + rest[k + 1 :]) for k in range(len(rest))]
                for at, form in forms:
                    for name, value in zip(out, (key, at, form, rest, pivot, n)):
                        out[name].append(value)
            yield out

    spread = map_arrow(rows, work, "list STRING, at INT, form STRING, rest STRING, pivot BOOLEAN, n LONG")
    spread = spread.repartition(partitions(rows.sparkSession), "list", "at", "form").sortWithinPartitions("list", "at", "form", "rest")

    def pairs(group, members):
        key, at, form = group

        def found(rests, pivots):
            whole = [i for i, rest in enumerate(rests) if rest == form]
            for x in whole if at < 0 else range(len(rests)):
                for y in range(len(rests)) if at < 0 else range(x + 1, len(rests)):
                    if x != y and (pivots[x] or pivots[y]):
                        yield x, y

        return _pairs_of(key, members, found)

    return _grouped(spread, 3, pairs)


def near_pairs(words: DataFrame, long_list=None) -> DataFrame:
    """(a, b, n_a, n_b), a < b: all pairs of words (word, n) that differ by one character."""
    entries = settle(lists(words, gram_counts(words)), "lists")
    sizes = entries.groupBy("list").agg(F.count("*").alias("rows"))
    long = settle(sizes.where(F.col("rows") > (long_list or LONG_LIST)).select("list"), "long-lists")
    usual = entries.join(long, "list", "left_anti").repartition(partitions(words.sparkSession), "list").sortWithinPartitions("list")
    found = _grouped(usual, 1, lambda group, members: _pairs_of(group[0], members))
    return found.union(_pairs_by_form(entries.join(long, "list", "left_semi"))).distinct()


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root) for ``links`` (word, form): forms followed to the last, by doubling.

    Counts grow ``TIMES``-fold along a chain, so a chain of 64-bit counts has under 20 links.
    """
    steps = links.select("word", F.col("form").alias("root"))
    while True:
        steps = settle(steps, "forms")
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = steps.join(further, "root", "left")
        if jumped.where("next IS NOT NULL").isEmpty():
            return steps
        steps = jumped.select("word", F.coalesce("next", "root").alias("root"))


def variant_groups(df: DataFrame, long_list=None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word."""
    words = settle(word_counts(df), "words")
    pairs = near_pairs(words, long_list)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                              F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    best = F.min(F.struct((-F.col("near_n")).alias("low"), F.col("near")))
    near = pairs.select(sides.alias("s")).select("s.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    found = -F.col("best.low") >= TIMES * F.col("n")
    joined = settle(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(found, F.col("best.near")).alias("form"), F.when(found, -F.col("best.low")).alias("form_n"),
    ), "near")
    roots = last_forms(joined.where("form IS NOT NULL"))
    rows = joined.join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _crc_sql() -> str:
    """crc32 of the list ``bytes`` in SQL, with the table made from the reversed polynomial."""
    table = [reduce(lambda r, _: (r >> 1) ^ (0xEDB88320 if r & 1 else 0), range(8), i) for i in range(256)]
    return f"xor(list_reduce(bytes, lambda crc, b: xor(crc >> 8, {table}[xor(crc & 255, b) + 1]), 4294967295), 4294967295)"


ORACLE = f"""
WITH RECURSIVE runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= {SHORTEST} GROUP BY id, run),
hashed AS (
  SELECT run, n, {_crc_sql()} AS h
  FROM (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''),
               lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS bytes FROM runs)),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {MISSPELT} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                    ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
forms AS MATERIALIZED (
  SELECT word, n, place, substr(word, 1, CAST(place AS BIGINT) - 1) || substr(word, CAST(place AS BIGINT) + 1) AS short
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM forms a JOIN forms b ON a.place = b.place AND a.short = b.short AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM forms a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word, a.n FROM forms a JOIN words b ON a.short = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
chosen AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {TIMES} * w.n THEN top END AS form_n,
         CASE WHEN top >= {TIMES} * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.other_n = top) END AS form
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS place, 0 AS step FROM chosen
  UNION ALL SELECT chain.word, chosen.form, step + 1 FROM chain JOIN chosen ON chosen.word = chain.place WHERE chosen.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n
FROM chosen JOIN (SELECT word, arg_max(place, step) AS root FROM chain GROUP BY word) USING (word)
"""
