"""Byte-level BPE by a pair-occurrence index.

Within a batch of a partition every distinct word part is laid out once in one symbol array. An index maps each adjacent
pair that has a rank to all its positions. Ranks are applied in ascending order, each to all its positions at once; the
pairs that arise around the merged symbols are added to the lists of their own (always larger) ranks.

Defined cases: a null text counts as empty and gives no ids; special tokens in a text become their id, as the library's
default does; equal rows are encoded per row; an empty table gives no rows. Ids of any text decode to the same text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import map_arrow, texts
from larder.llm.word_tokens import byte_letters

VOCABULARY = "byte_bpe_50k.json"
#: Distinct pieces that a worker remembers; a speed setting, results do not depend on it.
REMEMBERED = 300_000

#: The split of byte-level vocabularies: contractions, letters, digits, other marks (each with one space), white space.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


class PairRanks:
    """Merges as a sorted table from (left, right) to rank; a pair of rank r becomes symbol ``made[r]``."""

    def __init__(self, pairs: np.ndarray, made: np.ndarray):
        if not (pairs.max(axis=1, initial=-1) < made).all() or not (np.diff(made) > 0).all():
            raise ValueError("a merge must only use symbols that earlier merges made")
        keys = pairs[:, 0].astype(np.int64) << 32 | pairs[:, 1]
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.pairs, self.made = keys[self.order], pairs, made

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


class OccurrenceIndex:
    """All positions of each ranked pair, and the queue of active ranks."""

    def __init__(self):
        self.lists: dict[int, list[np.ndarray]] = {}
        self.queue: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        keep = ranks >= 0
        ranks, positions = ranks[keep], positions[keep]
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        bounds = [0, *cuts.tolist(), len(ranks)] if len(ranks) else [0]
        for start, end in zip(bounds, bounds[1:]):
            rank = int(ranks[start])
            if rank not in self.lists:
                self.lists[rank] = []
                heapq.heappush(self.queue, rank)
            self.lists[rank].append(positions[start:end])

    def next(self):
        rank = heapq.heappop(self.queue)
        found = self.lists.pop(rank)
        return rank, np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def alternate(chained: np.ndarray) -> np.ndarray:
    """Of sorted positions, those to merge from the left when ``chained[i]`` says that i overlaps i - 1."""
    starts = np.flatnonzero(~chained)
    run = np.arange(len(chained)) - np.repeat(starts, np.diff(np.append(starts, len(chained))))
    return run % 2 == 0


def merge_all(symbols: np.ndarray, lengths: np.ndarray, ranks: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of consecutive words after all merges, and the new lengths of the words."""
    n, owner = len(symbols), np.repeat(np.arange(len(lengths)), lengths)
    symbols = np.append(symbols.astype(np.int64), -1)
    last = np.append(owner[1:] != owner[:-1], True) if n else np.zeros(0, bool)
    after = np.append(np.where(last, n, np.arange(1, n + 1)), n)
    before = np.append(np.where(np.append(True, last[:-1]), n, np.arange(-1, n - 1)), n) if n else np.array([0])
    alive = np.append(np.ones(n, bool), False)
    index, places = OccurrenceIndex(), np.flatnonzero(~last)
    index.add(ranks.of(symbols[places], symbols[places + 1]), places)
    while index.queue:
        rank, at = index.next()
        left, right = ranks.pairs[rank]
        at = at[alive[at] & (symbols[at] == left)]
        at = at[symbols[after[at]] == right]
        if left == right and len(at) > 1:
            at = at[alternate(np.append(False, after[at[:-1]] == at[1:]))]
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        symbols[at] = ranks.made[rank]
        alive[gone] = False
        after[at] = beyond
        before[beyond] = at
        before[n] = n
        touched = np.unique(np.concatenate([at, before[at]]))
        touched = touched[(touched < n)]
        touched = touched[after[touched] < n]
        index.add(ranks.of(symbols[touched], symbols[after[touched]]), touched)
    kept = np.flatnonzero(alive[:n])
    return symbols[kept], np.bincount(owner[kept], minlength=len(lengths))


class BpeCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        model, letters = found["model"], byte_letters()
        ids = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(ids[a], ids[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.ranks = PairRanks(pairs, np.array([ids[a + b] for a, b in merges], np.int64))
        self.first = np.array([ids[x] for x in letters], np.int64)
        back = {letter: byte for byte, letter in enumerate(letters)}
        self.bytes = {i: bytes(back[c] for c in token) for token, i in ids.items()}
        self.special = {x["content"]: x["id"] for x in found["added_tokens"]}
        self.bytes |= {i: token.encode() for token, i in self.special.items()}
        self.split = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.decimal = {i: str(i).encode() for i in self.bytes}
        #: A space before white space or at the end: such a text is not cut at its spaces.
        self.odd = re.compile(r" (?:\s|\Z)").search
        self.parts: dict[str, tuple] = {}
        #: Decimal ids and decoded bytes of pieces, without and with a space before them.
        self.shown: tuple[dict, dict] = {}, {}
        self.spaced: tuple[dict, dict] = {}, {}

    def learn(self, parts: set[str]) -> None:
        """Ids of word parts that are not known yet."""
        if len(self.parts) > REMEMBERED:
            self.parts = {}
        new = list(parts - self.parts.keys())
        if not new:
            return
        raw = [p.encode() for p in new]
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols, lengths = merge_all(self.first[data], np.array([len(r) for r in raw], np.int64), self.ranks)
        ids, ends = symbols.tolist(), np.cumsum(lengths).tolist()
        shown, data, start = list(map(self.decimal.__getitem__, ids)), list(map(self.bytes.__getitem__, ids)), 0
        for part, end in zip(new, ends):
            self.parts[part] = b",".join(shown[start:end]), b"".join(data[start:end]), ids[start:end]
            start = end

    def _entry(self, parts: list[str]) -> tuple[bytes, bytes]:
        """(decimal ids, decoded bytes) of consecutive word parts."""
        if len(parts) == 1:
            return self.parts[parts[0]][:2]
        got = [self.parts[p] for p in parts]
        return b",".join([x[0] for x in got]), b"".join([x[1] for x in got])

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def encode(self, batch: list[str]) -> list[list[int]]:
        """Ids of each text; all distinct word parts of the batch share one occurrence index."""
        cut = [[self.split(s) if i % 2 == 0 else s for i, s in enumerate(self._segments(t))] for t in batch]
        self.learn({p for text in cut for s in text[::2] for p in s})
        return [[x for i, s in enumerate(text) for x in ([self.special[s]] if i % 2 else [y for p in s for y in self.parts[p][2]])] for text in cut]

    def round_trip(self, batch: list[str]) -> list[tuple[bytes, bytes, int]]:
        """(decimal ids joined by commas, bytes decoded from the ids, number of ids) of each text.

        A single space before a visible character always begins a word part, so texts are cut there and each distinct
        piece is split, merged and decoded once. A text with any other space goes through the splitter as a whole.
        """
        first, later, whole = set(), set(), set()
        for text in batch:
            for s in self._segments(text)[::2]:
                if self.odd(s):
                    whole.update(self.split(s))
                else:
                    head, *rest = s.split(" ")
                    first.add(head)
                    later.update(rest)
        if len(self.shown[0]) + len(self.spaced[0]) > REMEMBERED:
            self.shown, self.spaced = ({}, {}), ({}, {})
        first -= self.shown[0].keys()
        later -= self.spaced[0].keys()
        split = [(self.shown, p, self.split(p)) for p in first] + [(self.spaced, p, self.split(" " + p)) for p in later]
        for _, _, parts in split:
            whole.update(parts)
        self.learn(whole)
        for (ids, decoded), piece, parts in split:
            ids[piece], decoded[piece] = self._entry(parts)
        del split, first, later, whole
        return [self._joined(text) for text in batch]

    def _segments(self, text: str) -> list[str]:
        """Ordinary text at even places, special tokens between."""
        return self.cut(text) if any(x in text for x in self.special) else [text]

    def _joined(self, text: str) -> tuple[bytes, bytes, int]:
        ids, decoded = [], []
        for i, s in enumerate(self._segments(text)):
            if i % 2:
                ids.append(self.decimal[self.special[s]])
                decoded.append(s.encode())
            elif self.odd(s):
                for kept, found in zip((ids, decoded), self._entry(self.split(s))):
                    kept.append(found)
            else:
                head, *rest = s.split(" ")
                if head:
                    ids.append(self.shown[0][head])
                    decoded.append(self.shown[1][head])
                ids.extend(map(self.spaced[0].__getitem__, rest))
                decoded.extend(map(self.spaced[1].__getitem__, rest))
        line = b",".join(ids)
        return line, b"".join(decoded), line.count(b",") + 1 if line else 0


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """The codec of this process; workers are reused between tasks."""
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(df: DataFrame, path=None) -> DataFrame:
    """(doc_id, ids) of every text."""
    path = path or default_path()

    def work(batches):
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "ids": codec(path).encode(texts(batch))}

    return map_arrow(df.select(F.col("doc_id").cast("long"), "text"), work, "doc_id LONG, ids ARRAY<INT>")


def decode(df: DataFrame, path=None) -> DataFrame:
    """(doc_id, text) of every id array; a null array gives a null text."""
    path = path or default_path()

    def work(batches):
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "text": [None if x is None else codec(path).decode(x) for x in batch.column("ids").to_pylist()]}

    return map_arrow(df.select(F.col("doc_id").cast("long"), "ids"), work, "doc_id LONG, text STRING")


def round_trip_digests(df: DataFrame, path=None) -> DataFrame:
    """Number and digest of the ids of every text, and the digest of what they decode to."""
    path = path or default_path()

    def work(batches):
        for batch in batches:
            docs, found = batch.column("doc_id"), texts(batch)
            for i in range(0, len(found), 4_000):
                got = codec(path).round_trip(found[i : i + 4_000])
                yield {
                    "doc_id": docs.slice(i, len(got)), "n_tokens": [n for _, _, n in got],
                    "ids_sha256": [hashlib.sha256(ids).hexdigest() for ids, _, _ in got],
                    "decoded_sha256": [hashlib.sha256(data.decode("utf-8", "replace").encode()).hexdigest() for _, data, _ in got],
                }

    return map_arrow(df.select(F.col("doc_id").cast("long"), "text"), work, "doc_id LONG, n_tokens LONG, ids_sha256 STRING, decoded_sha256 STRING")
