"""Words of texts as rows of a table that is filled once per distinct word; hashed character n-grams of words."""

from __future__ import annotations

import string

import numpy as np

from larder.llm.common import memo

#: Distinct words that a worker remembers; a speed setting, results do not depend on it.
REMEMBERED = 150_000
_EDGES = string.punctuation + "«»¿¡…“”„’"


def normal(word: str) -> str:
    """Lower case without marks at the ends; empty for a word without letters."""
    word = word.strip(_EDGES).lower()
    return word if any(map(str.isalpha, word)) else ""


def ngrams(words: list[str], sizes: tuple[int, ...], buckets: int):
    """(bucket, word index) of the n-grams of ``^word$``, n-gram size by size; those with ``^`` or ``$`` are the affixes."""
    joined = "".join([f"^{w}$" for w in words])
    letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    at, out = np.arange(len(letters)), []
    with np.errstate(over="ignore"):
        hashes = letters * np.uint64(0x9E3779B97F4A7C15)
        for size in range(2, max(sizes) + 1):
            hashes = (hashes[:-1] ^ (hashes[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + letters[size - 1 :] * np.uint64(0x9E3779B97F4A7C15)
            if size in sizes:
                whole = np.flatnonzero(at[: len(hashes)] + size <= ends[: len(hashes)])
                found = hashes[whole] + np.uint64(size)
                out.append((((found ^ (found >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64), owner[whole]))
    return out


def word_buckets(words: list[str], buckets: int) -> np.ndarray:
    """One bucket per whole word."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))


def per_word(values: np.ndarray, owner: np.ndarray, words: int, combine=np.add) -> np.ndarray:
    """``values`` of n-grams combined per word (owners ascending); zero for a word without any."""
    out = np.zeros((words, *values.shape[1:]), values.dtype)
    if len(owner):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[starts]] = combine.reduceat(values, starts, axis=0)
    return out


class WordTable:
    """Raw words to rows; ``embed`` computes the rows of new normalised words. Row 0 stands for words without letters."""

    def __init__(self, embed, width: int, most: float = REMEMBERED):
        self.embed, self.width, self.most = embed, width, most
        self._clear()

    def _clear(self):
        self.raw: dict[str, int] = {}
        self.known: dict[str, int] = {"": 0}
        self.rows = np.zeros((1024, self.width), np.float32)

    def _learn(self, words: set[str]) -> None:
        if len(self.raw) > self.most:
            self._clear()
        new = list(words - self.raw.keys())
        plain = list(map(normal, new))
        fresh = sorted(set(plain) - self.known.keys())
        if fresh:
            first = len(self.known)
            self.known.update(zip(fresh, range(first, first + len(fresh))))
            while len(self.rows) < len(self.known):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for i in range(0, len(fresh), 20_000):
                part = fresh[i : i + 20_000]
                self.rows[first + i : first + i + len(part)] = self.embed(part)
        self.raw.update(zip(new, map(self.known.__getitem__, plain)))

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word of all texts, number of words of each text). Rows are valid until the next call."""
        words = [t.split() for t in texts]
        self._learn(set().union(*words))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        get = self.raw.__getitem__
        return np.fromiter((r for text in words for r in map(get, text)), np.int32, int(counts.sum())), counts


def table_of(model, embed, width: int) -> WordTable:
    """The word table of this process for ``model``; one model's table at a time is kept, as workers serve stage after stage."""
    slot = memo("word table", dict)
    if slot.get("model") is not model:
        slot.clear()
        slot.update(model=model, table=WordTable(embed, width))
    return slot["table"]
