"""Word shingles of whole texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from larder.llm.common import memo, mix

#: Distinct words that a worker remembers; a speed setting, results do not depend on it.
REMEMBERED = 150_000


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z lower-cased, split at ASCII white space), and the number of words of each text."""
    words = [t.encode().lower().split() for t in texts]
    known: dict[bytes, int] = memo("shingles", dict)
    if len(known) > REMEMBERED:
        known.clear()
    digest = xxhash.xxh3_64_intdigest
    for word in set().union(*words) - known.keys():
        known[word] = digest(word)
    counts = np.fromiter(map(len, words), np.int64, len(words))
    get = known.__getitem__
    return np.fromiter((h for text in words for h in map(get, text)), np.uint64, int(counts.sum())), counts


def shingle_sets(texts: list[str], size=4) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each text; fewer words count as one shingle, none as none."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        rolled = mix(hashes + np.uint64(size))
        for _ in range(size - 1):
            rolled = mix(rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[len(hashes) - len(rolled) + 1 :]) if len(rolled) else rolled
    out = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        if count >= size:
            out.append(np.unique(rolled[end - count : end - size + 1]))
        elif count:
            value = np.uint64(count)
            with np.errstate(over="ignore"):
                for h in hashes[end - count : end]:
                    value = mix(np.array([value * np.uint64(0x9E3779B97F4A7C15) + h], np.uint64))[0]
            out.append(np.array([value], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
