"""Anchors of a text: positions chosen by content such that equal windows choose the same one.

The anchor of a window of ``WINDOW`` bytes is its ``GRAM``-byte piece with the smallest hash, the leftmost of equal ones. Neighbouring
windows mostly share an anchor, so a text has about one anchor per 35 bytes, each with a run of windows.
"""

from __future__ import annotations

import numpy as np

from larder.llm.common import mix

WINDOW, GRAM = 100, 32
#: Window starts handled at once: positions must fit the low bits of a rank. A run that is cut here is two shorter runs.
PIECE = 900_000
_LOW = 20

_RANDOM = np.random.default_rng(20240607)
_LETTER = _RANDOM.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base)))


_POWER, _BACK = None, None


def _tables():
    global _POWER, _BACK
    if _POWER is None:
        _POWER, _BACK = _powers(_BASE, PIECE + 2 * WINDOW), _powers(_INVERSE, PIECE + 2 * WINDOW)
    return _POWER, _BACK


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position."""
    return _grams(_LETTER[data])


def _grams(letters: np.ndarray) -> np.ndarray:
    hashes, step, base = letters, 1, _BASE
    with np.errstate(over="ignore"):
        while step < GRAM:
            hashes = hashes[:-step] * base + hashes[step:]
            step, base = step * 2, base * base
    return mix(hashes)


def runs(data: np.ndarray, lengths: np.ndarray):
    """Runs of windows with one anchor in concatenated texts of at most ``PIECE`` + ``WINDOW`` bytes together.

    Returns (first window start, last window start, anchor position, anchor hash, digest of the bytes of the run).
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    power, back = _tables()
    with np.errstate(over="ignore"):
        letters = _LETTER[data]
        hashes = _grams(letters)
        low = np.uint64((1 << _LOW) - 1)
        rank = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        least, step = rank, 1
        while step * 2 <= WINDOW - GRAM + 1:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        rest = WINDOW - GRAM + 1 - step
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        ends = np.cumsum(lengths)
        inside = np.ones(len(least), bool)
        for end in ends[:-1].tolist():
            inside[max(0, end - WINDOW + 1) : end] = False
        starts = np.flatnonzero(inside)
        if not len(starts):
            return none, none, none, none.view(np.uint64), none.view(np.uint64)
        chosen = least[starts]
        new = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
        anchor = (chosen[new] & low).astype(np.int64)
        sums = np.append(np.uint64(0), np.cumsum(letters * power[:n], dtype=np.uint64))
        digest = (sums[last + WINDOW] - sums[first]) * back[first]
        digest = mix(digest + mix((anchor - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)))
        return first, last, anchor, hashes[anchor], digest
