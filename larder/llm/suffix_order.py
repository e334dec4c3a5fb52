"""Suffix order of many short strings, built column by column: each round inserts one symbol of every string.

The state is the Burrows-Wheeler transform of the suffixes inserted so far (the symbol before each suffix), whose suffix each
row is, and one mark per neighbouring pair: whether they agree on their first ``common`` symbols. A round finds the place
of every new suffix by counting the symbols before its predecessor (the LF mapping), then copies the old files to the new
ones in one sequential pass that leaves gaps for the new rows. The files are memory maps in the task's own temporary folder.
"""

from __future__ import annotations

import tempfile

import numpy as np

BLOCK = 256


class Files:
    """External columns of the transform: ``symbol`` before each suffix, and ``row`` = string, length and mark packed."""

    def __init__(self, folder: str, most: int):
        self.symbols = np.memmap(tempfile.TemporaryFile(dir=folder), np.uint8, "w+", shape=(most + BLOCK,))
        self.rows = np.memmap(tempfile.TemporaryFile(dir=folder), np.int64, "w+", shape=(most + 1,))


def pack(string, length, agrees):
    return string << np.int64(32) | length << np.int64(1) | agrees


def occurrences(symbols: np.ndarray, n: int, letters: int, at: np.ndarray, wanted: np.ndarray):
    """How often ``wanted`` stands before each place, and how often every symbol occurs at all."""
    blocks = n // BLOCK + 1
    key = np.repeat(np.arange(blocks, dtype=np.int64) * letters, BLOCK)[:n] + symbols[:n]
    counts = np.bincount(key, minlength=blocks * letters).reshape(blocks, letters)
    before = np.cumsum(counts, axis=0) - counts
    found = before[at // BLOCK, wanted]
    views = np.lib.stride_tricks.sliding_window_view(symbols, BLOCK)
    for i in range(0, len(at), 4096):
        part, letter = at[i : i + 4096], wanted[i : i + 4096]
        rows = views[part // BLOCK * BLOCK]
        hit = (rows == letter[:, None].astype(np.uint8)) & (np.arange(BLOCK) < (part % BLOCK)[:, None])
        found[i : i + 4096] += np.count_nonzero(hit, axis=1)
    return found, counts.sum(axis=0)


def equal_windows(strings: list[bytes], common: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, string, start) of every window of ``common`` bytes; windows of one class are equal."""
    count = len(strings)
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes)
    alphabet, coded = np.unique(data, return_inverse=True)
    letters = len(alphabet) + 1  # and one code for "no symbol before"; UTF-8 never uses all 256 bytes
    if letters > 256:
        raise ValueError("strings may use at most 255 different bytes")
    coded, complete = coded.astype(np.uint8), letters - 1
    views = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(common, np.uint8)), common)
    most = int(sizes.sum()) + count

    def agree(rows, others):
        """Whether two packed suffixes share ``common`` symbols."""
        out = ((rows >> 1 & 0x7FFFFFFF) >= common) & ((others >> 1 & 0x7FFFFFFF) >= common)
        at = np.flatnonzero(out)
        start = lambda r: ends[r >> 32] - (r >> 1 & 0x7FFFFFFF)
        for i in range(0, len(at), 20_000):
            part = at[i : i + 20_000]
            out[part] = (views[start(rows[part])] == views[start(others[part])]).all(axis=1)
        return out

    with tempfile.TemporaryDirectory() as folder:
        now, following = Files(folder, most), Files(folder, most)
        # Round 0: the empty suffixes, in the order of the strings; the symbol before each is its string's last.
        n, place, done = count, np.arange(count), 0
        now.symbols[:n] = np.where(sizes > 0, coded[np.maximum(ends - 1, 0)] if len(coded) else 0, complete)
        now.rows[:n] = pack(np.arange(count), 0, 0)
        active = np.flatnonzero(sizes > 0)
        while len(active):
            done += 1
            symbol = coded[ends[active] - done].astype(np.int64)
            found, totals = occurrences(now.symbols, n, letters, place[active], symbol)
            first = count + np.cumsum(totals) - totals
            new = first[symbol] + found
            order = np.argsort(new)
            new, string = new[order], active[order]
            kept = np.ones(n + len(new), bool)
            kept[new] = False
            following.symbols[: len(kept)][kept] = now.symbols[:n]
            following.rows[: len(kept)][kept] = now.rows[:n]
            n = len(kept)
            before = ends[string] - done - 1
            following.symbols[new] = np.where(sizes[string] > done, coded[np.maximum(before, 0)], complete)
            following.rows[new] = pack(string, done, 0)
            place[string] = new
            if done >= common:
                touched = np.unique(np.concatenate([new, new + 1]))
                touched = touched[touched < n]
                rows = following.rows[touched]
                following.rows[touched] = rows & ~1 | agree(following.rows[touched - 1], rows)
            now, following = following, now
            active = active[sizes[active] > done]
        rows = np.array(now.rows[:n])
    rows = rows[(rows >> 1 & 0x7FFFFFFF) >= common]
    string = rows >> 32
    return np.cumsum(1 - (rows & 1)), string, sizes[string] - (rows >> 1 & 0x7FFFFFFF)
