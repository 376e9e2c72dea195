"""Words of many texts at once: byte ranges and 64-bit hashes, in numpy, over bounded slices."""

from __future__ import annotations

import numpy as np

SLICE = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_POWER: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)


def letters_and_digits() -> np.ndarray:
    """Byte map of words made of ASCII letters, digits and everything beyond ASCII; A-Z become a-z, 0 separates."""
    table = np.zeros(256, np.uint8)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        table[b] = b
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


def between_spaces(lower: bool = True) -> np.ndarray:
    """Byte map of words between ASCII white space; 0 separates (so a zero byte does as well)."""
    table = np.arange(256).astype(np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    if lower:
        table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWER.get("up", ())) < n:
        size = max(n, SLICE + 1)
        inverse = np.uint64(pow(int(_MUL), -1, 1 << 64))
        step = np.ones(size, np.uint64)
        step[1:] = _MUL
        up = np.multiply.accumulate(step)
        step[1:] = inverse
        if size > 4 * SLICE:
            return up, np.multiply.accumulate(step)
        _POWER["up"], _POWER["down"] = up, np.multiply.accumulate(step)
    return _POWER["up"], _POWER["down"]


def _in_slice(mapped: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = mapped != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    rows = rows[rows < len(mapped)]
    begins[rows] |= inside[rows]
    last = rows[rows > 0] - 1
    ends[last] |= inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(len(mapped) + 1)
    total = np.empty(len(mapped) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[mapped] * up[:len(mapped)], out=total[1:])
    code = (total[end] - total[start]) * down[start]
    return start, end, mix(code ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def word_table(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, row) of every word of the rows ``data[at[i]:at[i+1]]``.

    ``data`` is cut into slices at separators, so that memory beyond the words themselves stays bounded; only a single
    word longer than a slice widens it.
    """
    found, pos, n = [], 0, len(data)
    while pos < n:
        end = min(pos + SLICE, n)
        mapped = table[data[pos:end]]
        if end < n:
            cut = np.flatnonzero(mapped == 0)
            if len(cut):
                end = pos + int(cut[-1]) + 1
            else:
                while end < n and table[data[end - 1]] != 0:
                    more = np.flatnonzero(table[data[end:end + SLICE]] == 0)
                    end = end + int(more[0]) + 1 if len(more) else min(end + SLICE, n)
            mapped = table[data[pos:end]]
        lo, hi = np.searchsorted(at, [pos, end])
        start, stop, code = _in_slice(mapped, at[lo:hi] - pos)
        found.append((start + pos, stop + pos, code))
        pos = end
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), empty
    start, stop, code = (np.concatenate(x) for x in zip(*found, strict=True))
    return start, stop, code, np.searchsorted(at, start, "right") - 1
