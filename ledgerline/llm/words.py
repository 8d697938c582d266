"""Words, shingles and paragraphs of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, np.uint64(MULTIPLIER)), np.full(size, np.uint64(INVERSE))
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run values[start:end], the same wherever the run stands."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def word_spans(flat: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of all words in bytes; ``space`` says which bytes separate words."""
    s = (_SPACE if space is None else space)[flat]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], s, [True])).astype(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, A-Z lower-cased."""
    return run_hashes(_LOWER[flat], start, end)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= np.uint64(MULTIPLIER)
        h += words[k:k + n]
    return mix(h)


def _least_around(x: np.ndarray, reach: int) -> np.ndarray:
    """Whether x[i] is below the ``reach`` values before it and at most the ``reach`` values after it."""
    n = len(x)
    top = np.full(reach, np.iinfo(np.uint64).max, np.uint64)
    padded = np.concatenate((top, x, top))
    size, least = 1, padded
    while size * 2 <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    wide = np.minimum(least[:len(padded) - reach + 1], least[reach - size:reach - size + len(padded) - reach + 1])
    return (x < wide[:n]) & (x <= wide[reach + 1:reach + 1 + n])


def paragraphs(flat: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, shortest: int, longest: int, edges: np.ndarray | None = None) -> np.ndarray:
    """Whether each word ends a paragraph, decided by the words around it alone.

    Line ends do; sentence ends do if the sentence has ``shortest`` words or more; pieces in a row that are shorter (short
    lines, ends of lines) are one stretch; in a stretch without such an end over ``longest`` words, so does the word before
    each local minimum of the word-pair hashes. Nothing is joined over ``edges``, the bytes where texts start.
    """
    n = len(words)
    if not n:
        return np.zeros(0, bool)
    line = np.searchsorted(np.flatnonzero(flat == 10), start)
    hard = np.append(line[1:] != line[:-1], True)
    stop = hard | _STOP[flat[end - 1]]
    at = np.flatnonzero(stop)
    cut = np.zeros(n, bool)
    cut[at] = hard[at] | (np.diff(at, prepend=-1) >= shortest)
    at = np.flatnonzero(cut)
    short = np.diff(at, prepend=-1) < shortest
    apart = np.zeros(n, bool)
    if edges is not None:
        first = np.searchsorted(start, edges)
        apart[first[first > 0] - 1] = True
    cut[at[:-1][short[:-1] & short[1:] & ~apart[at[:-1]]]] = False
    at = np.flatnonzero(cut)
    size = np.diff(at, prepend=-1)
    if (size > longest).any():
        pair = np.append(shingle_hashes(words, 2), np.uint64(0xFFFFFFFFFFFFFFFF))
        least = np.flatnonzero(_least_around(pair, shortest))
        unit = np.searchsorted(at, least)
        first = at[unit] - size[unit] + 1
        inside = (size[unit] > longest) & (least - first >= shortest) & (at[unit] - least >= shortest)
        cut[least[inside] - 1] = True
    return cut
