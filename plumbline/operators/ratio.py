"""The string ratio of many pairs at once: matching blocks of all pairs, a level of the recursion at a time, in numpy.

The ratio is 2M / T: T is the length of both strings, M what their matching blocks hold. A block is the longest
common stretch, the earliest one in the first string, then in the second; what stands to its left and to its right is
matched in the same way. Pairs with a string of LONG characters or more go through the standard library one by one:
there the measure has a rule for popular characters, and a dense table costs more than the library's sparse one.
"""

from __future__ import annotations

import difflib

import numpy as np

LONG = 200  # fixed value of the measure: from here on popular characters are treated apart
ROOM = 1 << 20  # cells of one step over a group of segments
PAD_A, PAD_B = -1, -2  # no character, and not equal to each other


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in one array, where each text begins, and how long it is."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return flat, np.cumsum(size) - size, size


def _rows(flat: np.ndarray, low: np.ndarray, high: np.ndarray, pad: int) -> np.ndarray:
    """The stretches low to high as rows of one matrix, padded at their ends."""
    places = low[:, None] + np.arange(int((high - low).max()))
    return np.where(places < high[:, None], flat[np.minimum(places, len(flat) - 1)], pad)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and length of the longest common stretch of each pair of rows."""
    n = len(a)
    run = np.zeros((n, b.shape[1] + 1), np.int32)  # run[:, j + 1]: length of the stretch that ends at j of b
    best, at_a, at_b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows = np.arange(n)
    for i in range(a.shape[1]):
        run[:, 1:] = np.where(b == a[:, i, None], run[:, :-1] + 1, 0)
        j = run.argmax(axis=1)  # the first of the longest
        length = run[rows, j]
        more = length > best
        best[more], at_a[more], at_b[more] = length[more], i + 1 - length[more], j[more] - length[more]
    return at_a, at_b, best


def matched(first: list[str], second: list[str]) -> np.ndarray:
    """M of each pair."""
    a, a_start, a_size = _codes(first)
    b, b_start, b_size = _codes(second)
    out = np.zeros(len(first), np.int64)
    # segments: pair, and from where to where in each string
    pair = np.flatnonzero((a_size > 0) & (b_size > 0))
    al, bl = a_start[pair], b_start[pair]
    ah, bh = al + a_size[pair], bl + b_size[pair]
    while len(pair):
        # segments of like lengths make a group, so little is padded
        order = np.lexsort((bh - bl, ah - al))
        pair, al, ah, bl, bh = (x[order] for x in (pair, al, ah, bl, bh))
        at_a, at_b, length = (np.zeros(len(pair), np.int64) for _ in range(3))
        low = 0
        while low < len(pair):
            longest = np.maximum.accumulate(bh[low:] - bl[low:])
            like = (ah[low:] - al[low:]) <= (ah[low] - al[low]) + 4
            inside = like & (longest * np.arange(1, len(longest) + 1) <= ROOM)
            high = low + max(1, len(inside) if inside.all() else int(inside.argmin()))
            s = slice(low, high)
            x, y, n = _longest(_rows(a, al[s], ah[s], PAD_A), _rows(b, bl[s], bh[s], PAD_B))
            at_a[s], at_b[s], length[s] = al[s] + x, bl[s] + y, n
            low = high
        np.add.at(out, pair, length)
        found = length > 0
        left = found & (at_a > al) & (at_b > bl)
        end_a, end_b = at_a + length, at_b + length
        right = found & (end_a < ah) & (end_b < bh)
        pair, al, ah, bl, bh = (np.r_[p[left], q[right]] for p, q in (
            (pair, pair), (al, end_a), (at_a, ah), (bl, end_b), (at_b, bh)))
    return out


def ratios(first: list[str], second: list[str]) -> np.ndarray:
    """2M / T of each pair, 1 for two empty strings; the measure is not symmetric."""
    short = [k for k, (x, y) in enumerate(zip(first, second, strict=True)) if len(x) < LONG and len(y) < LONG]
    a, b = [first[k] for k in short], [second[k] for k in short]
    total = np.fromiter(map(len, a), np.int64, len(a)) + np.fromiter(map(len, b), np.int64, len(b))
    out = np.empty(len(first))
    out[short] = np.where(total > 0, 2.0 * matched(a, b) / np.maximum(total, 1), 1.0)
    for k in np.setdiff1d(np.arange(len(first)), short).tolist():
        out[k] = difflib.SequenceMatcher(None, first[k], second[k]).ratio()
    return out
