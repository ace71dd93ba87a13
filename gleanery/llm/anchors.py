"""Window anchors: how equal windows of different documents find each other.

A window of ``width`` units (words or bytes) is anchored at the leftmost least
hash of its ``gram``-unit grams.  Equal windows have their anchor at the same
place, and neighbouring windows share one, so one anchor stands for many
windows.  Long texts are cut into pieces that overlap by a window, short ones
are put together, so that the work space is bounded whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Units worked on at a time.
PIECE = 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value spread over all its bits."""
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def gram_hashes(units: np.ndarray, n: int, factor: np.uint64 = _A) -> np.ndarray:
    """A hash of each ``n`` consecutive units (uint64), by doubling; as many as there are whole grams."""
    count = len(units) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    done, total, power = 0, None, np.uint64(1)
    level, size, step = units, 1, factor
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                part = level[done : done + count]
                total = part.copy() if total is None else total * step + part
                done += size
            if size * 2 > n:
                break
            level = level[:-size] * step + level[size:]
            size, step = size * 2, step * step
        del power
    return mixed(total)


def window_anchors(grams: np.ndarray, per_window: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows that start at ``valid`` (ascending) and hold ``per_window`` grams: anchors' places, and each one's first and last window start."""
    if not len(valid):
        none = np.zeros(0, np.int64)
        return none, none, none
    m = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= per_window:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < per_window:
        m = np.minimum(m[: len(m) - (per_window - size)], m[per_window - size :])
    at = (m[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return at[first], valid[first], valid[last]


def pieces(lengths: list[int], width: int, piece: int = PIECE) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (document, begin, end) of about ``piece`` units: each window of each document starts in exactly one of its first ``end - begin - width + 1`` units."""
    batch, held = [], 0
    for d, n in enumerate(lengths):
        for begin in range(0, n - width + 1, piece):
            end = min(n, begin + piece + width - 1)
            batch.append((d, begin, end))
            held += end - begin
            if held >= piece:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


def window_starts(batch: list[tuple[int, int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the pieces in their concatenation, and all window starts there."""
    sizes = np.array([e - b for _, b, e in batch], dtype=np.int64)
    offsets = np.cumsum(sizes) - sizes
    count = sizes - width + 1
    starts = np.repeat(offsets - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return offsets, starts
