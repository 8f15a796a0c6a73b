"""Corners, binary descriptors and their nearest neighbours."""

from __future__ import annotations

import numpy as np

#: The circle of radius 3, the hash of a descriptor's pattern.
CIRCLE = ((0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3))
FAST_THRESHOLD, FAST_RUN, MARGIN = 20, 9, 3
BITS, SPREAD, SEED, STIR = 256, 31, 2654435761, 60493
NEXT = (2246822519, 3266489917, 668265263)


def fast_corners(gray: np.ndarray, threshold: int = FAST_THRESHOLD, run: int = FAST_RUN, most: int | None = 2000) -> np.ndarray:
    """(x, y) in raster order of pixels with ``run`` circle neighbours in a row all brighter or all darker."""
    h, w = gray.shape
    if w <= 2 * MARGIN or h <= 2 * MARGIN:
        return np.zeros((0, 2), dtype=np.int64)
    g = gray.astype(np.int16)
    centre = g[MARGIN : h - MARGIN, MARGIN : w - MARGIN]
    ring = np.stack([g[MARGIN + dy : h - MARGIN + dy, MARGIN + dx : w - MARGIN + dx] for dx, dy in CIRCLE])
    hit = np.zeros(centre.shape, dtype=bool)
    for flags in (ring > centre + threshold, ring < centre - threshold):
        # a run of n from i is a run of n - 1 from i and the flag at i + n - 1, round the circle
        chain = flags
        for k in range(1, run):
            chain = chain & np.roll(flags, -k, axis=0)
        hit |= chain.any(axis=0)
    y, x = np.nonzero(hit)
    return np.column_stack([x, y])[:most] + MARGIN


def _stirred(h: np.ndarray) -> np.ndarray:
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(STIR)) & np.uint64(0xFFFFFFFF)
    return h ^ (h >> np.uint64(15))


def hashes(bits: int = BITS) -> np.ndarray:
    """A 32-bit hash of each bit's number."""
    return _stirred((np.arange(bits, dtype=np.uint64) * np.uint64(SEED)) & np.uint64(0xFFFFFFFF))


def pattern(bits: int = BITS) -> np.ndarray:
    """bits x 4: the two offsets that each bit compares, from the hash of its number and three more."""
    h = hashes(bits)
    out = [h]
    for step in NEXT:
        h = _stirred((h * np.uint64(step) + np.uint64(1)) & np.uint64(0xFFFFFFFF))
        out.append(h)
    return np.column_stack([(x % np.uint64(SPREAD)).astype(np.int64) - SPREAD // 2 for x in out])


def describe(gray: np.ndarray, points: np.ndarray) -> np.ndarray:
    """points x 4 uint64: which of two pixels of each pair is darker; pixels beyond an edge count as the edge's."""
    h, w = gray.shape
    p = pattern()
    x, y = points[:, :1].astype(np.int64), points[:, 1:2].astype(np.int64)
    at = lambda dx, dy: gray[np.clip(y + dy, 0, h - 1), np.clip(x + dx, 0, w - 1)]
    less = at(p[:, 0], p[:, 1]) < at(p[:, 2], p[:, 3])
    return np.packbits(less, axis=1, bitorder="little").view("<u8") if len(points) else np.zeros((0, 4), dtype=np.uint64)


def match(a: np.ndarray, b: np.ndarray, ratio: float = 0.75, most: int | None = 2000) -> np.ndarray:
    """rows (index in a, index in b, distance): the nearest by Hamming distance if clearly nearer than the second."""
    if not len(a) or not len(b):
        return np.zeros((0, 3), dtype=np.int64)
    out = []
    for k in range(0, len(a), 256):
        d = np.bitwise_count(a[k : k + 256, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
        best = d.argmin(axis=1)
        rows = np.arange(len(d))
        first = d[rows, best]
        d[rows, best] = np.iinfo(np.int64).max
        second = d.min(axis=1) if len(b) > 1 else np.full(len(d), np.iinfo(np.int64).max)
        ok = (len(b) == 1) | (first < ratio * second)
        out.append(np.column_stack([rows + k, best, first])[ok])
    return np.concatenate(out)[:most]
