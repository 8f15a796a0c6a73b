"""Blending: pyramids, coverage, seams, several bands; exposure fusion and the painterly curve."""

from __future__ import annotations

import numpy as np

from tessera.functions.raster import round_half

BANDS = 5


def blur(a: np.ndarray) -> np.ndarray:
    """[1 4 6 4 1] / 16 along both axes, edges repeated."""
    for axis in (1, 0):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (2, 2)
        p = np.pad(a, pad, mode="edge")
        n = a.shape[axis]
        part = [np.take(p, np.arange(k, k + n), axis=axis) for k in range(5)]
        a = (part[0] + part[4] + 4 * (part[1] + part[3]) + 6 * part[2]) / 16
    return a


def down(a: np.ndarray) -> np.ndarray:
    return blur(a)[::2, ::2]


def up(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, corners on corners."""
    for axis, n in ((0, height), (1, width)):
        m = a.shape[axis]
        at = np.arange(n) * ((m - 1) / (n - 1) if n > 1 else 0.0)
        low = np.floor(at).astype(np.int64)
        high = np.minimum(low + 1, m - 1)
        f = (at - low).reshape([-1 if k == axis else 1 for k in range(a.ndim)])
        a = np.take(a, low, axis=axis) * (1 - f) + np.take(a, high, axis=axis) * f
    return a


def gaussian(a: np.ndarray, bands: int) -> list[np.ndarray]:
    out = [a]
    for _ in range(bands - 1):
        out.append(down(out[-1]))
    return out


def filled_gaussian(a: np.ndarray, mask: np.ndarray, bands: int) -> list[np.ndarray]:
    """Levels in which only covered pixels count: values and coverage are blurred and divided."""
    values, weights = a * mask[..., None], mask.astype(np.float64)
    out = [np.where(mask[..., None], a, 0.0)]
    for _ in range(bands - 1):
        values, weights = down(values), down(weights)
        out.append(values / np.maximum(weights, 1e-6)[..., None])
    # holes of the finest level get what the next one has there
    for k in range(len(out) - 2, -1, -1):
        if k == 0:
            out[0] = np.where(mask[..., None], a, up(out[1], *mask.shape))
    return out


def laplacian(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Differences between levels; the top one stays."""
    return [a - up(b, *a.shape[:2]) for a, b in zip(levels, levels[1:], strict=False)] + [levels[-1]]


def collapse(levels: list[np.ndarray]) -> np.ndarray:
    out = levels[-1]
    for a in reversed(levels[:-1]):
        out = a + up(out, *a.shape[:2])
    return out


def bands_for(height: int, width: int, most: int = BANDS) -> int:
    return max(1, min(most, int(np.log2(max(1, min(height, width))))))


def coverage_distance(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance (1, sqrt 2) to the nearest gap; the border is no gap. Two passes, a row at a time.

    Along a row, out[x] = min over k <= x of in[k] + (x - k), which is a running minimum of in[k] - k.
    """
    h, w = mask.shape
    d = np.where(mask, float(w + h), 0.0)
    x, diagonal = np.arange(w), np.sqrt(2.0)

    def pass_over(d):
        for y in range(h):
            row = d[y]
            if y:
                above = d[y - 1]
                row = np.minimum(row, above + 1)
                row[1:] = np.minimum(row[1:], above[:-1] + diagonal)
                row[:-1] = np.minimum(row[:-1], above[1:] + diagonal)
            d[y] = np.minimum.accumulate(row - x) + x
        return d

    return pass_over(pass_over(d)[::-1, ::-1].copy())[::-1, ::-1]


def ownership(distances: list[np.ndarray]) -> np.ndarray:
    """Per pixel the contributor farthest from its gaps, the first of equals; -1 where there is none."""
    stack = np.stack(distances)
    best = stack.argmax(axis=0)
    return np.where(stack.max(axis=0) > 0, best, -1)


def box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """x0, y0, x1, y1 of what is covered, both inclusive."""
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1]), int(ys[-1])) if len(xs) else None


def refine_seam(owner: np.ndarray, i: int, j: int, a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray, smooth: float = 2.0, reach: int = 24) -> None:
    """Move the border between two contributors to where they agree, within ``reach`` of where it is.

    Each line across the longer side of the overlap has a cut; a cut costs the images' difference there
    and ``smooth`` for each pixel it moves from line to line. Viterbi over the lines, which may be apart.
    """
    bi, bj = box(da > 0), box(db > 0)
    if bi is None or bj is None:
        return
    x0, y0, x1, y1 = max(bi[0], bj[0]), max(bi[1], bj[1]), min(bi[2], bj[2]), min(bi[3], bj[3])
    if x0 > x1 or y0 > y1:
        return
    rows = x1 - x0 >= y1 - y0
    view = lambda m: m[y0 : y1 + 1, x0 : x1 + 1] if rows else m[y0 : y1 + 1, x0 : x1 + 1].swapaxes(0, 1)
    own = view(owner)
    cost = np.abs(view(a).astype(np.float64) - view(b).astype(np.float64)).sum(axis=2)
    both = (view(da) > 0) & (view(db) > 0)
    axis = 0 if rows else 1
    i_low = bi[axis] + bi[axis + 2] <= bj[axis] + bj[axis + 2]
    lines = []
    for n in range(own.shape[0]):
        at = np.flatnonzero((own[n] == i) | (own[n] == j))
        turn = np.flatnonzero(own[n, at] != own[n, at[0]]) if len(at) else at
        if not len(turn):
            continue
        middle = at[turn[0]]
        low, high = max(0, middle - reach), min(own.shape[1] - 1, middle + reach)
        inside = np.flatnonzero(both[n, low : high + 1])
        if len(inside):
            lines.append((n, low + int(inside[0]), low + int(inside[-1])))
    if not lines:
        return
    back, state, before = [], None, None
    for n, low, high in lines:
        t = np.arange(low, high + 1)
        local = cost[n, low : high + 1]
        if state is None:
            state = local
        else:
            paths = state[None, :] + smooth * np.abs(t[:, None] - before[None, :])
            come = paths.argmin(axis=1)
            back.append(come)
            state = local + paths[np.arange(len(t)), come]
        before = t
    k = int(state.argmin())
    for n in range(len(lines) - 1, -1, -1):
        line, low, high = lines[n]
        t = np.arange(low, high + 1)
        mine = (own[line, low : high + 1] == i) | (own[line, low : high + 1] == j)
        side = np.where((t < low + k) == i_low, i, j)
        own[line, low : high + 1] = np.where(mine, side, own[line, low : high + 1])
        if n:
            k = int(back[n - 1][k])


def compose(images: list[np.ndarray], masks: list[np.ndarray], owner: np.ndarray, bands: int | None = None) -> np.ndarray:
    """Each contributor's bands weighed by its blurred ownership, added up; what nobody covers is 0."""
    h, w = owner.shape
    bands = bands or bands_for(h, w)
    total: list[np.ndarray] = []
    for k, (image, mask) in enumerate(zip(images, masks, strict=True)):
        if not (owner == k).any():
            continue
        weights = gaussian((owner == k).astype(np.float64), bands)
        parts = [x[..., None] * d for x, d in zip(weights, laplacian(filled_gaussian(image.astype(np.float64), mask, bands)), strict=True)]
        total = parts if not total else [p + q for p, q in zip(total, parts, strict=True)]
    if not total:
        return np.zeros((h, w, 3), dtype=np.uint16)
    share = gaussian((owner >= 0).astype(np.float64), bands)
    out = collapse([p / np.maximum(s, 1e-6)[..., None] for p, s in zip(total, share, strict=True)])
    out[owner < 0] = 0
    return round_half(out)


def blend(images: list[np.ndarray], masks: list[np.ndarray] | None = None) -> np.ndarray:
    """Blend aligned contributors; without masks, a pixel of three zeros is a gap."""
    masks = masks or [im.any(axis=2) for im in images]
    distances = [coverage_distance(m) if not m.all() else np.full(m.shape, float(sum(m.shape))) for m in masks]
    distances = [np.where(m, d, 0) for m, d in zip(masks, distances, strict=True)]
    owner = ownership(distances)
    for i in range(len(images)):
        for j in range(i + 1, len(images)):
            refine_seam(owner, i, j, images[i], images[j], distances[i], distances[j])
    return compose(images, masks, owner)


def fuse(low: np.ndarray, high: np.ndarray, bands: int = BANDS, sigma: float = 0.2) -> np.ndarray:
    """Two exposures: bands weighed by how well exposed the channels are, taken together."""
    a, b = low.astype(np.float64) / 65535, high.astype(np.float64) / 65535
    good = lambda v: np.exp(-((v - 0.5) ** 2) / (2 * sigma * sigma)).prod(axis=2)
    wa, wb = good(a), good(b)
    total = wa + wb
    share = np.where(total > 1e-6, wa / np.maximum(total, 1e-30), 0.5)
    bands = min(bands, bands_for(*share.shape))
    weights = gaussian(share, bands)
    parts = [w[..., None] * p + (1 - w[..., None]) * q for w, p, q in zip(weights, laplacian(gaussian(a, bands)), laplacian(gaussian(b, bands)), strict=True)]
    return round_half(collapse(parts) * 65535)


def even_blend(a: np.ndarray, b: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Two rasters, half and half in every band of their pyramids."""
    bands = min(bands, bands_for(*a.shape[:2]))
    pair = [laplacian(gaussian(x.astype(np.float64), bands)) for x in (a, b)]
    return round_half(collapse([(p + q) / 2 for p, q in zip(*pair, strict=True)]))


def tone(a: np.ndarray, gamma: float) -> np.ndarray:
    return round_half(65535 * (a / 65535.0) ** gamma)


def painterly(a: np.ndarray, gamma: float = 1.5, rolloff: float = 0.2, strength: float = 0.35) -> np.ndarray:
    h, w = a.shape[:2]
    t = (a / 65535.0) ** gamma
    t = t / (1 + rolloff * t)
    y, x = np.mgrid[0:h, 0:w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    r = ((x - cx) ** 2 + (y - cy) ** 2) / max(cx * cx + cy * cy, 1e-12)
    return round_half(65535 * t * (1 - strength * r)[..., None])
