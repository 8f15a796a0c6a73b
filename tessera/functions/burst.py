"""Aligning and merging a burst of frames (height x width x 3, uint16), tile by tile."""

from __future__ import annotations

import numpy as np

from tessera.functions.raster import bilinear, cut_off, edge, round_half

TILE, RADIUS = 16, 8


def tiles(n: int, tile: int = TILE) -> int:
    return -(-n // tile)


def tile_sums(a: np.ndarray, tile: int) -> np.ndarray:
    """Sums over the tiles of the last two axes but any before them."""
    rows = np.add.reduceat(a, np.arange(0, a.shape[-2], tile), axis=-2)
    return np.add.reduceat(rows, np.arange(0, a.shape[-1], tile), axis=-1)


def block_match(ref: np.ndarray, src: np.ndarray, tile: int = TILE, radius: int = RADIUS) -> np.ndarray:
    """tiles_y x tiles_x x (dx, dy): the shift of src with the least sum of absolute differences.

    Shifts that take a tile out of the frame are no candidates; ties go to the smaller |dx| + |dy|, then
    to the earlier in (dy, dx). All tiles are compared at once for each shift.
    """
    h, w = ref.shape[:2]
    ty, tx = tiles(h, tile), tiles(w, tile)
    y0, x0 = np.arange(ty) * tile, np.arange(tx) * tile
    y1, x1 = np.minimum(y0 + tile, h), np.minimum(x0 + tile, w)
    shifts = sorted(((dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)), key=lambda s: (abs(s[0]) + abs(s[1]), s[1], s[0]))
    best = np.full((ty, tx), np.iinfo(np.int64).max)
    out = np.zeros((ty, tx, 2), dtype=np.int32)
    a = ref.astype(np.int64)
    wide = np.pad(src.astype(np.int64), [(radius, radius), (radius, radius), (0, 0)])
    for dx, dy in shifts:
        moved = wide[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
        sad = tile_sums(np.abs(a - moved).sum(axis=2), tile)
        ok = ((y0 + dy >= 0) & (y1 + dy <= h))[:, None] & ((x0 + dx >= 0) & (x1 + dx <= w))[None, :]
        better = ok & (sad < best)
        best[better] = sad[better]
        out[better] = (dx, dy)
    return out


def per_pixel(offsets: np.ndarray, h: int, w: int, tile: int = TILE) -> np.ndarray:
    """The offset of each pixel's tile."""
    y, x = np.minimum(np.arange(h) // tile, offsets.shape[0] - 1), np.minimum(np.arange(w) // tile, offsets.shape[1] - 1)
    return offsets[y][:, x]


def robust_merge(frames: list[np.ndarray], offsets: list[np.ndarray], sigma: float = 2000.0, tile: int = TILE) -> np.ndarray:
    """Weighted mean of the reference and the shifted others; a sample weighs exp(-(v - ref)^2 / 2 sigma^2).

    What falls outside a frame does not count.
    """
    ref = frames[0].astype(np.float32)
    h, w = ref.shape[:2]
    total, weight = ref.astype(np.float64), np.ones(ref.shape)
    y, x = np.mgrid[0:h, 0:w]
    for frame, field in zip(frames[1:], offsets, strict=True):
        shift = per_pixel(field, h, w, tile)
        sx, sy = x + shift[..., 0], y + shift[..., 1]
        inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
        v = frame[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)].astype(np.float64)
        k = np.exp(-((v - ref) ** 2) / (2 * sigma * sigma)) * inside[..., None]
        total += k * v
        weight += k
    return cut_off(total / weight)


def _tiled(frame: np.ndarray, field: np.ndarray | None, ty: int, tx: int, tile: int) -> np.ndarray:
    """ty x tx x tile x tile x 3, each tile at its offset, edges repeated."""
    h, w = frame.shape[:2]
    zero = np.zeros((ty, tx, 2), dtype=np.int64) if field is None else field
    y = (np.arange(ty) * tile)[:, None, None] + np.arange(tile)[None, None, :] + zero[..., 1][..., None]
    x = (np.arange(tx) * tile)[None, :, None] + np.arange(tile)[None, None, :] + zero[..., 0][..., None]
    return frame[np.clip(y, 0, h - 1)[:, :, :, None], np.clip(x, 0, w - 1)[:, :, None, :]]


def fourier_merge(frames: list[np.ndarray], offsets: list[np.ndarray], variance: float = 4000.0, tile: int = TILE, mode: str = "parity") -> np.ndarray:
    """Tile spectra: the reference's plus the weighted mean difference of the others from it.

    With D the difference, "parity" weighs D by |D|^2 / (|D|^2 + variance); "paper" by the complement, so
    that large differences are held back.
    """
    if tile & (tile - 1):
        raise ValueError("the tile must be a power of two")
    h, w = frames[0].shape[:2]
    ty, tx = tiles(h, tile), tiles(w, tile)
    ref = np.fft.fft2(_tiled(frames[0], None, ty, tx, tile).astype(np.float64), axes=(2, 3))
    merged = ref.copy()
    for frame, field in zip(frames[1:], offsets, strict=True):
        d = np.fft.fft2(_tiled(frame, field, ty, tx, tile).astype(np.float64), axes=(2, 3)) - ref
        power = np.abs(d) ** 2
        k = np.divide(power, power + variance, out=np.zeros_like(power), where=power + variance > 0)
        merged += (k if mode == "parity" else 1 - k) * d / max(1, len(frames) - 1)
    out = np.fft.ifft2(merged, axes=(2, 3)).real
    return round_half(out.transpose(0, 2, 1, 3, 4).reshape(ty * tile, tx * tile, 3)[:h, :w])


def smooth_field(field: np.ndarray) -> np.ndarray:
    """The mean over the 3x3 tiles that are there."""
    if field.shape[0] * field.shape[1] <= 1:
        return field
    h, w = field.shape[:2]
    wide, there = np.pad(field, [(1, 1), (1, 1), (0, 0)]), np.pad(np.ones((h, w)), 1)
    total = sum(wide[i : i + h, j : j + w] for i in range(3) for j in range(3))
    return total / sum(there[i : i + h, j : j + w] for i in range(3) for j in range(3))[..., None]


def refine(ref: np.ndarray, src: np.ndarray, coarse: np.ndarray, iterations: int = 6, tile: int = TILE, most: float = 1.0, least: float = 1e-3) -> np.ndarray:
    """Sub-pixel offsets by gradient steps per tile, all tiles at once; then the field is smoothed.

    A step is cut to ``most`` either way; a tile whose 2x2 matrix has a determinant under ``least`` stops.
    """
    h, w = ref.shape[:2]
    f = edge(ref.astype(np.float64), 1)
    gx, gy = (f[1:-1, 2:] - f[1:-1, :-2]) / 2, (f[2:, 1:-1] - f[:-2, 1:-1]) / 2
    centre = f[1:-1, 1:-1]
    total = lambda a: tile_sums(a.sum(axis=2), tile)
    xx, yy, xy = total(gx * gx), total(gy * gy), total(gx * gy)
    det = xx * yy - xy * xy
    live = np.abs(det) >= least
    safe = np.where(live, det, 1)
    field = coarse.astype(np.float64)
    y, x = np.mgrid[0:h, 0:w]
    for _ in range(iterations):
        shift = per_pixel(field, h, w, tile)
        t = bilinear(src, x + shift[..., 0], y + shift[..., 1]) - centre
        xt, yt = total(gx * t), total(gy * t)
        step = np.stack([(yt * xy - xt * yy) / safe, (xt * xy - yt * xx) / safe], axis=-1)
        field = field + np.where(live[..., None], np.clip(step, -most, most), 0)
    return smooth_field(field)


def structure_tensor(ref: np.ndarray, radius: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pixel the gradient's direction (cos, sin) and the coherence of the (2 radius + 1)^2 around."""
    luma = ref.astype(np.float64).mean(axis=2)
    f = edge(luma, 1)
    gx, gy = (f[1:-1, 2:] - f[1:-1, :-2]) / 2, (f[2:, 1:-1] - f[:-2, 1:-1]) / 2

    def box(a):
        # edges are repeated, then both axes are summed by differences of running sums
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (radius, radius)
            c = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis)
            c = np.insert(c, 0, 0, axis=axis)
            n = 2 * radius + 1
            a = np.take(c, range(n, c.shape[axis]), axis=axis) - np.take(c, range(c.shape[axis] - n), axis=axis)
        return a

    xx, yy, xy = box(gx * gx), box(gy * gy), box(gx * gy)
    half = (xx + yy) / 2
    root = np.sqrt(np.maximum(0, half * half - (xx * yy - xy * xy)))
    large, small = half + root, np.maximum(0, half - root)
    theta = 0.5 * np.arctan2(2 * xy, xx - yy)
    return np.cos(theta), np.sin(theta), (large - small) / (large + small + 1e-6)


def kernel_regression(frames: list[np.ndarray], fields: list[np.ndarray], scale: int = 2, variance: float = 4e6, tile: int = TILE, base: float = 1.0, stretch: float = 2.0, cutoff: float = 1.5) -> np.ndarray:
    """Merge onto a grid ``scale`` times as fine: samples of all frames, weighed by an anisotropic Gaussian and by likeness.

    The Gaussian is long along edges (by the structure tensor) and short across. Weights under 1e-3 do not
    count; where hardly any weight is left, the reference is interpolated. All output pixels take one
    neighbour at a time, so memory is a few images.
    """
    h, w = frames[0].shape[:2]
    cos, sin, coherence = structure_tensor(frames[0])
    ly, lx = (np.arange(h * scale) + 0.5) / scale - 0.5, (np.arange(w * scale) + 0.5) / scale - 0.5
    near = lambda v, n: np.clip(np.floor(np.abs(v) + 0.5) * np.sign(v), 0, n - 1).astype(np.int64)
    at = np.ix_(near(ly, h), near(lx, w))
    c, s = cos[at], sin[at]
    long = 1 + (stretch - 1) * coherence[at]
    along, across = base * long, base / long
    reach = np.maximum(1, np.ceil(np.maximum(along, across) * cutoff)).astype(np.int64)
    gy, gx = np.meshgrid(ly, lx, indexing="ij")
    ref = bilinear(frames[0], gx, gy)
    ty, tx = (np.clip(np.trunc(np.floor(v) / tile), 0, n - 1).astype(np.int64) for v, n in ((ly, tiles(h, tile)), (lx, tiles(w, tile))))
    total, weight = np.zeros(ref.shape), np.zeros(ref.shape)
    for k, frame in enumerate(frames):
        shift = np.zeros((*gx.shape, 2)) if k == 0 else fields[k - 1][ty][:, tx]
        bx, by = np.floor(gx + shift[..., 0]).astype(np.int64), np.floor(gy + shift[..., 1]).astype(np.int64)
        for oy in range(-int(reach.max()), int(reach.max()) + 1):
            for ox in range(-int(reach.max()), int(reach.max()) + 1):
                px, py = bx + ox, by + oy
                dx, dy = px - shift[..., 0] - gx, py - shift[..., 1] - gy
                q = ((dy * c - dx * s) / along) ** 2 + ((dx * c + dy * s) / across) ** 2
                g = np.exp(-0.5 * q)
                use = (g >= 1e-3) & (px >= 0) & (px < w) & (py >= 0) & (py < h) & (max(abs(ox), abs(oy)) <= reach)
                if not use.any():
                    continue
                v = frame[py[use], px[use]].astype(np.float64)
                m = g[use][:, None] * np.exp(-((v - ref[use]) ** 2) / (2 * variance))
                total[use] += m * v
                weight[use] += m
    return round_half(np.where(weight > 1e-6, total / np.maximum(weight, 1e-30), ref))


def meter_motion(fields: list[np.ndarray], base: float = 4e6) -> tuple[np.ndarray, float]:
    """Which frames to keep, and the noise variance for their mean motion."""
    motion = np.array([np.hypot(f[..., 0], f[..., 1]).mean() for f in fields])
    if not len(motion):
        return np.zeros(0, bool), base
    median = np.sort(motion)[len(motion) // 2]
    keep = ~(((median > 0) & (motion > 2.5 * median)) | (motion > 6.0))
    if keep.sum() < 2 and len(motion) >= 2:
        keep = np.zeros(len(motion), bool)
        keep[np.argsort(motion, kind="stable")[:2]] = True
    mean = motion[keep].mean() if keep.any() else 0.0
    return keep, float(base * min(max(1 + 0.08 * (3 - mean), 0.4), 1.5))
