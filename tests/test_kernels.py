"""Array kernels: small fixtures with known answers, plain loops, and quality gates on synthetic bursts."""

import numpy as np
import pytest

from tessera.functions import blend, burst, features, raster, solve


def scene(h, w, seed=1):
    rng = np.random.default_rng(seed)
    a = np.pad(rng.uniform(4000, 60000, (h, w, 3)), [(2, 2), (2, 2), (0, 0)], mode="edge")
    return (sum(a[i : i + h, j : j + w] for i in range(5) for j in range(5)) / 25).astype(np.uint16)


def shifted(a, dx, dy):
    h, w = a.shape[:2]
    y, x = np.mgrid[0:h, 0:w]
    return np.clip(raster.bilinear(a, x - dx, y - dy), 0, 65535)


def noisy(a, sigma, seed):
    return np.clip(a + np.random.default_rng(seed).normal(0, sigma, a.shape), 0, 65535).astype(np.uint16)


def test_pack_round_trip():
    a = scene(5, 7)
    assert (raster.unpack(raster.pack(a), 7, 5) == a).all()
    with pytest.raises(ValueError):
        raster.unpack(b"123", 1, 1)


def test_demosaic():
    y, x = np.mgrid[0:20, 0:24]
    cfa = (200 + (31 * x + 19 * y) % 3000).astype(np.uint16)
    gains, word = [1.8, 1.0, 1.5, 1.0], 0x94949494
    out = raster.demosaic(cfa, 64, gains, [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]], word)
    color = raster.bayer_colors(20, 24, word)
    assert color[:2, :2].tolist() == [[0, 1], [1, 2]]
    own = np.clip((cfa - 64.0) * np.array(gains)[color], 0, 65535).astype(int)
    for r, c in ((0, 0), (7, 5), (19, 23)):
        assert abs(int(out[r, c, color[r, c]]) - own[r, c]) <= 1
        for k in range(3):
            near = [own[i, j] for i in range(max(0, r - 1), min(20, r + 2)) for j in range(max(0, c - 1), min(24, c + 2)) if color[i, j] == k]
            if color[r, c] != k:
                assert abs(int(out[r, c, k]) - int(np.mean(near))) <= 1


def test_warp():
    y, x, c = np.mgrid[0:30, 0:40, 0:3]
    a = ((37 * x + 53 * y + 17 * c) % 4001).astype(np.uint16)
    assert (raster.warp(a, np.eye(3), 39, 29) == a[:29, :39]).all()
    moved = raster.warp(a, [1, 0, 3, 0, 1, -2, 0, 0, 1], 40, 30)
    assert (moved[5:20, 5:20] == a[3:18, 8:23]).all() and not moved[0].any()
    angle = 0.06
    h = [np.cos(angle), -np.sin(angle), 1.7, np.sin(angle), np.cos(angle), 0.9, 0, 0, 1]
    out = raster.warp(a, h, 40, 30)
    u, v = h[0] * 9 + h[1] * 11 + 1.7, h[3] * 9 + h[4] * 11 + 0.9
    i, j, f, g = int(v), int(u), v - int(v), u - int(u)
    want = (a[i, j] * (1 - g) + a[i, j + 1] * g) * (1 - f) + (a[i + 1, j] * (1 - g) + a[i + 1, j + 1] * g) * f
    assert np.abs(out[11, 9].astype(float) - want).max() <= 1


def test_fast_and_brief():
    gray = np.full((32, 32), 128, np.uint8)
    gray[8:16, 8:16] = 255
    corners = features.fast_corners(gray)
    assert len(corners) >= 1 and {tuple(c) for c in corners} & {(8, 8), (15, 8), (8, 15), (15, 15)}
    assert len(features.fast_corners(np.full((32, 32), 9, np.uint8))) == 0 and len(features.fast_corners(gray[:6])) == 0
    assert [tuple(c) for c in corners] == sorted((tuple(c) for c in corners), key=lambda c: (c[1], c[0]))
    p = features.pattern()
    assert p.shape == (256, 4) and p.min() == -15 and p.max() == 15
    d = features.describe(gray, corners)
    x, y = corners[0]
    at = lambda dx, dy: gray[np.clip(y + dy, 0, 31), np.clip(x + dx, 0, 31)]
    for bit in (0, 63, 64, 255):
        assert (int(d[0, bit // 64]) >> (bit % 64)) & 1 == int(at(*p[bit, :2]) < at(*p[bit, 2:]))


def test_match_ratio_and_ties():
    a = np.array([[0, 0, 0, 0], [255, 0, 0, 0]], np.uint64)
    b = np.array([[1, 0, 0, 0], [1, 0, 0, 0], [255, 0, 0, 0]], np.uint64)
    assert features.match(a, b).tolist() == [[1, 2, 0]]  # the first has two equally near
    assert features.match(a, b[:1]).tolist() == [[0, 0, 1], [1, 0, 7]]
    assert len(features.match(a, b[:0])) == 0


def test_homography_and_ransac():
    rng = np.random.default_rng(2)
    h = np.array([1.02, 0.03, 5, -0.02, 0.98, -7, 1e-4, -5e-5, 1])
    src = rng.uniform(0, 500, (20, 2))
    dst = solve.project(h, src)
    assert np.allclose(solve.homography(src, dst), h, atol=1e-6)
    assert np.allclose(solve.homography(src[:4], dst[:4]), h, atol=1e-5)
    assert solve.homography(np.zeros((4, 2)), np.zeros((4, 2))) is None
    bad = np.concatenate([dst + 0, rng.uniform(0, 500, (8, 2))])
    got, n, ok = solve.ransac(np.concatenate([src, rng.uniform(0, 500, (8, 2))]), bad)
    assert ok and n >= 20 and np.abs(solve.project(got, src) - dst).max() < 0.5
    assert np.allclose(np.array(solve.invert(h)).reshape(3, 3) @ h.reshape(3, 3), np.eye(3)) and solve.invert(np.zeros(9)) is None
    assert solve.ransac(src[:3], dst[:3])[2] is False


def test_bundle_adjustment_resumes():
    p = np.array([[37 * i % 200, 53 * i % 200] for i in range(10)], float)
    rows = np.column_stack([np.zeros(10), np.ones(10), p + [3, -2], p])
    saved = []
    maps = solve.BundleAdjustment([0, 1], rows).run(save=lambda s: saved.append(dict(s)))
    assert np.abs(solve.project(maps[1], p) - (p + [3, -2])).max() < 0.1
    half = solve.BundleAdjustment([0, 1], rows)
    half.step()
    again = solve.BundleAdjustment([0, 1], rows, dict(half.state)).run()
    assert np.allclose(again[1], maps[1], atol=1e-3)


def test_block_match_and_refine():
    a = scene(64 + 20, 80 + 20)
    ref, src = a[10:74, 10:90], a[12:76, 7:87]  # src(x + 3, y - 2) = ref(x, y)
    field = burst.block_match(ref, src)
    assert (field[1:-1, 1:-1] == (3, -2)).all()
    flat = np.full((32, 32, 3), 9, np.uint16)
    assert (burst.block_match(flat, flat) == 0).all()
    b = scene(64, 80, 3)
    moved = shifted(b, 2.4, -1.7).astype(np.uint16)
    coarse = burst.block_match(b, moved)
    fine = burst.refine(b, moved, coarse)
    err = lambda f: np.hypot(f[1:-1, 1:-1, 0] - 2.4, f[1:-1, 1:-1, 1] + 1.7).mean()
    assert err(fine) < 0.25 and err(fine) < err(coarse)


def made_burst(h, w, sigma, shifts, seed=5):
    clean = scene(h, w, seed)
    frames = [noisy(shifted(clean, dx, dy), sigma, 10 + k) for k, (dx, dy) in enumerate(shifts)]
    return clean, frames


SHIFTS = [(0, 0), (2, -1), (-3, 2), (1, -3), (4, 1), (-2, 4), (3, -2), (-4, 2)]


@pytest.mark.parametrize("merge", ["robust", "fourier"])
def test_merges_beat_the_reference(merge):
    clean, frames = made_burst(48, 64, 2000, SHIFTS)
    fields = [burst.block_match(frames[0], f) for f in frames[1:]]
    out = burst.robust_merge(frames, fields) if merge == "robust" else burst.fourier_merge(frames, fields)
    assert raster.psnr(out, clean) > raster.psnr(frames[0], clean)
    with pytest.raises(ValueError):
        burst.fourier_merge(frames, fields, tile=12)


def test_robust_merge_is_the_weighted_mean():
    _, frames = made_burst(20, 24, 1500, SHIFTS[:3])
    fields = [burst.block_match(frames[0], f) for f in frames[1:]]
    out = burst.robust_merge(frames, fields)
    for y, x, c in ((0, 0, 0), (10, 13, 1), (19, 23, 2)):
        ref = float(frames[0][y, x, c])
        num, den = ref, 1.0
        for f, o in zip(frames[1:], fields, strict=True):
            dx, dy = o[min(y // 16, o.shape[0] - 1), min(x // 16, o.shape[1] - 1)]
            if 0 <= x + dx < 24 and 0 <= y + dy < 20:
                v = float(f[y + dy, x + dx, c])
                k = np.exp(-((v - ref) ** 2) / (2 * 2000.0**2))
                num, den = num + k * v, den + k
        assert abs(int(out[y, x, c]) - int(num / den)) <= 1


def test_super_resolution_beats_interpolation():
    fine = scene(60, 80, 7)
    parts = [(0, 0), (0.5, 0.333), (0.25, 0.667), (0.75, 0.111), (0.125, 0.444), (0.625, 0.778), (0.375, 0.222), (0.875, 0.556)]
    low = []
    y, x = np.mgrid[0:30, 0:40]
    for k, (dx, dy) in enumerate(parts):
        low.append(noisy(raster.bilinear(fine, 2 * (x - dx) + 0.5, 2 * (y - dy) + 0.5), 6000, 20 + k))
    fields = [np.full((2, 3, 2), (dx, dy)) for dx, dy in parts[1:]]
    out = burst.kernel_regression(low, fields, scale=2, variance=4e7)
    gy, gx = np.mgrid[0:60, 0:80]
    naive = np.clip(raster.bilinear(low[0], (gx + 0.5) / 2 - 0.5, (gy + 0.5) / 2 - 0.5), 0, 65535)
    assert out.shape == (60, 80, 3) and raster.psnr(out, fine) > raster.psnr(naive, fine) + 2


def test_motion_meter():
    still = [np.full((4, 5, 2), (0.5 + 0.05 * f, -0.3 + 0.02 * f)) for f in range(5)]
    keep, variance = burst.meter_motion(still)
    assert keep.all() and variance > 1e6
    keep, _ = burst.meter_motion([np.full((4, 5, 2), (0.4, 0.3))] * 4 + [np.full((4, 5, 2), 7.5)])
    assert keep.tolist() == [True] * 4 + [False]
    keep, _ = burst.meter_motion([np.full((1, 1, 2), v) for v in (50.0, 40.0, 60.0)])
    assert keep.tolist() == [True, True, False]


def test_chamfer_distance():
    mask = np.ones((9, 12), bool)
    mask[4, 3] = mask[0, 11] = False
    got = blend.coverage_distance(mask)
    for y in range(9):
        for x in range(12):
            steps = [max(abs(y - a), abs(x - b)) - min(abs(y - a), abs(x - b)) + min(abs(y - a), abs(x - b)) * np.sqrt(2) for a, b in ((4, 3), (0, 11))]
            assert got[y, x] == pytest.approx(min(steps))


def test_pyramid_collapses():
    a = scene(37, 50).astype(float)
    assert np.allclose(blend.collapse(blend.laplacian(blend.gaussian(a, 4))), a)
    assert np.allclose(blend.up(a, 37, 50), a)


def test_blend_gaps_ghosts_and_seams():
    def canvas(w, h, x0, x1, value):
        a = np.zeros((h, w, 3), np.uint16)
        a[:, x0:x1] = value
        return a

    gap = blend.blend([canvas(200, 40, 0, 100, 20000), canvas(200, 40, 100, 200, 21000)])
    assert gap.any(axis=2).all() and abs(int(gap[20, 5, 0]) - 20000) < 500 and abs(int(gap[20, 195, 0]) - 21000) < 500
    left, right = canvas(400, 40, 0, 250, 30000), canvas(400, 40, 150, 400, 30000)
    left[:, 160:170] = 50000
    right[:, 230:240] = 10000
    out = blend.blend([left, right]).astype(int)
    assert abs(out[20, 165, 0] - 50000) < 3000 and abs(out[20, 235, 0] - 10000) < 3000
    a, b = canvas(200, 40, 0, 120, 30000), canvas(200, 40, 80, 200, 30000)
    b[:, 98:102] = 45000
    out = blend.blend([a, b]).astype(int)[:, 98:102, 0]
    assert (np.abs(out - 30000) < np.abs(out - 45000)).mean() >= 0.7 or (np.abs(out - 45000) < np.abs(out - 30000)).mean() >= 0.7
    assert not blend.blend([canvas(20, 9, 0, 5, 7)])[:, 10:].any()


def test_fusion_and_painterly():
    rng = np.random.default_rng(3)
    low = np.concatenate([rng.uniform(500, 2500, (48, 32, 3)), rng.uniform(25000, 38000, (48, 32, 3))], axis=1).astype(np.uint16)
    high = np.concatenate([rng.uniform(25000, 38000, (48, 32, 3)), rng.uniform(62000, 65000, (48, 32, 3))], axis=1).astype(np.uint16)
    out = blend.fuse(low, high).astype(float)
    assert np.abs(out[:, :24] - high[:, :24]).mean() < np.abs(out[:, :24] - low[:, :24]).mean()
    assert np.abs(out[:, 40:] - low[:, 40:]).mean() < np.abs(out[:, 40:] - high[:, 40:]).mean()
    flat = np.full((48, 64, 3), 32768, np.uint16)
    p = blend.painterly(flat)
    assert p.max() < 32768 and p[0, 0, 0] < p[24, 32, 0]
