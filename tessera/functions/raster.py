"""Rasters as arrays: packing, develop, warp. Arrays are height x width (x channel), uint16 unless said."""

from __future__ import annotations

import numpy as np

from tessera.operators.color import DELTA, RGB_TO_XYZ, WHITE, XYZ_TO_RGB

TOP = 65535.0


def pack(a: np.ndarray) -> bytes:
    """Row-major little-endian 16 bits, as the ``data`` column of the raster layout holds them."""
    return np.ascontiguousarray(a, dtype="<u2").tobytes()


def unpack(data: bytes, width: int, height: int, channels: int = 3) -> np.ndarray:
    """The inverse of ``pack``; ValueError if the size does not fit."""
    if len(data) != 2 * width * height * channels:
        raise ValueError(f"{len(data)} bytes for {width}x{height}x{channels}")
    a = np.frombuffer(data, dtype="<u2")
    return a.reshape(height, width, channels) if channels > 1 else a.reshape(height, width)


def cut_off(a: np.ndarray) -> np.ndarray:
    """Clamped, the fraction dropped."""
    return np.clip(a, 0, TOP).astype(np.uint16)


def round_half(a: np.ndarray) -> np.ndarray:
    """Clamped, halves up."""
    return (np.clip(a, 0, TOP) + 0.5).astype(np.uint16)


def edge(a: np.ndarray, by: int) -> np.ndarray:
    """a with its edge values repeated ``by`` times all round."""
    return np.pad(a, [(by, by), (by, by)] + [(0, 0)] * (a.ndim - 2), mode="edge")


def gray8(rgb: np.ndarray) -> np.ndarray:
    """8-bit luma of 8-bit RGB."""
    f = rgb.astype(np.float32)
    return np.clip(np.float32(0.299) * f[..., 0] + np.float32(0.587) * f[..., 1] + np.float32(0.114) * f[..., 2], 0, 255).astype(np.uint8)


def bayer_colors(height: int, width: int, filters: int) -> np.ndarray:
    """The colour index of each sensor cell; the pattern word has two bits for each of 8 x 2 cells."""
    row, col = np.mgrid[0:height, 0:width]
    return (np.uint64(filters) >> (2 * ((2 * row & 14) | (col & 1))).astype(np.uint64)).astype(np.int64) & 3


def demosaic(cfa: np.ndarray, black: int, gains, matrix, filters: int) -> np.ndarray:
    """RGB of a sensor plane: black level, white balance, same-colour mean of the 3x3 round each cell, colour matrix.

    A cell keeps its own sample exactly; both greens are one colour; at the border fewer cells count.
    """
    h, w = cfa.shape
    color = bayer_colors(h, w, filters)
    v = np.maximum(cfa.astype(np.int64) - black, 0).astype(np.float32)
    v = cut_off(v * np.asarray(gains, dtype=np.float32)[color]).astype(np.float32)
    plane = np.where(color == 3, 1, color)
    out = np.zeros((h, w, 3), dtype=np.float32)
    for c in range(3):
        own = plane == c
        values, there = np.pad(np.where(own, v, 0), 1), np.pad(own.astype(np.float32), 1)
        total = sum(values[i : i + h, j : j + w] for i in range(3) for j in range(3))
        count = sum(there[i : i + h, j : j + w] for i in range(3) for j in range(3))
        out[..., c] = np.where(own, v, np.floor(total / np.maximum(count, 1)))
    m = np.asarray(matrix, dtype=np.float32)
    return cut_off(out @ m[:, :3].T + (m[:, 3] if m.shape[1] > 3 else 0))


def bilinear(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples at real places, the edge repeated beyond it."""
    h, w = a.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if a.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    f = a.astype(np.float64)
    return (f[y0, x0] * (1 - fx) + f[y0, x1] * fx) * (1 - fy) + (f[y1, x0] * (1 - fx) + f[y1, x1] * fx) * fy


def warp(src: np.ndarray, h: np.ndarray, width: int, height: int, offset: tuple[int, int] = (0, 0)) -> np.ndarray:
    """dst(x, y) = src(H (x + ox, y + oy)), bilinear; 0 where a tap is outside or the denominator nearly 0."""
    y, x = np.mgrid[0:height, 0:width].astype(np.float64)
    x, y = x + offset[0], y + offset[1]
    m = np.asarray(h, dtype=np.float64).ravel()
    w = m[6] * x + m[7] * y + m[8]
    safe = np.where(np.abs(w) < 1e-10, 1.0, w)
    u, v = (m[0] * x + m[1] * y + m[2]) / safe, (m[3] * x + m[4] * y + m[5]) / safe
    sh, sw = src.shape[:2]
    u0, v0 = np.floor(u), np.floor(v)
    ok = (np.abs(w) >= 1e-10) & (u0 >= 0) & (v0 >= 0) & (u0 + 1 < sw) & (v0 + 1 < sh)
    out = np.zeros((height, width, *src.shape[2:]), dtype=np.uint16)
    out[ok] = cut_off(bilinear(src, u[ok], v[ok]))
    return out


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """Lab of sRGB samples."""
    v = rgb.astype(np.float64) / TOP
    linear = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    t = linear @ np.array(RGB_TO_XYZ).T / np.array(WHITE)
    f = np.where(t > DELTA**3, np.cbrt(t), t / (3 * DELTA * DELTA) + 4.0 / 29.0)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    """sRGB samples of Lab, clamped, the fraction dropped."""
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], axis=-1)
    xyz = np.where(f > DELTA, f**3, 3 * DELTA * DELTA * (f - 4.0 / 29.0)) * np.array(WHITE)
    linear = np.maximum(xyz @ np.array(XYZ_TO_RGB).T, 0)
    return cut_off(np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055) * TOP)


def transfer(rgb: np.ndarray, own: tuple, reference: tuple) -> np.ndarray:
    """rgb with the Lab means and deviations (three each) of ``own`` mapped to those of ``reference``; a deviation of at most 1e-6 counts as 1."""
    (mean, std), (to_mean, to_std) = (tuple(np.asarray(x, dtype=np.float64) for x in s) for s in (own, reference))
    return from_lab((to_lab(rgb) - mean) * (to_std / np.where(std <= 1e-6, 1.0, std)) + to_mean)


def luma8(rgb: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Luma of the upper eight bits at whole places; NaN outside."""
    h, w = rgb.shape[:2]
    x, y = x.astype(np.int64), y.astype(np.int64)
    inside = (x >= 0) & (y >= 0) & (x < w) & (y < h)
    v = (rgb[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)] >> 8).astype(np.float64)
    return np.where(inside, 0.299 * v[:, 0] + 0.587 * v[:, 1] + 0.114 * v[:, 2], np.nan)


def psnr(a: np.ndarray, b: np.ndarray, peak: float = TOP) -> float:
    mse = np.mean((a.astype(np.float64) - b.astype(np.float64)) ** 2)
    return float("inf") if mse == 0 else float(10 * np.log10(peak * peak / mse))
