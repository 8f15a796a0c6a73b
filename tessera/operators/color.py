"""Tone and colour: per-value expressions and colour statistics, all built-in functions.

Values are 0..65535. "Truncated" ops clamp and cut the fraction off, "rounded" ops clamp and add a half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX = 65535.0
#: sRGB to XYZ (D65) and back, white point, Lab delta.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
DELTA = 6.0 / 29.0


def clamp(v: Column, low: float = 0.0, high: float = MAX) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def truncated(v: Column) -> Column:
    return clamp(v).cast("int")


def rounded(v: Column) -> Column:
    return F.floor(clamp(v) + 0.5).cast("int")


def apply_gain(v: Column, gain: float | Column) -> Column:
    """v * gain, truncated; v itself within 1e-6 of gain 1."""
    g = F.lit(float(gain)) if not isinstance(gain, Column) else gain
    return F.when(F.abs(g - 1.0) < 1e-6, v.cast("int")).otherwise(truncated(v * g))


def widen(v: Column) -> Column:
    """8 bits to 16."""
    return (v * 257).cast("int")


def narrow(v: Column) -> Column:
    """16 bits to 8."""
    return F.shiftright(v.cast("int"), 8)


def gray(r: Column, g: Column, b: Column, high: float = 255.0) -> Column:
    return clamp(0.299 * r + 0.587 * g + 0.114 * b, 0.0, high).cast("int")


def black_level(v: Column, black: int) -> Column:
    return F.greatest(v - black, F.lit(0)).cast("int")


def bayer_color(row: Column, col: Column, filters: int) -> Column:
    """The colour index of a sensor cell, two bits of the pattern word each."""
    place = (((row.cast("long") * 2).bitwiseAND(F.lit(14))).bitwiseOR(col.cast("long").bitwiseAND(F.lit(1))) * 2).cast("int")
    digits = F.transform(F.sequence(F.lit(0), F.lit(30), F.lit(2)), lambda k: F.floor(F.lit(filters) / F.pow(F.lit(2.0), k)).cast("long") % 4)
    return F.element_at(digits, (place / 2).cast("int") + 1)


def white_balance(v: Column, color: Column, gains: list[float]) -> Column:
    return truncated(v * F.element_at(F.array(*(F.lit(float(g)) for g in gains)), color.cast("int") + 1))


def color_matrix(r: Column, g: Column, b: Column, matrix: list[list[float]]) -> list[Column]:
    """Three rows of a 3x4 affine map, truncated."""
    return [truncated(m[0] * r + m[1] * g + m[2] * b + (m[3] if len(m) > 3 else 0.0)) for m in matrix]


def to_linear(v: Column) -> Column:
    """sRGB 0..1 to linear light."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def from_linear(v: Column) -> Column:
    """Linear light to sRGB 0..1; negative counts as 0."""
    p = F.greatest(v, F.lit(0.0))
    return F.when(p <= 0.0031308, 12.92 * p).otherwise(1.055 * F.pow(p, F.lit(1 / 2.4)) - 0.055)


def _lab_f(t: Column) -> Column:
    return F.when(t > DELTA**3, F.cbrt(t)).otherwise(t / (3 * DELTA * DELTA) + 4.0 / 29.0)


def _lab_back(t: Column) -> Column:
    return F.when(t > DELTA, t * t * t).otherwise(3 * DELTA * DELTA * (t - 4.0 / 29.0))


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    linear = [to_linear(c / MAX) for c in (r, g, b)]
    x, y, z = (_lab_f(sum(m * c for m, c in zip(row, linear, strict=True)) / w) for row, w in zip(RGB_TO_XYZ, WHITE, strict=True))
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def lab_to_rgb(l_: Column, a: Column, b: Column) -> list[Column]:
    y = (l_ + 16.0) / 116.0
    xyz = [w * _lab_back(t) for w, t in zip(WHITE, (y + a / 500.0, y, y - b / 200.0), strict=True)]
    return [truncated(from_linear(sum(m * c for m, c in zip(row, xyz, strict=True))) * MAX) for row in XYZ_TO_RGB]


def channel_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation of a channel per key, in one pass."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def reinhard_transfer(df: DataFrame, key: str, value: str, reference, out: str = "mapped") -> DataFrame:
    """Map each group's mean and deviation to those of the reference group; a deviation of at most 1e-6 counts as 1."""
    stats = channel_stats(df.select(key, value), [key], value)
    ref = stats.where(F.col(key) == reference).select(F.col("mean").alias("_rm"), F.col("std").alias("_rs"))
    both = stats.join(F.broadcast(ref.limit(1)))  # one row
    std = F.when(F.col("std") <= 1e-6, 1.0).otherwise(F.col("std"))
    joined = df.join(both, key)
    return joined.withColumn(out, (F.col(value) - F.col("mean")) * (F.col("_rs") / std) + F.col("_rm")).drop("mean", "std", "_rm", "_rs")


def gain_estimate(luma_ref: Column, luma_target: Column) -> Column:
    """An aggregate: sum of reference luma over sum of target luma, within 0.25 to 4, 1 where there is none."""
    target = F.sum(luma_target)
    return F.coalesce(clamp(F.sum(luma_ref) / F.when(target != 0, target), 0.25, 4.0), F.lit(1.0))


def gamma_curve(v: Column, gamma: float) -> Column:
    return rounded(MAX * F.pow(v / MAX, F.lit(gamma)))


def painterly_curve(v: Column, gamma: float = 1.5, rolloff: float = 0.2) -> Column:
    """Shadow gamma and highlight roll-off, 0..1."""
    t = F.pow(v / MAX, F.lit(gamma))
    return t / (1.0 + rolloff * t)


def vignette(x: Column, y: Column, width: int, height: int, strength: float = 0.35) -> Column:
    """1 in the middle, 1 - strength in the corners."""
    cx, cy = (width - 1) / 2.0, (height - 1) / 2.0
    return 1.0 - strength * ((x - cx) * (x - cx) + (y - cy) * (y - cy)) / max(cx * cx + cy * cy, 1e-12)


def well_exposedness(v: Column, sigma: float = 0.2) -> Column:
    """v is 0..1."""
    return F.exp(-((v - 0.5) * (v - 0.5)) / (2 * sigma * sigma))


def fusion_weight(low: Column, high: Column) -> Column:
    """The share of the first of two exposures; a half where neither has weight."""
    return F.when(low + high > 1e-6, low / (low + high)).otherwise(0.5)


def psnr(a: Column, b: Column, peak: float) -> Column:
    """An aggregate: 10 log10(peak^2 / mse), infinite for equal inputs."""
    mse = F.avg((a - b) * (a - b))
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10.0 * F.log10(peak * peak / mse))


def covered(*channels: Column) -> Column:
    """Whether any channel has data."""
    out = F.lit(False)
    for c in channels:
        out = out | (F.coalesce(c, F.lit(0)) != 0)
    return out
