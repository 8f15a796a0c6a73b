"""Stencils along one dimension, as windows: each works on rows of ``keys`` in the order of ``order``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "i", first: int = 0) -> DataFrame:
    """Rows of each key numbered from ``first``; the later stencils reuse the same partitioning."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1 + first)


def blur5(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "y16") -> DataFrame:
    """Sixteen times the binomial blur [1 4 6 4 1] / 16; beyond an edge stands the edge's value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v = F.col(value)
    l1, r1 = F.coalesce(F.lag(v, 1).over(w), v), F.coalesce(F.lead(v, 1).over(w), v)
    l2, r2 = F.coalesce(F.lag(v, 2).over(w), l1), F.coalesce(F.lead(v, 2).over(w), r1)
    return df.withColumn(out, l2 + 4 * l1 + 6 * v + 4 * r1 + r2)


def downsample2(df: DataFrame, index: str) -> DataFrame:
    """Every second row, the first included."""
    return df.where(F.col(index) % 2 == 0).withColumn(index, F.floor(F.col(index) / 2))


def blur_downsample2(df: DataFrame, keys: list[str], order: list[str], index: str, value: str, out: str = "y16") -> DataFrame:
    """Sixteen times the blur over whole signals, at every second row (Downsample2x in one dimension)."""
    return downsample2(blur5(df, keys, order, value, out), index)


def upsample(df: DataFrame, keys: list[str], index: str, value: str, factor: int = 2, out: str = "value") -> DataFrame:
    """Linear interpolation of the n samples of each key (numbered from 0) to ``factor`` * n, ends on ends.

    Each row makes the places from its own up to the next row's; the one sample of a key stands in all its places.
    """
    w = Window.partitionBy(*keys)
    i, n = F.col(index), F.count(F.lit(1)).over(w)
    ahead = F.lead(F.col(value)).over(w.orderBy(index))
    wide = df.select(*keys, F.col(index).cast("long").alias("_i"), F.col(value).alias("_a"), F.when(i < n - 1, ahead).otherwise(F.col(value)).alias("_b"), (n - 1).alias("_s"), (n * factor - 1).alias("_t"))
    places = wide.withColumn("x", F.explode(F.expr("case when _s = 0 then sequence(0L, _t) when _i = _s then array(_t) else sequence((_i * _t + _s - 1) div _s, ((_i + 1) * _t + _s - 1) div _s - 1) end")))
    part = F.when(F.col("_s") == 0, F.lit(0.0)).otherwise((F.col("x") * F.col("_s")) % F.col("_t") / F.col("_t"))
    return places.withColumn("_w", part).select(*keys, "x", (F.col("_a") * (1 - F.col("_w")) + F.col("_b") * F.col("_w")).alias(out))


def gap_distance(df: DataFrame, keys: list[str], index: str, gap: Column, out: str = "d", none: int = 1_000_000) -> DataFrame:
    """Steps to the nearest row where ``gap`` holds, either way."""
    w = Window.partitionBy(*keys).orderBy(index)
    at = F.when(gap, F.col(index))
    left = F.max(at).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    right = F.min(at).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return df.withColumn(out, F.least(F.coalesce(F.col(index) - left, F.lit(none)), F.coalesce(right - F.col(index), F.lit(none))))


def longest_run(df: DataFrame, keys: list[str], index: str, flag: Column, least: int) -> DataFrame:
    """The longest run of rows with the flag, per key, where it has ``least`` rows or more."""
    flagged = df.withColumn("_f", flag)
    group = F.col(index) - F.row_number().over(Window.partitionBy(*keys, "_f").orderBy(index))
    runs = flagged.withColumn("_g", group).where("_f").groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_c"))
    return runs.groupBy(*keys).agg(F.max("_c").alias("run")).where(F.col("run") >= least)


def tile_power(df: DataFrame, keys: list[str], index: str, value: str, tile: int = 16) -> DataFrame:
    """The power spectrum of each tile of a signal: tile, k and re^2 + im^2, one aggregation for all k."""
    angle = 2 * F.pi() * F.col("k") * (F.col(index) % tile) / tile
    wide = df.withColumn("tile", F.floor(F.col(index) / tile).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tile - 1))))
    return wide.groupBy(*keys, "tile", "k").agg((F.pow(F.sum(F.col(value) * F.cos(angle)), 2) + F.pow(F.sum(F.col(value) * F.sin(angle)), 2)).alias("power"))


def block_match(a: DataFrame, b: DataFrame, keys: list[str], index: str, value: str, radius: int) -> DataFrame:
    """Per row of a: the shift of b within the radius with the least absolute difference.

    Ties go to the smaller shift, then to the lower one. A shift that leaves b is no candidate.
    """
    shifts = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    probes = a.select(*keys, F.col(index), F.col(value).alias("_a"), shifts.alias("d")).withColumn("_at", F.col(index) + F.col("d"))
    other = b.select(*keys, F.col(index).alias("_at"), F.col(value).alias("_b"))
    sad = probes.join(other, [*keys, "_at"]).groupBy(*keys, index, "d").agg(F.sum(F.abs(F.col("_a") - F.col("_b"))).alias("sad"))
    best = F.min(F.struct("sad", F.abs("d").alias("m"), "d"))
    return sad.groupBy(*keys, index).agg(best.alias("_s")).select(*keys, index, F.col("_s.d").alias("d"))


def smooth_grid(df: DataFrame, x: str, y: str, value: str, out: str = "smooth") -> DataFrame:
    """The mean over the 3x3 neighbours that are there, by dealing each cell to its nine places."""
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a as a, b as b))))"))
    dealt = df.select(F.col(x), F.col(y), F.col(value).alias("_v"), around.alias("_o")).select((F.col(x) + F.col("_o.a")).alias(x), (F.col(y) + F.col("_o.b")).alias(y), "_v")
    return df.select(x, y).join(dealt.groupBy(x, y).agg(F.avg("_v").alias(out)), [x, y])
