"""Stacks: several samples of one cell reduced to one value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sigma_clipped_median(df: DataFrame, keys: list[str], value: str, sigma: float = 2.0, least: int = 3) -> DataFrame:
    """The upper median, per key, of the values within ``sigma`` population deviations of the mean.

    Stacks of at most ``least`` values are not clipped, and all values stay if none lies within. Null
    values are left out. A stack is the samples of one cell. The limits belong to the inside and do not
    depend on the order of rows: |v - mean| <= sigma * deviation is compared as (n d - sum d)^2 <=
    sigma^2 (n sum d^2 - (sum d)^2), where d is the distance from the middle value and sums run over the
    sorted stack: exact for whole numbers while these products stay below 2^53.
    """
    stacked = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    n = F.size("_v").cast("double")

    def off(v):
        return v.cast("double") - F.element_at("_v", (F.size("_v") / 2).cast("int") + 1).cast("double")

    def add(t, v):
        return F.struct((t["s"] + off(v)).alias("s"), (t["q"] + off(v) * off(v)).alias("q"))

    def inside(t):  # the sums are made once for a stack, as this is the end of their aggregate
        return F.filter("_v", lambda v: F.pow(n * off(v) - t["s"], 2) <= sigma * sigma * (n * t["q"] - t["s"] * t["s"]))

    clipped = stacked.withColumn("_i", F.aggregate("_v", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), add, inside))
    kept = F.when((F.size("_v") <= least) | (F.size("_i") == 0), F.col("_v")).otherwise(F.col("_i"))
    return clipped.withColumn("_k", kept).select(*keys, F.element_at("_k", (F.size("_k") / 2).cast("int") + 1).alias("median"))


def robust_mean(df: DataFrame, keys: list[str], order: list[str], value: str, sigma: float) -> DataFrame:
    """Per key, the mean weighed by exp(-(v - ref)^2 / 2 sigma^2), where ref is the first value in order.

    The reference is found by a map-side aggregate and joined back, so no stack is sorted.
    """
    ref = df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("_ref"))
    weight = F.exp(-F.pow(F.col(value) - F.col("_ref"), 2) / (2.0 * sigma * sigma))
    return df.join(ref, keys).groupBy(*keys).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("mean"))


def owner(df: DataFrame, keys: list[str], score: str, ties: list[str], keep: list[str]) -> DataFrame:
    """Per key, the row of the largest positive score; ties by the least of ``ties``. No row, no owner."""
    best = F.min_by(F.struct(*keep), F.struct((-F.col(score)).alias("s"), *ties))
    return df.where(F.col(score) > 0).groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col("_b")[c].alias(c) for c in keep])


def meter_motion(frames: DataFrame, frame: str, motion: str, relative: float = 2.5, absolute: float = 6.0, least: int = 2, keys: list[str] | None = None) -> DataFrame:
    """frame, motion, keep: a frame goes if it moves over ``relative`` times the upper median, or over ``absolute``.

    If that would keep fewer than ``least``, the ones of least motion stay. The frames are one row each;
    ``keys`` tell bursts apart, each of which is ranked on its own.
    """
    keys = keys or []
    n = Window.partitionBy(*keys)
    ranked = frames.select(*keys, frame, F.col(motion).alias("motion"), F.row_number().over(n.orderBy(motion, frame)).alias("_r"), F.count(F.lit(1)).over(n).alias("_n"))
    middle = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("motion"))).over(n)
    dropped = ((F.col("_med") > 0) & (F.col("motion") > relative * F.col("_med"))) | (F.col("motion") > absolute)
    judged = ranked.withColumn("_med", middle).withColumn("_ok", ~dropped).withColumn("_kept", F.sum(F.col("_ok").cast("int")).over(n))
    return judged.select(*keys, frame, "motion", F.when((F.col("_kept") < least) & (F.col("_n") >= least), F.col("_r") <= least).otherwise(F.col("_ok")).alias("keep"))


def noise_variance(metered: DataFrame, base: float) -> DataFrame:
    """The base variance scaled by the mean motion of the frames kept: 1 + 0.08 (3 - mean), within 0.4 to 1.5."""
    mean = F.avg(F.when(F.col("keep"), F.col("motion")))
    return metered.agg((base * F.least(F.greatest(1 + 0.08 * (3 - F.coalesce(mean, F.lit(0.0))), F.lit(0.4)), F.lit(1.5))).alias("noise_variance"))


def normal_equations(df: DataFrame, columns: list[str], target: str, keys: list[str] | None = None) -> DataFrame:
    """Sums of products of columns with each other (a_b) and with the target (a_rhs): one aggregation, partial on the map side."""
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return df.groupBy(*(keys or [])).agg(*sums, *(F.sum(F.col(a) * F.col(target)).alias(f"{a}_rhs") for a in columns), F.count(F.lit(1)).alias("n"))
