"""Planes and grids: projective maps, chunk and tile grids, overlap of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def chunk_grid(spark: SparkSession, width: int, height: int, chunk: int) -> DataFrame:
    """Chunks of a canvas: id C_x_y, offsets and sizes, edges clipped."""
    xs = F.explode(F.sequence(F.lit(0), F.lit(width - 1), F.lit(chunk)))
    ys = F.explode(F.sequence(F.lit(0), F.lit(height - 1), F.lit(chunk)))
    grid = spark.range(1).select(xs.alias("x_offset")).select("x_offset", ys.alias("y_offset"))
    return grid.select(
        F.concat(F.lit("C_"), (F.col("x_offset") / chunk).cast("int").cast("string"), F.lit("_"), (F.col("y_offset") / chunk).cast("int").cast("string")).alias("id"),
        "x_offset",
        "y_offset",
        F.least(F.lit(chunk), F.lit(width) - F.col("x_offset")).alias("width"),
        F.least(F.lit(chunk), F.lit(height) - F.col("y_offset")).alias("height"),
    )


def recommended_chunk(memory_gb: Column, cpu: bool = False) -> Column:
    """The chunk edge for a device's memory."""
    low, high = (16, 32) if cpu else (8, 16)
    return F.when(memory_gb >= high, 4096).when(memory_gb >= low, 2048).otherwise(1024)


def tile_of(v: Column, tile: int, tiles: int | Column) -> Column:
    """The tile of a pixel; beyond the last full tile, the last."""
    return F.least(F.floor(v / tile), (F.lit(tiles) if isinstance(tiles, int) else tiles) - 1).cast("int")


def project(h: list[Column] | tuple, x: Column, y: Column, least: float = 1e-10) -> tuple[Column, Column]:
    """(x, y) by a row-major 3x3 matrix; a denominator nearer 0 than ``least`` counts as that, with its sign."""
    h = [F.lit(float(c)) if not isinstance(c, Column) else c for c in h]
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(F.abs(w) < least, F.when(w < 0, -least).otherwise(least)).otherwise(w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def reprojection_error(h: list[Column] | tuple, x: Column, y: Column, u: Column, v: Column) -> Column:
    """The distance of the projected (x, y) from (u, v); the largest float where the denominator is nearly 0."""
    h = [F.lit(float(c)) if not isinstance(c, Column) else c for c in h]
    w = h[6] * x + h[7] * y + h[8]
    safe = F.when(F.abs(w) >= 1e-10, w)
    return F.coalesce(F.hypot((h[0] * x + h[1] * y + h[2]) / safe - u, (h[3] * x + h[4] * y + h[5]) / safe - v), F.lit(3.4028234663852886e38))


def invert(h: list[Column]) -> Column:
    """The inverse of a 3x3 matrix as an array of nine, null if it is singular."""
    a, b, c, d, e, f, g, i, j = h
    cofactors = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    det = a * cofactors[0] + b * cofactors[3] + c * cofactors[6]
    return F.when(F.abs(det) >= 1e-12, F.array(*(k / det for k in cofactors)))


def from_parameters(p: Column) -> Column:
    """Eight parameters and a one."""
    return F.concat(p, F.array(F.lit(1.0)))


def corner_box(h: list[Column] | tuple, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """The box round the four projected corners: x0, y0, x1, y1."""
    zero = F.lit(0.0)
    points = [project(h, x, y) for x, y in ((zero, zero), (width, zero), (zero, height), (width, height))]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def coverage_box(df: DataFrame, keys: list[str], x: str, y: str, covered: Column) -> DataFrame:
    """The box of the covered pixels of each key."""
    return df.where(covered).groupBy(*keys).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def overlap(boxes: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """Chunks and the boxes (x0, y0, x1, y1) that overlap them, edges alone not counting.

    Chunks are the cells of a grid: a box is dealt to the cells it may touch and meets them by an
    equi-join, and the inequalities are then checked. Boxes that have a null edge meet every chunk.
    """
    known = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    cell = lambda v: F.floor(F.col(v) / chunk).cast("int")
    span = chunks.agg(F.min(cell("x_offset")).alias("_cx0"), F.max(cell("x_offset")).alias("_cx1"), F.min(cell("y_offset")).alias("_cy0"), F.max(cell("y_offset")).alias("_cy1"))
    bounded = boxes.join(F.broadcast(span))  # one row
    x0, x1 = F.coalesce(F.greatest(cell("x0"), F.col("_cx0")), F.col("_cx0")), F.coalesce(F.least(cell("x1"), F.col("_cx1")), F.col("_cx1"))
    y0, y1 = F.coalesce(F.greatest(cell("y0"), F.col("_cy0")), F.col("_cy0")), F.coalesce(F.least(cell("y1"), F.col("_cy1")), F.col("_cy1"))
    dealt = bounded.withColumn("_x0", x0).withColumn("_x1", x1).withColumn("_y0", y0).withColumn("_y1", y1).where("_x0 <= _x1 and _y0 <= _y1")
    dealt = dealt.withColumn("_cx", F.explode(F.sequence("_x0", "_x1"))).withColumn("_cy", F.explode(F.sequence("_y0", "_y1")))
    cells = chunks.withColumn("_cx", cell("x_offset")).withColumn("_cy", cell("y_offset"))
    inside = ~known | ((F.col("x0") < F.col("x_offset") + F.col("width")) & (F.col("x1") > F.col("x_offset")) & (F.col("y0") < F.col("y_offset") + F.col("height")) & (F.col("y1") > F.col("y_offset")))
    own = [c for c in boxes.columns]
    return dealt.join(cells, ["_cx", "_cy"]).where(inside).select(*own, *[c for c in chunks.columns if c not in own])


def export_scale(width: Column, height: Column, most: int) -> Column:
    return F.lit(float(most)) / F.greatest(width, height)


def chunk_placement(offset: Column, size: Column, scale: Column | float) -> tuple[Column, Column]:
    """A chunk's place and size in an export, cut to whole pixels, of one pixel at least."""
    s = F.lit(scale) if not isinstance(scale, Column) else scale
    return (offset * s).cast("int"), F.greatest((size * s).cast("int"), F.lit(1))
