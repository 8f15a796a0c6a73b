"""The operators as SQL functions: hamming256, sigma_median, rgb_to_lab, warp_xy, and fast_corners as a table function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from tessera.functions import features, raster
from tessera.operators import color


def register(spark: SparkSession) -> None:
    """Make them known to a session; all but the table function are SQL expressions, so Catalyst sees through them."""
    spark.sql(
        """create or replace temporary function hamming256(a array<bigint>, b array<bigint>) returns int
           return aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, n) -> s + n)"""
    )
    spark.sql(
        """create or replace temporary function warp_xy(h array<double>, x double, y double) returns struct<x: double, y: double>
           return named_struct('x', (h[0] * x + h[1] * y + h[2]) / (h[6] * x + h[7] * y + h[8]), 'y', (h[3] * x + h[4] * y + h[5]) / (h[6] * x + h[7] * y + h[8]))"""
    )
    lin = lambda c: f"if({c} / 65535D <= 0.04045D, {c} / 65535D / 12.92D, power(({c} / 65535D + 0.055D) / 1.055D, 2.4D))"
    f = lambda k: f"aggregate(array(0), 0D, (s, i) -> if(v[{k}] > power(6D / 29D, 3D), cbrt(v[{k}]), v[{k}] / (3D * power(6D / 29D, 2D)) + 4D / 29D))"
    xyz = ", ".join("(" + " + ".join(f"{m}D * {lin(c)}" for m, c in zip(row, "rgb", strict=True)) + f") / {w}D" for row, w in zip(color.RGB_TO_XYZ, color.WHITE, strict=True))
    spark.sql(
        f"""create or replace temporary function rgb_to_lab(r double, g double, b double) returns struct<l: double, a: double, b: double>
            return transform(array(array({xyz})), v -> named_struct('l', 116D * {f(1)} - 16D, 'a', 500D * ({f(0)} - {f(1)}), 'b', 200D * ({f(1)} - {f(2)})))[0]"""
    )
    spark.udf.register("sigma_median", sigma_median)
    spark.udtf.register("fast_corners", FastCorners)


@pandas_udf(T.DoubleType())
def sigma_median(values: pd.Series) -> pd.Series:
    """The sigma-clipped upper median of each array."""

    def one(v):
        if v is None or not len(v):
            return None
        v = np.sort(np.asarray(v, float))
        if len(v) > 3:
            m, s = v.mean(), v.std()
            inside = v[(v >= m - 2 * s) & (v <= m + 2 * s)]
            v = inside if len(inside) else v
        return v[len(v) // 2]

    return values.map(one)


@udtf(returnType=T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))
class FastCorners:
    """Corners of a raster (width, height, data)."""

    def eval(self, width: int, height: int, data: bytes):
        gray = raster.gray8((raster.unpack(bytes(data), width, height) >> 8).astype(np.uint8))
        for x, y in features.fast_corners(gray).tolist():
            yield x, y


def lab(spark: SparkSession, df, r: str, g: str, b: str):
    """df with columns l, a, b."""
    values = color.rgb_to_lab(F.col(r), F.col(g), F.col(b))
    return df.withColumns(dict(zip(("lab_l", "lab_a", "lab_b"), values, strict=True)))
