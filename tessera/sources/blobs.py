"""A blob store on Parquet: payloads with a tag, and the byte forms of rasters and features."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import raster


def frame_pixels(a: np.ndarray) -> bytes:
    """Width and height as 32-bit integers, then the samples."""
    return struct.pack("<ii", a.shape[1], a.shape[0]) + raster.pack(a)


def unframe_pixels(data: bytes | None) -> np.ndarray | None:
    """The inverse; null for what is no such frame."""
    if data is None or len(data) < 8 or (len(data) - 8) % 2:
        return None
    w, h = struct.unpack_from("<ii", data)
    if w <= 0 or h <= 0 or (len(data) - 8) // 2 % (w * h):
        return None
    return raster.unpack(data[8:], w, h, (len(data) - 8) // 2 // (w * h))


def frame_features(points: np.ndarray, descriptors: np.ndarray) -> bytes:
    """A count, the points as 32-bit floats, the descriptors as four 64-bit words each."""
    return struct.pack("<i", len(points)) + np.asarray(points, "<f4").tobytes() + np.asarray(descriptors, "<u8").tobytes()


def unframe_features(data: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    if data is None or len(data) < 4:
        return None
    n = struct.unpack_from("<i", data)[0]
    if n < 0 or len(data) != 4 + n * (8 + 32):
        return None
    return np.frombuffer(data, "<f4", 2 * n, 4).reshape(n, 2), np.frombuffer(data, "<u8", 4 * n, 4 + 8 * n).reshape(n, 4)


class BlobStore:
    """Blobs (blob_id, format_tag, data) under a path, appended in files of bounded size and read back by id.

    Ids follow the largest there is; a batch of blobs is numbered in the order of its own ``order`` column.
    """

    SCHEMA = T.StructType([T.StructField("blob_id", T.LongType()), T.StructField("format_tag", T.StringType()), T.StructField("data", T.BinaryType())])

    def __init__(self, spark: SparkSession, path: str, per_file: int = 1000):
        self.spark, self.path, self.per_file = spark, path, per_file

    def all(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def append(self, blobs: DataFrame, order: str) -> DataFrame:
        """Write (order, format_tag, data); returns order and the new blob_id."""
        from pyspark.sql import Window

        last = self.all().agg(F.coalesce(F.max("blob_id"), F.lit(0))).first()[0]
        keys = blobs.select(order).withColumn("blob_id", F.row_number().over(Window.orderBy(order)) + F.lit(last))
        blobs.join(keys, order).select("blob_id", "format_tag", "data").write.mode("append").option("maxRecordsPerFile", self.per_file).parquet(self.path)
        return keys

    def read(self, blob_id: int) -> bytes | None:
        """One payload; the filter reaches the Parquet scan."""
        row = self.all().where(F.col("blob_id") == blob_id).select("data").first()
        return None if row is None else bytes(row.data)


OFFSETS = "struct<tilesX:int,tilesY:int,offsets:array<double>>"
CHECKPOINT = "struct<iteration:int,lambda:double,parameters:array<double>>"


def offsets_to_json(tiles_x: Column, tiles_y: Column, offsets: Column) -> Column:
    return F.to_json(F.struct(tiles_x.alias("tilesX"), tiles_y.alias("tilesY"), offsets.alias("offsets")))


def offsets_from_json(text: Column) -> Column:
    """The struct, null unless it has two numbers for each tile."""
    s = F.from_json(text, OFFSETS)
    return F.when(F.size(s["offsets"]) == 2 * s["tilesX"] * s["tilesY"], s)


def checkpoint_to_json(iteration: Column, damping: Column, parameters: Column) -> Column:
    return F.to_json(F.struct(iteration.alias("iteration"), damping.alias("lambda"), parameters.alias("parameters")))


def checkpoint_from_json(text: Column, images: int | None = None) -> Column:
    s = F.from_json(text, CHECKPOINT)
    fits = s["iteration"].isNotNull() & s["parameters"].isNotNull()
    return F.when(fits & (F.size(s["parameters"]) == 8 * images) if images is not None else fits, s)
