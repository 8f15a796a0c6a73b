"""Raster files as DataFrames: standard images, raw DNG planes, TIFF."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import raster
from tessera.operators.color import RGB_TO_XYZ

STANDARD = ("jpg", "jpeg", "png", "bmp", "gif", "tga", "tif", "tiff")
RAW = ("dng", "raf", "cr2", "nef", "arw")


def extension(path: Column) -> Column:
    """The letters and digits after the last dot at the end of a path, lower-cased; empty if there are none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def is_standard(path: Column) -> Column:
    return extension(path).isin(*STANDARD)


def is_jpeg(path: Column) -> Column:
    return extension(path).isin("jpg", "jpeg")


def is_raw(path: Column) -> Column:
    return extension(path).isin(*RAW)


RASTER = "image_id long, width int, height int, data binary"
PLANE = "image_id long, path string, width int, height int, black int, gains array<float>, matrix array<array<float>>, filters long, make string, model string, preview binary, data binary"
#: TIFF fields: their numbers and the struct letters of their types, fixed by the format.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 7: "B", 9: "i", 10: "ii", 11: "f", 12: "d"}
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "make": 271, "model": 272, "strips": 273, "samples": 277, "rows": 278, "counts": 279, "planar": 284, "pattern_size": 33421, "pattern": 33422, "version": 50706, "black": 50714, "matrix": 50721, "neutral": 50728}
CFA, RGB = 32803, 2


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Standard images as 16-bit rasters (8 bits times 257); files that cannot be decoded are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def widen(batches):
        for pdf in batches:
            out = []
            for w, h, n, data in zip(pdf.width, pdf.height, pdf.nChannels, pdf.data, strict=True):
                a = np.frombuffer(data, dtype=np.uint8).reshape(h, w, n)
                rgb = np.repeat(a, 3, axis=2) if n == 1 else a[..., 2::-1]  # the source has BGR
                out.append(raster.pack(rgb.astype(np.uint16) * 257))
            yield pd.DataFrame({"path": pdf.origin, "width": pdf.width, "height": pdf.height, "data": out})

    return raw.mapInPandas(widen, "path string, width int, height int, data binary").withColumn("image_id", F.xxhash64("path")).select("image_id", "path", "width", "height", "data")


def dimensions(spark: SparkSession, path: str) -> DataFrame:
    """Sizes only; the pixels are not carried."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))


def parse_tiff(data: bytes) -> dict:
    """The fields of the first directory of a TIFF or DNG file, and its first strips; ValueError if it is none."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at = struct.unpack_from(order + "I", data, 4)[0]
    fields = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        letters = TYPES.get(kind)
        if letters is None:
            continue
        size = struct.calcsize("<" + letters) * count
        place = at + 10 + 12 * k
        if size > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        if letters == "s":
            fields[tag] = data[place : place + count].split(b"\0")[0].decode("latin-1")
        else:
            values = struct.unpack_from(f"{order}{len(letters) * count}{letters[0]}", data, place)
            fields[tag] = tuple(a / b if b else 0.0 for a, b in zip(values[::2], values[1::2], strict=True)) if len(letters) == 2 else values
    out = {name: fields.get(tag) for name, tag in TAGS.items()}
    out["order"] = order
    return out


def strips(data: bytes, fields: dict) -> np.ndarray:
    """The 16-bit samples of uncompressed strips."""
    if (fields["compression"] or (1,))[0] != 1 or (fields["bits"] or (0,))[0] != 16:
        raise ValueError("only uncompressed 16-bit samples are read")
    raw = b"".join(data[a : a + n] for a, n in zip(fields["strips"], fields["counts"], strict=True))
    return np.frombuffer(raw, dtype=fields["order"] + "u2").astype(np.uint16)


def camera_matrix(matrix: tuple[float, ...] | None) -> list[list[float]]:
    """Camera colours to sRGB, rows of four, from nine numbers that take XYZ to the camera; the identity without them.

    A camera row is scaled so that white stays white.
    """
    if not matrix or len(matrix) != 9:
        return [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]]
    camera = np.array(matrix, dtype=np.float64).reshape(3, 3) @ np.array(RGB_TO_XYZ)
    total = camera.sum(axis=1, keepdims=True)
    if (np.abs(total) < 1e-9).any() or abs(np.linalg.det(camera)) < 1e-9:
        return camera_matrix(None)
    return [[*row, 0.0] for row in np.linalg.inv(camera / total).tolist()]


def parse_dng(data: bytes, pixels: bool = True) -> dict:
    """A sensor plane: width, height, black, gains, matrix, filters, make, model, data (null without ``pixels``)."""
    f = parse_tiff(data)
    w, h = f["width"][0], f["height"][0]
    plane = strips(data, f)[: w * h].reshape(h, w) if pixels else None
    cells = (f["pattern"] or (0, 1, 1, 2))[:4]
    word = 0
    for row in range(8):
        for col in range(2):
            word |= cells[2 * (row % 2) + col] << (2 * (2 * row + col))
    neutral = f["neutral"] or (1.0, 1.0, 1.0)
    gains = [1.0 / (x or 1.0) for x in neutral] + [0.0]
    gains[3] = gains[3] if gains[3] > 0 else gains[1]
    return {"width": w, "height": h, "black": int((f["black"] or (0,))[0]), "gains": gains, "matrix": camera_matrix(f["matrix"]), "filters": word, "make": f["make"] or "", "model": f["model"] or "", "preview": None, "data": raster.pack(plane) if pixels else None}


def read_raw(spark: SparkSession, path: str, pixels: bool = True) -> DataFrame:
    """Sensor planes of all files under a path that can be parsed; others come with null data. Without ``pixels`` the samples are not unpacked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{dng,DNG}").load(path).select("path", "content")

    def parse(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    rows.append({"path": p} | parse_dng(content, pixels))
                except (ValueError, struct.error, TypeError, IndexError):
                    rows.append({"path": p})
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PLANE.split(", ")][1:])
            out.insert(0, "image_id", 0)
            yield out.astype(object).where(out.notna(), None)

    return files.mapInPandas(parse, PLANE).withColumn("image_id", F.xxhash64("path"))


def metadata(planes: DataFrame) -> DataFrame:
    """What is known of each plane but its pixels."""
    return planes.drop("data", "preview")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The same from files, without unpacking a sample."""
    return metadata(read_raw(spark, path, pixels=False))


def detect_images(spark: SparkSession, path: str) -> DataFrame:
    """path, kind (raw or standard), width, height of every image under a path; null sizes for raw files that cannot be parsed."""
    raw = read_metadata(spark, path).select("path", F.lit("raw").alias("kind"), "width", "height")
    return raw.unionByName(dimensions(spark, path).where(~extension(F.col("path")).isin(*RAW)).select("path", F.lit("standard").alias("kind"), "width", "height"))


def previews(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, data: 8-bit RGB of every image under a path, standard ones as they are, raw ones developed."""
    from tessera.operators import rasters

    planes = read_raw(spark, path)
    raw = rasters.develop(planes).join(planes.select("image_id", "path"), "image_id").select("path", "width", "height", "data")
    both = read_images(spark, path).where(~extension(F.col("path")).isin(*RAW)).select("path", "width", "height", "data").unionByName(raw)

    def narrow(batches):
        for pdf in batches:
            pdf["data"] = [(np.frombuffer(x, "<u2") >> 8).astype(np.uint8).tobytes() for x in pdf.data]
            yield pdf

    return both.mapInPandas(narrow, "path string, width int, height int, data binary")


def _directory(entries: list[tuple[int, int, tuple]], data: bytes) -> bytes:
    """A little-endian file of one directory; the strip follows its values."""
    head = 8 + 2 + 12 * len(entries) + 4
    extra, table = b"", b""
    size = {"B": 1, "H": 2, "I": 4}
    far = sum(n for kind, n in ((k, len(struct.pack(f"<{len(v)}{TYPES[k]}", *v))) for _, k, v in entries) if n > 4)
    for tag, kind, values in sorted(entries):
        if tag == TAGS["strips"]:
            values = (head + far,)
        raw = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        if len(raw) > 4:
            table += struct.pack("<HHII", tag, kind, len(values), head + len(extra))
            extra += raw
        else:
            table += struct.pack("<HHI", tag, kind, len(raw) // size[TYPES[kind]]) + raw.ljust(4, b"\0")
    return struct.pack("<2sHIH", b"II", 42, 8, len(entries)) + table + struct.pack("<I", 0) + extra + data


def tiff16(rgb: np.ndarray) -> bytes:
    """An uncompressed little-endian 16-bit RGB TIFF with one strip."""
    h, w = rgb.shape[:2]
    data = raster.pack(rgb)
    t = TAGS
    return _directory([(t["width"], 4, (w,)), (t["height"], 4, (h,)), (t["bits"], 3, (16, 16, 16)), (t["compression"], 3, (1,)), (t["photometric"], 3, (RGB,)), (t["strips"], 4, (0,)), (t["samples"], 3, (3,)), (t["rows"], 4, (h,)), (t["counts"], 4, (len(data),)), (t["planar"], 3, (1,))], data)


def dng(plane: np.ndarray, pattern: tuple[int, ...] = (0, 1, 1, 2), black: int = 0) -> bytes:
    """A minimal raw file of one sensor plane."""
    h, w = plane.shape
    data = raster.pack(plane)
    t = TAGS
    return _directory([(t["width"], 4, (w,)), (t["height"], 4, (h,)), (t["bits"], 3, (16,)), (t["compression"], 3, (1,)), (t["photometric"], 3, (CFA,)), (t["strips"], 4, (0,)), (t["samples"], 3, (1,)), (t["rows"], 4, (h,)), (t["counts"], 4, (len(data),)), (t["pattern_size"], 3, (2, 2)), (t["pattern"], 1, pattern), (t["version"], 1, (1, 4, 0, 0)), (t["black"], 4, (black,))], data)


def read_tiff16(data: bytes) -> np.ndarray:
    f = parse_tiff(data)
    return strips(data, f).reshape(f["height"][0], f["width"][0], 3)


def png(rgb8: np.ndarray) -> bytes:
    """An 8-bit RGB PNG."""
    h, w = rgb8.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb8, np.uint8).reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_jpeg(spark: SparkSession, rgb8: np.ndarray, path: str, quality: int = 95) -> None:
    """Encode one image with the JVM's writer."""
    jvm = spark._jvm
    h, w = rgb8.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    source = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(png(rgb8)))
    image.getGraphics().drawImage(source, 0, 0, None)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(float(quality) / 100)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    try:
        writer.setOutput(stream)
        writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    finally:
        writer.dispose()
        stream.close()
    store(spark, bytes(out.toByteArray()), path)


def store(spark: SparkSession, data: bytes, path: str) -> None:
    """Write one file to whatever store its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()


def write_output(spark: SparkSession, rgb: np.ndarray, path: str, quality: int = 95) -> None:
    """By extension: 16-bit TIFF, 8-bit JPEG or PNG; ValueError for any other."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("tif", "tiff"):
        store(spark, tiff16(rgb), path)
    elif kind in ("jpg", "jpeg"):
        write_jpeg(spark, (rgb >> 8).astype(np.uint8), path, quality)
    elif kind == "png":
        store(spark, png((rgb >> 8).astype(np.uint8)), path)
    else:
        raise ValueError(f"no writer for .{kind}")
