"""Raster operators on DataFrames: kernels over Arrow batches, one raster, pair, chunk or burst at a time.

The raster layout is image_id, width, height, data. Whatever is relational (which images meet which
chunk, which pairs there are) is a join; a kernel sees only the rows of its own unit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import blend as blending
from tessera.functions import burst, features, raster, solve
from tessera.operators import color

RASTER = "image_id long, width int, height int, data binary"
FEATURES = "image_id long, point int, x float, y float, d0 long, d1 long, d2 long, d3 long"


def _rgb(row) -> np.ndarray:
    return raster.unpack(bytes(row.data), int(row.width), int(row.height))


def develop(planes: DataFrame) -> DataFrame:
    """Sensor planes (image_id, width, height, black, gains, matrix, filters, data) to RGB rasters."""

    def run(batches):
        for pdf in batches:
            out = [raster.pack(raster.demosaic(raster.unpack(bytes(r.data), r.width, r.height, 1), r.black, list(r.gains), [list(m) for m in r.matrix], int(r.filters))) for r in pdf.itertuples()]
            yield pd.DataFrame({"image_id": pdf.image_id, "width": pdf.width, "height": pdf.height, "data": out})

    return planes.select("image_id", "width", "height", "black", "gains", "matrix", "filters", "data").where("data is not null").mapInPandas(run, RASTER)


def tiled(rasters: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """Rasters cut into tiles with a border from their neighbours: tile_x, tile_y, x0, y0, width, height, left, top, data."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a = _rgb(r)
                rows = []
                for y in range(0, r.height, size):
                    for x in range(0, r.width, size):
                        top, left = max(0, y - halo), max(0, x - halo)
                        part = a[top : min(r.height, y + size + halo), left : min(r.width, x + size + halo)]
                        rows.append((r.image_id, x // size, y // size, x, y, part.shape[1], part.shape[0], x - left, y - top, raster.pack(part)))
                yield pd.DataFrame(rows, columns=["image_id", "tile_x", "tile_y", "x0", "y0", "width", "height", "left", "top", "data"])

    return rasters.mapInPandas(run, "image_id long, tile_x int, tile_y int, x0 int, y0 int, width int, height int, left int, top int, data binary")


def region(rasters: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The part of each raster within a rectangle, which is cut to the raster; rasters that it misses are left out."""
    return mapped(rasters, lambda a: a[max(0, y) : max(0, y + height), max(0, x) : max(0, x + width)])


def thumbnail(rasters: DataFrame, percent: int) -> DataFrame:
    """Each raster at half its size if ``percent`` is under 100: the mean of two by two pixels."""

    def half(a: np.ndarray) -> np.ndarray:
        h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
        b = a[:h, :w].astype(np.uint32)
        return ((b[::2, ::2] + b[1::2, ::2] + b[::2, 1::2] + b[1::2, 1::2]) // 4).astype(np.uint16)

    return mapped(rasters, half) if percent < 100 else rasters.select("image_id", "width", "height", "data")


#: Kernels by name, raster in and raster out (height x width x 3, uint16); ``plug_in`` adds more.
KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "painterly": blending.painterly,
    "tone": blending.tone,
    "blur": lambda a: raster.round_half(blending.blur(a.astype(np.float64))),
    "halve": lambda a: raster.round_half(blending.down(a.astype(np.float64))),
}


def plug_in(name: str, kernel: Callable[..., np.ndarray]) -> None:
    """Make a kernel known to ``apply_kernel``."""
    KERNELS[name] = kernel


def apply_kernel(rasters: DataFrame, name: str, **options) -> DataFrame:
    """Each raster through the kernel of that name; KeyError if there is none."""
    kernel = KERNELS[name]
    return mapped(rasters, lambda a: kernel(a, **options))


def mapped(rasters: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Each raster through a kernel; empty results are left out."""

    def run(batches):
        for pdf in batches:
            out = [(r.image_id, kernel(_rgb(r))) for r in pdf.itertuples()]
            rows = [(k, a.shape[1], a.shape[0], raster.pack(a)) for k, a in out if a.size]
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", "data"])

    return rasters.select("image_id", "width", "height", "data").mapInPandas(run, RASTER)


def pixels(rasters: DataFrame) -> DataFrame:
    """The long layout: image_id, y, x, r, g, b, for operators that are plain expressions."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a = _rgb(r).astype(np.int32)
                y, x = np.mgrid[0 : r.height, 0 : r.width].astype(np.int32)
                yield pd.DataFrame({"image_id": r.image_id, "y": y.ravel(), "x": x.ravel(), "r": a[..., 0].ravel(), "g": a[..., 1].ravel(), "b": a[..., 2].ravel()})

    return rasters.mapInPandas(run, "image_id long, y int, x int, r int, g int, b int")


def apply_gain(rasters: DataFrame, gains: DataFrame) -> DataFrame:
    """Each raster times its image's gain (image_id, gain)."""

    def run(batches):
        for pdf in batches:
            out = [raster.pack(raster.cut_off(_rgb(r).astype(np.float32) * np.float32(r.gain))) if abs(r.gain - 1) >= 1e-6 else bytes(r.data) for r in pdf.itertuples()]
            yield pd.DataFrame({"image_id": pdf.image_id, "width": pdf.width, "height": pdf.height, "data": out})

    return rasters.join(gains, "image_id", "left").withColumn("gain", F.coalesce("gain", F.lit(1.0))).mapInPandas(run, RASTER)


def gains(rasters: DataFrame, matches: DataFrame, reference: int) -> DataFrame:
    """image_id, gain of every image: the luma of the reference over its own at their matches; 1 for the reference and for images without a match.

    A row holds one pair's matches, of which there are no more than a matcher keeps, and both rasters.
    """
    other = F.when(F.col("a") == reference, F.col("b")).otherwise(F.col("a"))
    at = lambda first, second: F.when(F.col("a") == reference, F.col(first)).otherwise(F.col(second))
    points = matches.where((F.col("a") == reference) | (F.col("b") == reference)).select(other.alias("image_id"), *(at(x, y).cast("double").alias(n) for x, y, n in (("xa", "xb", "rx"), ("ya", "yb", "ry"), ("xb", "xa", "tx"), ("yb", "ya", "ty"))))
    packed = points.groupBy("image_id").agg(F.collect_list(F.struct("rx", "ry", "tx", "ty")).alias("at")).select("image_id", *(F.col("at")[c].alias(c) for c in ("rx", "ry", "tx", "ty")))
    own = rasters.select("image_id", "width", "height", "data")
    ref = own.where(F.col("image_id") == reference).select(F.col("width").alias("rw"), F.col("height").alias("rh"), F.col("data").alias("rdata"))
    both = packed.join(own, "image_id").crossJoin(ref)  # one row

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a, b = raster.unpack(bytes(r.rdata), int(r.rw), int(r.rh)), _rgb(r)
                yield pd.DataFrame({"image_id": r.image_id, "reference": raster.luma8(a, np.asarray(r.rx), np.asarray(r.ry)), "own": raster.luma8(b, np.asarray(r.tx), np.asarray(r.ty))})

    samples = both.mapInPandas(run, "image_id long, reference double, own double").where("not isnan(reference) and not isnan(own)")
    found = samples.groupBy("image_id").agg(color.gain_estimate(F.col("reference"), F.col("own")).alias("gain"))
    return rasters.select("image_id").join(found, "image_id", "left").select("image_id", F.coalesce("gain", F.lit(1.0)).alias("gain"))


def lab_stats(rasters: DataFrame) -> DataFrame:
    """image_id, mean and std: of the three Lab channels over all pixels of each raster."""

    def run(batches):
        for pdf in batches:
            lab = [raster.to_lab(_rgb(r)).reshape(-1, 3) for r in pdf.itertuples()]
            yield pd.DataFrame({"image_id": pdf.image_id, "mean": [x.mean(axis=0) for x in lab], "std": [x.std(axis=0) for x in lab]})

    return rasters.mapInPandas(run, "image_id long, mean array<double>, std array<double>")


def color_transfer(rasters: DataFrame, reference: int) -> DataFrame:
    """Each raster with the Lab means and deviations of the reference, which stays as it is."""
    stats = lab_stats(rasters)
    ref = stats.where(F.col("image_id") == reference).select(F.col("mean").alias("to_mean"), F.col("std").alias("to_std"))
    both = rasters.join(stats, "image_id").crossJoin(F.broadcast(ref))  # one row

    def run(batches):
        for pdf in batches:
            out = [bytes(r.data) if r.image_id == reference else raster.pack(raster.transfer(_rgb(r), (r.mean, r.std), (r.to_mean, r.to_std))) for r in pdf.itertuples()]
            yield pd.DataFrame({"image_id": pdf.image_id, "width": pdf.width, "height": pdf.height, "data": out})

    return both.mapInPandas(run, RASTER)


def detect(rasters: DataFrame, most: int = 2000) -> DataFrame:
    """Corners and descriptors of every raster, a row each."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                gray = raster.gray8((_rgb(r) >> 8).astype(np.uint8))
                p = features.fast_corners(gray, most=most)
                d = features.describe(gray, p).view(np.int64).reshape(-1, 4)
                yield pd.DataFrame({"image_id": r.image_id, "point": np.arange(len(p), dtype=np.int32), "x": p[:, 0].astype(np.float32), "y": p[:, 1].astype(np.float32)} | {f"d{k}": d[:, k] for k in range(4)})

    return rasters.mapInPandas(run, FEATURES)


def match_pairs(found: DataFrame, pairs: DataFrame, ratio: float = 0.75, most: int = 2000) -> DataFrame:
    """Matches for each pair (a, b) of images: a, b, xa, ya, xb, yb, distance. One pair's points meet in one task."""
    cols = ["point", "x", "y", "d0", "d1", "d2", "d3"]
    left = pairs.join(found.select(F.col("image_id").alias("a"), *cols), "a").withColumn("side", F.lit(0))
    right = pairs.join(found.select(F.col("image_id").alias("b"), *cols), "b").withColumn("side", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = (pdf[pdf.side == k].sort_values("point") for k in (0, 1))
        code = lambda f: f[["d0", "d1", "d2", "d3"]].to_numpy(np.int64).view(np.uint64)
        m = features.match(code(p), code(q), ratio, most)
        return pd.DataFrame(
            {"a": pdf.a.iloc[0], "b": pdf.b.iloc[0], "xa": p.x.to_numpy()[m[:, 0]], "ya": p.y.to_numpy()[m[:, 0]], "xb": q.x.to_numpy()[m[:, 1]], "yb": q.y.to_numpy()[m[:, 1]], "distance": m[:, 2].astype(np.int32)}
        )

    return left.select("a", "b", "side", *cols).unionByName(right.select("a", "b", "side", *cols)).groupBy("a", "b").applyInPandas(run, "a long, b long, xa float, ya float, xb float, yb float, distance int")


def pair_homographies(matches: DataFrame, iterations: int = 500, threshold: float = 3.0, seed: int = 42) -> DataFrame:
    """a, b, homography (a to b), inliers, success of each pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, n, ok = solve.ransac(pdf[["xa", "ya"]].to_numpy(), pdf[["xb", "yb"]].to_numpy(), iterations, threshold, seed)
        return pd.DataFrame({"a": [pdf.a.iloc[0]], "b": [pdf.b.iloc[0]], "homography": [h.tolist()], "inliers": [n], "success": [ok]})

    return matches.groupBy("a", "b").applyInPandas(run, "a long, b long, homography array<double>, inliers int, success boolean")


def render(rasters: DataFrame, placements: DataFrame, chunks: DataFrame, met: DataFrame, most: int = 32, image_gains: DataFrame | None = None) -> DataFrame:
    """Chunks of the canvas: id, width, height, data, contributors.

    placements: image_id, homography (local to world). met: id (chunk), image_id. Each image is warped
    into a chunk by the inverse map and multiplied by its gain (image_id, gain); the contributors of a chunk, the first ``most`` by image_id, are blended.
    """
    from pyspark.sql import Window

    first = met.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("image_id"))).where(F.col("_r") <= most).drop("_r")
    shape = chunks.select("id", "x_offset", "y_offset", F.col("width").alias("cw"), F.col("height").alias("ch"))
    joined = first.join(shape, "id").join(placements, "image_id").join(rasters, "image_id")
    joined = joined.withColumn("gain", F.lit(1.0)) if image_gains is None else joined.join(image_gains, "image_id", "left").withColumn("gain", F.coalesce("gain", F.lit(1.0)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("image_id")
        images = []
        w, h, x, y = (int(pdf[c].iloc[0]) for c in ("cw", "ch", "x_offset", "y_offset"))
        for r in pdf.itertuples():
            inverse = solve.invert(np.array(r.homography))
            if inverse is not None:
                image = raster.warp(_rgb(r), inverse, w, h, (x, y))
                if abs(r.gain - 1) >= 1e-6:
                    image = raster.cut_off(image.astype(np.float32) * np.float32(r.gain))
                if image.any():
                    images.append(image)
        out = blending.blend(images) if images else np.zeros((h, w, 3), np.uint16)
        return pd.DataFrame({"id": [pdf.id.iloc[0]], "width": [w], "height": [h], "data": [raster.pack(out)], "contributors": [len(images)]})

    return joined.groupBy("id").applyInPandas(run, "id string, width int, height int, data binary, contributors int")


def mosaic(rendered: DataFrame, chunks: DataFrame, most: int) -> np.ndarray:
    """All chunks on one preview of at most ``most`` pixels a side, nearest neighbours; the executors shrink them first."""
    size = chunks.agg(F.max(F.col("x_offset") + F.col("width")), F.max(F.col("y_offset") + F.col("height"))).first()
    scale = most / max(size)
    w, h = max(1, int(size[0] * scale)), max(1, int(size[1] * scale))

    def shrink(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                x0, y0 = int(r.x_offset * scale), int(r.y_offset * scale)
                cw, ch = max(1, int(r.width * scale)), max(1, int(r.height * scale))
                a = _rgb(r)
                y = np.minimum((np.arange(ch) / scale).astype(np.int64), r.height - 1)
                x = np.minimum((np.arange(cw) / scale).astype(np.int64), r.width - 1)
                rows.append((x0, y0, cw, ch, raster.pack(a[y][:, x])))
            yield pd.DataFrame(rows, columns=["x", "y", "width", "height", "data"])

    small = rendered.join(chunks.select("id", "x_offset", "y_offset"), "id").select("x_offset", "y_offset", "width", "height", "data").mapInPandas(shrink, "x int, y int, width int, height int, data binary")
    out = np.zeros((h, w, 3), dtype=np.uint16)
    for r in small.toLocalIterator():
        part = raster.unpack(bytes(r.data), r.width, r.height)[: max(0, h - r.y), : max(0, w - r.x)]
        out[r.y : r.y + part.shape[0], r.x : r.x + part.shape[1]] = part
    return out


def align_burst(frames: DataFrame, subpixel: bool = False) -> DataFrame:
    """Offset fields of every frame of a burst (burst_id, image_id, width, height, data) against its first.

    The reference joins each frame; frames of a burst align in parallel. Returns burst_id, image_id,
    tiles_x, tiles_y, offsets (dx, dy by row of tiles).
    """
    ref = frames.groupBy("burst_id").agg(F.min("image_id").alias("ref_id"))
    first = frames.select("burst_id", F.col("image_id").alias("ref_id"), F.col("data").alias("ref_data"), F.col("width").alias("rw"), F.col("height").alias("rh"))
    refs = first.join(ref, ["burst_id", "ref_id"])
    pairs = frames.join(refs, "burst_id").where("image_id != ref_id")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if (r.width, r.height) != (r.rw, r.rh):
                    raise ValueError(f"frame {r.image_id} is {r.width}x{r.height}, the reference {r.rw}x{r.rh}")
                a, b = raster.unpack(bytes(r.ref_data), r.rw, r.rh), _rgb(r)
                field = burst.block_match(a, b)
                if subpixel:
                    field = burst.refine(a, b, field)
                rows.append((r.burst_id, r.image_id, field.shape[1], field.shape[0], field.astype(float).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["burst_id", "image_id", "tiles_x", "tiles_y", "offsets"])

    return pairs.mapInPandas(run, "burst_id long, image_id long, tiles_x int, tiles_y int, offsets array<double>")


MODES = ("mfnr", "hdrplus", "superres", "nightsight")


def merge_burst(frames: DataFrame, aligned: DataFrame, mode: str, finish: bool = True) -> DataFrame:
    """Merge each burst: burst_id, width, height, data. A burst's frames meet in one task."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    joined = frames.join(aligned, ["burst_id", "image_id"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("image_id")
        images, fields = [], []
        for k, r in enumerate(pdf.itertuples()):
            images.append(_rgb(r))
            if k:
                if r.offsets is None or len(r.offsets) != 2 * r.tiles_x * r.tiles_y:
                    raise ValueError(f"frame {r.image_id} has no offsets")
                fields.append(np.array(r.offsets).reshape(int(r.tiles_y), int(r.tiles_x), 2))
        out = merged(images, fields, mode)
        if finish:
            out = finished(out, mode)
        return pd.DataFrame({"burst_id": [pdf.burst_id.iloc[0]], "width": [out.shape[1]], "height": [out.shape[0]], "data": [raster.pack(out)]})

    return joined.groupBy("burst_id").applyInPandas(run, "burst_id long, width int, height int, data binary")


def merged(images: list[np.ndarray], fields: list[np.ndarray], mode: str) -> np.ndarray:
    whole = lambda: [np.rint(f).astype(np.int64) for f in fields]
    if mode == "mfnr":
        return burst.robust_merge(images, whole())
    if mode == "hdrplus":
        return burst.fourier_merge(images, whole())
    if mode == "superres":
        return burst.kernel_regression(images, fields, scale=2)
    keep, variance = burst.meter_motion(fields)
    some = [k for k, ok in enumerate(keep) if ok]
    return burst.kernel_regression([images[0], *(images[k + 1] for k in some)], [fields[k] for k in some], scale=1, variance=variance)


def finished(a: np.ndarray, mode: str) -> np.ndarray:
    if mode == "hdrplus":
        return blending.fuse(blending.tone(a, 2.0), blending.tone(a, 0.5))
    return blending.painterly(a) if mode == "nightsight" else a
