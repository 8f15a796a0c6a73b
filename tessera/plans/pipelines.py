"""The two families end to end: panorama (ingest, align, optimize, render) and burst (align, merge).

Every stage's output is a Parquet snapshot in the work folder; a stage whose snapshot is complete is not
run again, so a job that stopped goes on where it was. Progress callbacks get (stage, done, stages).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import raster, solve
from tessera.operators import geometry, match, rasters


class Snapshots:
    """Stage outputs under one folder; complete once Spark's commit has left its mark."""

    def __init__(self, spark: SparkSession, folder: str, progress: Callable[[str, int, int], None] | None = None, stages: int = 1):
        self.spark, self.folder, self.progress, self.stages, self.done = spark, folder.rstrip("/"), progress, stages, 0
        self.ran: list[str] = []

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self._there(name):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
            self.ran.append(name)
        self.done += 1
        if self.progress:
            self.progress(name, self.done, self.stages)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def save(self, name: str, state: dict) -> None:
        """Keep the state of a stage that goes on, under its iteration; a later one counts."""
        row = self.spark.createDataFrame([(state["iteration"], json.dumps(state))], "iteration int, state string")
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}-states")

    def saved(self, name: str) -> dict | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}-states/_SUCCESS")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return json.loads(self.spark.read.parquet(f"{self.folder}/{name}-states").agg(F.max_by("state", "iteration")).first()[0])


def chained(ids: list[int], maps: dict[tuple[int, int], np.ndarray]) -> dict[int, np.ndarray]:
    """image -> map to the world of the first image, by way of the pair maps, those given first preferred; the identity for images that no chain reaches."""
    near: dict[int, list[tuple[int, np.ndarray]]] = {k: [] for k in ids}
    for (a, b), h in maps.items():
        near[b].append((a, h.reshape(3, 3)))
        near[a].append((b, np.linalg.inv(h.reshape(3, 3))))
    world = {ids[0]: np.eye(3)}
    queue = [ids[0]]
    for k in queue:
        for other, h in near[k]:
            if other not in world:
                world[other] = world[k] @ h
                queue.append(other)
    return {k: world.get(k, np.eye(3)) for k in ids}


def adjust(pairs: DataFrame, ids: list[int], start: dict[int, np.ndarray], state: dict | None = None, save: Callable[[dict], None] | None = None, most: int = 100, every: int = 5) -> dict[int, np.ndarray]:
    """Levenberg-Marquardt over one map per image, the first fixed: image -> homography.

    pairs: a, b, points (xa, ya, xb, yb of each match). The points stay on the executors: in an iteration
    each pair gives its squared residual and its part of the normal equations, blocks of one pair of images
    are summed, and the driver, which has eight numbers an image, solves for the step. ``save`` gets the
    state every few iterations; a saved state is taken up again.
    """
    spark = pairs.sparkSession
    place = {k: i - 1 for i, k in enumerate(ids)}
    n = 8 * (len(ids) - 1)
    p = np.concatenate([np.zeros(0), *[(start[k] / start[k][2, 2]).ravel()[:8] for k in ids[1:]]])
    state = dict(state) if state and len(state["parameters"]) == n else {"iteration": 0, "lambda": 1e-3, "parameters": p.tolist(), "converged": False}

    def equations(parameters: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        known = spark.sparkContext.broadcast(np.concatenate([np.eye(3).ravel()[:8], parameters]).reshape(-1, 8))

        def run(batches):
            for pdf in batches:
                rows = []
                for r in pdf.itertuples():
                    points = np.array([(q["xa"], q["ya"], q["xb"], q["yb"]) for q in r.points], dtype=np.float64).reshape(-1, 4)
                    cost, a, g = solve.pair_equations(known.value[place[r.a] + 1], known.value[place[r.b] + 1], points)
                    rows.append((r.a, r.b, cost, a.ravel().tolist(), g.tolist()))
                yield pd.DataFrame(rows, columns=["a", "b", "cost", "normal", "gradient"])

        matrix, gradient, total = np.zeros((n, n)), np.zeros(n), 0.0
        for r in pairs.mapInPandas(run, "a long, b long, cost double, normal array<double>, gradient array<double>").toLocalIterator():
            total += r.cost
            block, g = np.array(r.normal).reshape(2, 8, 2, 8), np.array(r.gradient).reshape(2, 8)
            at = [(side, slice(8 * place[k], 8 * place[k] + 8)) for side, k in ((0, r.a), (1, r.b)) if place[k] >= 0]
            for s, rows in at:
                gradient[rows] += g[s]
                for t, columns in at:
                    matrix[rows, columns] += block[s, :, t, :]
        known.unpersist()
        return total, matrix, gradient

    if n and not state["converged"]:
        before, matrix, gradient = equations(np.array(state["parameters"]))
        while not state["converged"] and state["iteration"] < most:
            p = np.array(state["parameters"])
            step = solve.damped_solve(matrix, gradient, state["lambda"])
            trial = None if step is None else equations(p + step)
            state["iteration"] += 1
            if trial is not None and trial[0] < before:
                state |= {"parameters": (p + step).tolist(), "lambda": state["lambda"] / 10, "converged": before - trial[0] < 1e-4}
                before, matrix, gradient = trial
            else:
                state["lambda"] *= 10
                state["converged"] = before < 1e-12 or state["lambda"] > 1e12
            if save and (state["iteration"] % every == 0 or state["converged"]):
                save(state)
    found = np.concatenate([np.eye(3).ravel()[:8], state["parameters"]]).reshape(-1, 8)
    return {k: np.append(h, 1.0) for k, h in zip(ids, found, strict=True)}


def panorama(spark: SparkSession, images: DataFrame, folder: str, chunk: int = 1024, canvas: tuple[int, int] | None = None, seed: int = 42, progress=None, use_inliers: bool = True) -> tuple[DataFrame, DataFrame]:
    """Stitch rasters: the rendered chunks and the chunk grid.

    The first image (least id) gives the world, the gain and the colour. Pairs of images are matched and
    their maps found; gains come from matches with the first image, colours from Lab statistics, places
    from the bundle adjustment, whose state is kept every five iterations. An image that no pair links
    starts where the first one is. A chunk that should have been rendered and was not is an error.
    """
    snap = Snapshots(spark, folder, progress, 9)
    ingested = snap.stage("ingest", lambda: images)
    found = snap.stage("features", lambda: rasters.detect(ingested))
    pairs = match.seed_pairs(ingested.select("image_id"), "image_id")
    matched = snap.stage("matches", lambda: rasters.match_pairs(found, pairs))
    maps = snap.stage("maps", lambda: rasters.pair_homographies(matched, seed=seed)).where("success and inliers >= 12")
    reference = ingested.agg(F.min("image_id")).first()[0]
    gains = snap.stage("gains", lambda: rasters.gains(ingested, matched.join(maps.select("a", "b"), ["a", "b"]), reference))
    colored = snap.stage("color", lambda: rasters.color_transfer(ingested, reference))

    def inliers() -> DataFrame:
        """The matches of each linked pair, in a row; no more than a matcher keeps."""
        h = [F.col("homography")[k] for k in range(9)]
        near = geometry.reprojection_error(h, F.col("xa").cast("double"), F.col("ya").cast("double"), F.col("xb").cast("double"), F.col("yb").cast("double")) < 3.0
        rows = matched.join(maps.select("a", "b", "homography"), ["a", "b"], "inner" if use_inliers else "left")
        return (rows.where(near) if use_inliers else rows).groupBy("a", "b").agg(F.collect_list(F.struct("xa", "ya", "xb", "yb")).alias("points"))

    linked = snap.stage("inliers", inliers)

    def optimize() -> DataFrame:
        ids = [r.image_id for r in ingested.select("image_id").orderBy("image_id").collect()]  # an input file each
        good = {(r.a, r.b): np.array(r.homography) for r in maps.orderBy(F.desc("inliers"), "a", "b").collect()}
        placed = adjust(linked, ids, chained(ids, good), snap.saved("adjustment"), lambda state: snap.save("adjustment", state))
        return spark.createDataFrame([(k, h.tolist()) for k, h in placed.items()], "image_id long, homography array<double>")

    placed = snap.stage("placements", optimize)
    size = ingested.agg(F.max("width"), F.max("height"), F.count(F.lit(1))).first()
    width, height = canvas or (size[0] * size[2], size[1] * size[2])
    grid = geometry.chunk_grid(spark, width, height, chunk)
    h = [F.col("homography")[k] for k in range(9)]
    x0, y0, x1, y1 = geometry.corner_box(h, F.col("width").cast("double"), F.col("height").cast("double"))
    boxes = placed.join(ingested.select("image_id", "width", "height"), "image_id").select("image_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    met = geometry.overlap(boxes, grid, chunk).select("id", "image_id")
    rendered = snap.stage("render", lambda: rasters.render(colored, placed, grid, met, image_gains=gains))
    missing = met.select("id").distinct().join(rendered.select("id"), "id", "left_anti")
    if not missing.isEmpty():
        raise RuntimeError(f"chunks not rendered: {[r.id for r in missing.limit(10).collect()]}")
    return rendered, grid


def burst(spark: SparkSession, frames: DataFrame, folder: str, mode: str, progress=None) -> DataFrame:
    """Align and merge bursts (burst_id, image_id, width, height, data)."""
    snap = Snapshots(spark, folder, progress, 3)
    ingested = snap.stage("ingest", lambda: frames)
    aligned = snap.stage("align", lambda: rasters.align_burst(ingested, subpixel=mode in ("superres", "nightsight")))
    return snap.stage(f"merge-{mode}", lambda: rasters.merge_burst(ingested, aligned, mode))


def one_raster(df: DataFrame) -> np.ndarray:
    r = df.select("width", "height", "data").first()
    return raster.unpack(bytes(r.data), r.width, r.height)
