"""Blobs, JSON forms, the scheduler and the registered functions."""

import numpy as np
from pyspark.sql import functions as F
from test_kernels import scene

from tessera.functions import features, raster, register
from tessera.operators import catalog
from tessera.plans.scheduler import Scheduler
from tessera.sources import blobs


def test_frames():
    a = scene(4, 6)
    assert (blobs.unframe_pixels(blobs.frame_pixels(a)) == a).all()
    assert blobs.unframe_pixels(blobs.frame_pixels(a)[:-1]) is None and blobs.unframe_pixels(b"") is None
    p, d = np.array([[1, 2], [3, 4]]), np.arange(8, dtype=np.uint64).reshape(2, 4)
    q, e = blobs.unframe_features(blobs.frame_features(p, d))
    assert (q == p).all() and (e == d).all() and blobs.unframe_features(b"\1\0\0\0") is None


def test_store(spark, tmp_path):
    store = blobs.BlobStore(spark, str(tmp_path / "blobs"), per_file=2)
    assert store.read(1) is None
    made = spark.createDataFrame([(k, "px", bytes([k])) for k in range(5)], "k long, format_tag string, data binary")
    ids = {r.k: r.blob_id for r in store.append(made, "k").collect()}
    assert sorted(ids.values()) == [1, 2, 3, 4, 5] and store.read(ids[3]) == bytes([3])
    more = {r.k: r.blob_id for r in store.append(made.where("k = 2"), "k").collect()}
    assert store.read(6) == bytes([2]) and store.all().count() == 6 and more


def test_json(spark):
    df = spark.createDataFrame([(1, 2, [0.5, 1.0, -2.0, 3.0])], "x int, y int, o array<double>")
    text = df.select(blobs.offsets_to_json(F.col("x"), F.col("y"), F.col("o")).alias("t"))
    assert text.select(blobs.offsets_from_json(F.col("t")).alias("s")).first().s.offsets == [0.5, 1.0, -2.0, 3.0]
    bad = spark.createDataFrame([('{"tilesX":1,"tilesY":2,"offsets":[1]}',), ("nothing",)], "t string")
    assert all(r.s is None for r in bad.select(blobs.offsets_from_json(F.col("t")).alias("s")).collect())
    saved = df.select(blobs.checkpoint_to_json(F.lit(5), F.lit(1e-3), F.col("o")).alias("t"))
    assert saved.select(blobs.checkpoint_from_json(F.col("t")).alias("s")).first().s.iteration == 5
    assert saved.select(blobs.checkpoint_from_json(F.col("t"), 2).alias("s")).first().s is None


def tasks(spark, n=5):
    rows = [(k, "ALIGN", "image", str(k), ("RUNNING", "PENDING", "COMPLETED", "FAILED", "PENDING")[k], 0, None, None, None) for k in range(n)]
    return spark.createDataFrame(rows, catalog.TASKS)


def test_scheduler(spark):
    calls: list[int] = []

    def flaky(t):
        calls.append(t["task_id"])
        if t["task_id"] == 1 and calls.count(1) < 3:
            raise RuntimeError("again")
        return t["task_id"] + 100

    told = []
    after, ok = Scheduler(spark).run_stage(tasks(spark), "ALIGN", flaky, lambda *x: told.append(x))
    rows = {r.task_id: r for r in after.collect()}
    assert ok and all(r.status == "COMPLETED" for r in rows.values()) and rows[1].attempt_count == 3 and rows[0].output_blob_id == 100
    assert calls.count(2) == 0 and told[-1] == (5, 5)
    assert rows[0].updated_at > 1_700_000_000 and rows[2].updated_at is None

    def broken(t):
        raise RuntimeError("no")

    after, ok = Scheduler(spark).run_stage(tasks(spark), "ALIGN", broken)
    assert not ok and {r.status for r in after.collect()} == {"FAILED", "COMPLETED"}
    stopped = Scheduler(spark, in_flight=1)

    def one(t):
        stopped.cancel()
        return 1

    after, ok = stopped.run_stage(tasks(spark), "ALIGN", one)
    assert not ok and sum(r.status == "COMPLETED" for r in after.collect()) == 2


def test_registered_functions(spark):
    register.register(spark)
    assert spark.sql("select hamming256(array(1L, 0L, 0L, 3L), array(0L, 0L, 0L, 0L)) h").first().h == 3
    assert spark.sql("select warp_xy(array(1D, 0D, 3D, 0D, 1D, -2D, 0D, 0D, 1D), 1D, 1D) p").first().p.asDict() == {"x": 4.0, "y": -1.0}
    assert spark.sql("select sigma_median(array(1D, 2D, 3D, 2D, 2D, 3D, 900D)) m, sigma_median(array(4D, 1D)) n").first() == (2.0, 4.0)
    lab = spark.sql("select rgb_to_lab(12000D, 30000D, 50000D) v").first().v
    assert np.allclose(list(lab), raster.to_lab(np.array([[[12000, 30000, 50000]]]))[0, 0])
    a = np.full((32, 32, 3), 32768, np.uint16)
    a[8:16, 8:16] = 65535
    df = spark.createDataFrame([(32, 32, raster.pack(a))], "w int, h int, data binary")
    df.createOrReplaceTempView("one_raster")
    got = spark.sql("select c.x, c.y from one_raster, lateral fast_corners(w, h, data) c").collect()
    assert {(r.x, r.y) for r in got} == {tuple(c) for c in features.fast_corners(raster.gray8((a >> 8).astype(np.uint8))).tolist()}
