"""Raster DataFrames end to end: files in and out, both pipelines, resume, streams, the catalog."""

import os
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_kernels import noisy, scene, shifted

from tessera import cli
from tessera.functions import blend, raster, solve
from tessera.operators import catalog, geometry, rasters
from tessera.plans import pipelines
from tessera.sources import datasource, raster_files
from tessera.streaming import bursts


def frame(spark, images, **more):
    rows = [(k, a.shape[1], a.shape[0], raster.pack(a)) for k, a in enumerate(images)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "width", "height", "data"]), rasters.RASTER)


def test_files(spark, tmp_path):
    a = scene(12, 17)
    assert (raster_files.read_tiff16(raster_files.tiff16(a)) == a).all()
    with pytest.raises(ValueError):
        raster_files.parse_tiff(b"nothing")
    eight = (a >> 8).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(raster_files.png(eight))
    (tmp_path / "in" / "broken.png").write_bytes(b"no image")
    got = raster_files.read_images(spark, str(tmp_path / "in")).collect()
    assert len(got) == 1 and (raster.unpack(bytes(got[0].data), 17, 12) == eight.astype(np.uint16) * 257).all()
    assert [(r.width, r.height) for r in raster_files.dimensions(spark, str(tmp_path / "in")).collect()] == [(17, 12)]
    raster_files.write_output(spark, a, str(tmp_path / "x.jpg"), 95)
    back = raster_files.read_images(spark, str(tmp_path / "x.jpg")).first()
    assert (back.width, back.height) == (17, 12)
    with pytest.raises(ValueError):
        raster_files.write_output(spark, a, str(tmp_path / "x.bmp"))


def test_raw_files(spark, tmp_path):
    plane = scene(10, 14)[..., 0]
    (tmp_path / "a.dng").write_bytes(raster_files.dng(plane, black=64))
    (tmp_path / "b.dng").write_bytes(b"broken")
    rows = {os.path.basename(r.path): r for r in raster_files.read_raw(spark, str(tmp_path)).collect()}
    assert rows["b.dng"].data is None and rows["a.dng"].black == 64 and rows["a.dng"].filters == 0x94949494
    developed = rasters.develop(raster_files.read_raw(spark, str(tmp_path))).collect()
    want = raster.demosaic(plane, 64, [1, 1, 1, 1], np.eye(3, 4), 0x94949494)
    assert len(developed) == 1 and (raster.unpack(bytes(developed[0].data), 14, 10) == want).all()
    assert "data" not in raster_files.metadata(raster_files.read_raw(spark, str(tmp_path))).columns
    datasource.register(spark)
    os.remove(tmp_path / "b.dng")
    read = spark.read.format("rawimage").option("path", str(tmp_path)).load().collect()
    assert len(read) == 1 and (raster.unpack(bytes(read[0].data), 14, 10, 1) == plane).all()
    images = [scene(6, 5, k) for k in range(3)]
    frame(spark, images).write.format("tiff16").mode("append").option("path", str(tmp_path / "out")).save()
    assert sorted(os.listdir(tmp_path / "out")) == ["0.tif", "1.tif", "2.tif"]
    assert (raster_files.read_tiff16((tmp_path / "out" / "1.tif").read_bytes()) == images[1]).all()


def test_layouts(spark):
    a = scene(20, 33)
    df = frame(spark, [a])
    tiles = rasters.tiled(df, 16, halo=2).collect()
    assert len(tiles) == 6
    for t in tiles:
        part = raster.unpack(bytes(t.data), t.width, t.height)
        assert (part[t.top, t.left] == a[t.y0, t.x0]).all()
    assert rasters.pixels(df).count() == 20 * 33
    gained = rasters.apply_gain(df, spark.createDataFrame([(0, 1.5)], "image_id long, gain double")).first()
    assert (raster.unpack(bytes(gained.data), 33, 20) == raster.cut_off(a.astype(np.float32) * np.float32(1.5))).all()


def test_parts_and_kernels(spark):
    a = scene(20, 33)
    df = frame(spark, [a])
    one = lambda out: (lambda r: raster.unpack(bytes(r.data), r.width, r.height))(out.first())
    assert (one(rasters.region(df, 5, -3, 100, 10)) == a[:7, 5:]).all() and rasters.region(df, 40, 0, 5, 5).count() == 0
    assert one(rasters.thumbnail(df, 50)).shape == (10, 16, 3) and (one(rasters.thumbnail(df, 100)) == a).all()
    rasters.plug_in("negative", lambda v, top=65535: (top - v).astype(np.uint16))
    assert (one(rasters.apply_kernel(df, "negative")) == 65535 - a).all() and (one(rasters.apply_kernel(df, "tone", gamma=1.0)) == a).all()
    with pytest.raises(KeyError):
        rasters.apply_kernel(df, "none such")


def test_detect_and_previews(spark, tmp_path):
    a = scene(12, 16)
    (tmp_path / "a.png").write_bytes(raster_files.png((a >> 8).astype(np.uint8)))
    (tmp_path / "b.dng").write_bytes(raster_files.dng(a[..., 0]))
    got = {r.path.rsplit("/", 1)[-1]: (r.kind, r.width, r.height) for r in raster_files.detect_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("standard", 16, 12), "b.dng": ("raw", 16, 12)}
    shown = {r.path.rsplit("/", 1)[-1]: len(r.data) for r in raster_files.previews(spark, str(tmp_path)).collect()}
    assert shown == {"a.png": 16 * 12 * 3, "b.dng": 16 * 12 * 3}
    m = np.array(raster_files.camera_matrix((0.9, 0.1, 0.0, 0.05, 0.8, 0.1, 0.0, 0.1, 0.7)))
    assert np.allclose(m[:, :3].sum(axis=1), 1) and raster_files.camera_matrix(None)[0] == [1.0, 0, 0, 0]


def speckled(h, w, seed=4):
    """A scene with corners: rectangles of all sizes on a slope."""
    rng = np.random.default_rng(seed)
    a = np.zeros((h, w, 3))
    a += np.linspace(9000, 26000, w)[None, :, None]
    for _ in range(420):
        y, x = rng.integers(0, h - 4), rng.integers(0, w - 4)
        a[y : y + rng.integers(3, 16), x : x + rng.integers(3, 16)] = rng.uniform(3000, 62000, 3)
    return np.clip(a, 300, 65535).astype(np.uint16)


STAGES = ["ingest", "features", "matches", "maps", "gains", "color", "inliers", "placements", "render"]


def test_panorama(spark, tmp_path):
    """Three images of unequal gain come together, and a fourth that nothing links stays in the job."""
    master = speckled(200, 420)
    at, gain = [0, 110, 220], [1.0, 0.7, 0.85]
    alone = np.full((60, 60, 3), 700, np.uint16)
    images = frame(spark, [*(raster.cut_off(master[:, x : x + 200] * g) for x, g in zip(at, gain, strict=True)), alone])
    told = []
    job = str(tmp_path / "job")
    rendered, grid = pipelines.panorama(spark, images, job, chunk=150, canvas=(420, 200), progress=lambda *a: told.append(a))
    assert [t[0] for t in told] == STAGES
    placed = {r.image_id: r.homography for r in spark.read.parquet(f"{job}/placements").collect()}
    for k, x in enumerate(at):
        assert abs(placed[k][2] - x) < 1 and abs(placed[k][5]) < 1
    assert placed[3] == np.eye(3).ravel().tolist()
    found = {r.image_id: r.gain for r in spark.read.parquet(f"{job}/gains").collect()}
    assert found[0] == 1 and found[3] == 1 and abs(found[1] - 1 / 0.7) < 0.1
    mean = {r.image_id: r["mean"][0] for r in rasters.lab_stats(spark.read.parquet(f"{job}/color")).collect()}
    assert all(abs(mean[k] - mean[0]) < 1 for k in range(3))
    assert rendered.count() == grid.count()
    out = rasters.mosaic(rendered, grid, 420)
    assert out.shape == (200, 420, 3)
    # a second run takes all from the snapshots, and a stage that was lost goes on from its saved state
    before = os.path.getmtime(tmp_path / "job" / "render")
    pipelines.panorama(spark, images, job, chunk=150, canvas=(420, 200))
    assert os.path.getmtime(tmp_path / "job" / "render") == before
    assert pipelines.Snapshots(spark, job).saved("adjustment")["converged"]
    shutil.rmtree(tmp_path / "job" / "placements")
    pipelines.panorama(spark, images, job, chunk=150, canvas=(420, 200))
    again = {r.image_id: r.homography for r in spark.read.parquet(f"{job}/placements").collect()}
    assert np.allclose(again[1], placed[1]) and np.allclose(again[2], placed[2])


def test_panorama_comes_near_its_scene(spark, tmp_path):
    master = speckled(200, 420)
    images = frame(spark, [master[:, x : x + 200] for x in (0, 110, 220)])
    rendered, grid = pipelines.panorama(spark, images, str(tmp_path / "job"), chunk=150, canvas=(420, 200))
    inner = (slice(4, -4), slice(4, -4))
    assert raster.psnr(rasters.mosaic(rendered, grid, 420)[inner], master[inner]) > 15


def test_adjustment_on_executors_equals_the_dense_one(spark):
    rng = np.random.default_rng(3)
    rows, start = [], {0: np.eye(3), 1: np.eye(3), 2: np.eye(3)}
    for a, b in ((0, 1), (1, 2), (0, 2)):
        p = rng.uniform(0, 100, (30, 2))
        rows += [(a, b, *q, *(q + np.array([7.0 * (a - b), 3.0]) + rng.normal(size=2) * 0.2)) for q in p]
    pairs = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, xa double, ya double, xb double, yb double")
    packed = pairs.groupBy(pairs.a.cast("long").alias("a"), pairs.b.cast("long").alias("b")).agg(F.collect_list(F.struct("xa", "ya", "xb", "yb")).alias("points"))
    kept = []
    got = pipelines.adjust(packed, [0, 1, 2], start, save=kept.append)
    want = solve.BundleAdjustment([0, 1, 2], np.array(rows)).run()
    for k in range(3):
        corners = np.array([(0.0, 0.0), (100, 0), (0, 100), (100, 100)])
        assert np.allclose(solve.project(got[k], corners), solve.project(want[k], corners), atol=0.1)
    assert kept and np.allclose(pipelines.adjust(packed, [0, 1, 2], start, kept[-1])[2], got[2])


def test_lab_kernels_are_inverse():
    a = scene(12, 12)
    assert np.abs(raster.from_lab(raster.to_lab(a)).astype(int) - a).max() <= 1
    lab = raster.to_lab(raster.transfer(a, ((50, 0, 0), (0.0, 1, 1)), ((50, 0, 0), (1, 1, 1))))
    assert np.abs(lab - raster.to_lab(a)).max() < 0.1


@pytest.mark.parametrize("mode", ["mfnr", "hdrplus", "nightsight", "superres"])
def test_burst(spark, tmp_path, mode):
    clean = scene(48, 64, 8)
    shifts = [(0, 0), (2, -1), (-3, 2), (1, -3)] if mode in ("mfnr", "hdrplus") else [(0, 0), (0.4, -0.2), (-0.6, 0.5), (0.2, -0.7)]
    images = [noisy(shifted(clean, dx, dy), 2000, k) for k, (dx, dy) in enumerate(shifts)]
    two = frame(spark, images).selectExpr("cast(0 as long) burst_id", "*").unionByName(frame(spark, images[:2]).selectExpr("cast(1 as long) burst_id", "*"))
    got = {r.burst_id: r for r in pipelines.burst(spark, two, str(tmp_path / "job"), mode).collect()}
    assert set(got) == {0, 1}
    out = raster.unpack(bytes(got[0].data), got[0].width, got[0].height)
    if mode == "mfnr":
        assert raster.psnr(out, clean) > raster.psnr(images[0], clean) and raster.psnr(out, clean) > 26
    elif mode == "superres":
        assert out.shape == (96, 128, 3)
        assert raster.psnr(out[::2, ::2], clean) > raster.psnr(blend.up(images[0].astype(float), 96, 128)[::2, ::2], clean) - 6
    else:
        plain = rasters.merged(images, [np.array(r.offsets).reshape(r.tiles_y, r.tiles_x, 2) for r in spark.read.parquet(str(tmp_path / "job" / "align")).where("burst_id = 0").orderBy("image_id").collect()], mode)
        assert raster.psnr(plain, clean) > raster.psnr(images[0], clean)
        assert (out == rasters.finished(plain, mode)).all() and (out != plain).any()


def test_a_missing_field_fails(spark):
    df = frame(spark, [scene(16, 16), scene(16, 16)]).selectExpr("cast(0 as long) burst_id", "*")
    none = spark.createDataFrame([], "burst_id long, image_id long, tiles_x int, tiles_y int, offsets array<double>")
    with pytest.raises(Exception, match="no offsets"):
        rasters.merge_burst(df, none, "mfnr").collect()
    with pytest.raises(ValueError):
        rasters.merge_burst(df, none, "unknown")


def test_overlap_rules(spark):
    chunks = spark.createDataFrame([("C_0_0", 0, 0, 4096, 4096)], "id string, x_offset int, y_offset int, width int, height int")
    boxes = [(0, 0.0, 0.0, 1000.0, 800.0), (1, 1e5, 0.0, 1e5 + 9, 9.0), (2, 3500.0, 3500.0, 4500.0, 4500.0), (3, 4096.0, 0.0, 5000.0, 10.0), (4, None, None, None, None)]
    met = geometry.overlap(spark.createDataFrame(boxes, "image long, x0 double, y0 double, x1 double, y1 double"), chunks, 4096)
    assert sorted(r.image for r in met.collect()) == [0, 2, 4]


def test_catalog(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    empty = spark.createDataFrame([], catalog.TASKS)
    tasks = catalog.create_if_absent(empty, catalog.seed_align_tasks(images))
    assert tasks.count() == 6
    again = catalog.create_if_absent(tasks, catalog.seed_align_tasks(images))
    assert again.count() == 6 and catalog.find_task(again, "ALIGN", "pair", "2:1").count() == 1
    assert catalog.create_if_absent(empty, catalog.seed_optimize_tasks(images)).count() == 7
    assert catalog.seed_burst_tasks(spark, images).count() == 5
    running = again.selectExpr("row_number() over (order by unit_key) as task_id", "stage", "unit_kind", "unit_key", "case when unit_key = '1' then 'RUNNING' when unit_key = '2' then 'COMPLETED' else status end status")
    assert catalog.pending(catalog.reclaim(running)).count() == 5
    p = catalog.progress(catalog.reclaim(running)).first()
    assert (p.total, p.done, p.complete) == (6, 1, False)
    met = spark.createDataFrame([("C_0_0", k) for k in range(40)], "chunk_id string, image_id long")
    done = spark.createDataFrame([("OPTIMIZE", "color", str(k), "COMPLETED", k) for k in range(0, 40, 2)], "stage string, unit_kind string, unit_key string, status string, output_blob_id long")
    blobs = spark.createDataFrame([(k, b"x") for k in range(40)], "blob_id long, data binary")
    assert catalog.contributors(met, done, blobs).count() == 16


def test_streams(spark, tmp_path):
    images = [scene(10, 12, k) for k in range(4)]
    for k, a in enumerate(images):
        frame(spark, [a]).selectExpr("cast(7 as long) burst_id", f"cast({k} as long) image_id", "width", "height", "data").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("burst_id long, image_id long, width int, height int, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = bursts.running_merge(stream).writeStream.outputMode("update").format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from merged").collect()
    assert [r.frames for r in sorted(rows, key=lambda r: r.frames)] == [1, 2, 3, 4]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:10:00", "b", 5.0), ("2024-01-01 05:00:00", "b", 0.0)], "t string, event_type string, value double").selectExpr("cast(t as timestamp) ts", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev"))
    q = bursts.windowed_mean(s).writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r.start), r.event_type): (r.n, r.mean) for r in spark.sql("select * from win").collect()}
    assert got["2024-01-01 00:00:00", "a"] == (2, 2.0) and len(got) == 3
    s = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev"))
    rows = bursts.into_table(bursts.windowed_mean(s), ["start", "event_type"], f"file://{tmp_path}/table")
    assert {(str(r.start), r.event_type): (r.n, r.mean) for r in rows.collect()} == got


def test_late_events_are_dropped(spark, tmp_path):
    """Appended to Parquet: a window goes out once the watermark has passed it, and what comes later does not count."""
    batches = [["2024-01-01 00:10:00", "2024-01-01 05:00:00"], ["2024-01-01 06:10:00"], ["2024-01-01 00:20:00", "2024-01-01 07:10:00"], ["2024-01-01 09:00:00"], ["2024-01-01 09:01:00"]]
    for k, times in enumerate(batches):
        rows = spark.createDataFrame([(t, "a", float(k)) for t in times], "t string, event_type string, value double")
        rows.selectExpr("cast(t as timestamp) ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        for f in (tmp_path / "in" / f"{k}").iterdir():
            os.utime(f, (1e9 + k, 1e9 + k))
    s = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = bursts.windowed_mean(s).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {str(r.start): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01 00:00:00"] == 1 and got["2024-01-01 05:00:00"] == 1 and "2024-01-01 09:00:00" not in got


def test_cli(spark, tmp_path):
    clean = scene(32, 40)
    files = []
    for k in range(3):
        files.append(str(tmp_path / f"f{k}.png"))
        with open(files[-1], "wb") as f:
            f.write(raster_files.png((noisy(clean, 1500, k) >> 8).astype(np.uint8)))
    (tmp_path / "b").mkdir()
    shutil.copy(files[1], tmp_path / "b" / "f0.png")  # the name of another input, in another folder
    two = {r.image_id: bytes(r.data) for r in cli.load(spark, [files[0], str(tmp_path / "b" / "f0.png")]).collect()}
    assert len(two) == 2 and two[0] != two[1]
    out = str(tmp_path / "out.tif")
    assert cli.main(["mfnr", *files, "-o", out, "--work", str(tmp_path / "w")], spark) == 0
    with open(out, "rb") as f:
        assert raster_files.read_tiff16(f.read()).shape == (32, 40, 3)
    assert cli.main(["mfnr", files[0], "-o", out], spark) == 2 and cli.main(["nothing"], spark) == 2
    assert cli.main(["mfnr", *files, "-o", str(tmp_path / "x.bmp")], spark) == 1
