"""Command line: stitch, mfnr, hdrplus, nightsight, superres.

    spark-submit tessera/cli.py stitch a.png b.png -o out.jpg [--quality 95] [--chunk-size 1024] [--work DIR]

Exit codes: 0 done, 1 failed, 2 bad arguments.
"""

from __future__ import annotations

import argparse
import re
import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

VERBS = ("stitch", "mfnr", "hdrplus", "nightsight", "superres")


def load(spark: SparkSession, paths: list[str]):
    """Rasters of all files, numbered in the order given."""
    from tessera.operators import rasters
    from tessera.sources import raster_files

    raw = [p for p in paths if p.rsplit(".", 1)[-1].lower() in raster_files.RAW]
    plain = [p for p in paths if p not in raw]
    parts = []
    if plain:
        parts.append(raster_files.read_images(spark, plain).select("path", "width", "height", "data"))
    if raw:
        planes = raster_files.read_raw(spark, raw)
        parts.append(rasters.develop(planes).join(planes.select("image_id", "path"), "image_id").select("path", "width", "height", "data"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = spark.createDataFrame([(k, _whole(spark, p)) for k, p in enumerate(paths)], "image_id long, name string")
    return out.withColumn("name", F.regexp_replace("path", "^file:/+", "/")).join(order, "name").select("image_id", "width", "height", "data")


def _whole(spark: SparkSession, path: str) -> str:
    """The full path, with its store unless that is the local one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "/", p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("verb", choices=VERBS)
    parser.add_argument("files", nargs="+")
    parser.add_argument("-o", "--output", required=True)
    parser.add_argument("--quality", type=int, default=95)
    parser.add_argument("--chunk-size", type=int, default=1024)
    parser.add_argument("--preview", type=int, default=4096)
    parser.add_argument("--work", default=None)
    parser.add_argument("--backend", choices=("auto", "cpu"), default="auto", help="both run on Spark's executors")
    try:
        args = parser.parse_args(argv)
        if not 1 <= args.quality <= 100 or args.chunk_size < 1 or len(args.files) < 2:
            parser.error("quality is 1 to 100, the chunk size positive, and two files are needed")
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    from tessera.operators import rasters
    from tessera.plans import pipelines
    from tessera.sources import raster_files

    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    work = args.work or f"file://{tempfile.mkdtemp(prefix='tessera-job-')}"
    tell = lambda stage, done, n: print(f"{stage}: {done}/{n}", file=sys.stderr)
    try:
        images = load(spark, args.files)
        if args.verb == "stitch":
            rendered, grid = pipelines.panorama(spark, images, work, args.chunk_size, progress=tell)
            out = rasters.mosaic(rendered, grid, args.preview)
        else:
            out = pipelines.one_raster(pipelines.burst(spark, images.withColumn("burst_id", F.lit(0).cast("long")), work, args.verb, tell))
        raster_files.write_output(spark, out, args.output, args.quality)
    except Exception as e:  # noqa: BLE001
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
