"""The job catalog: tasks, blobs and their overlays as DataFrames that are written as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED")
STAGES = ("INGEST", "ALIGN", "OPTIMIZE", "RENDER", "BURST_ALIGN", "BURST_MERGE")

TASKS = T.StructType(
    [
        T.StructField("task_id", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField("unit_kind", T.StringType()),
        T.StructField("unit_key", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("attempt_count", T.IntegerType()),
        T.StructField("output_blob_id", T.LongType()),
        T.StructField("checkpoint_json", T.StringType()),
        T.StructField("updated_at", T.LongType()),
    ]
)
INPUT_IMAGES = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("file_path", T.StringType()), T.StructField("homography", T.ArrayType(T.DoubleType())), T.StructField("gain", T.DoubleType()), T.StructField("cfa_type", T.StringType())]
)
CHUNKS = T.StructType(
    [T.StructField("id", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("x_offset", "y_offset", "width", "height")), T.StructField("status", T.StringType())]
)
BLOBS = T.StructType([T.StructField("blob_id", T.LongType()), T.StructField("format_tag", T.StringType()), T.StructField("data", T.BinaryType())])
KEY = ["stage", "unit_kind", "unit_key"]


def parse_enum(value: Column, known: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*known), value).otherwise(F.lit(default))


def reclaim(tasks: DataFrame) -> DataFrame:
    """After a crash: what was running is pending again."""
    return tasks.withColumn("status", F.when(F.col("status") == "RUNNING", "PENDING").otherwise(F.col("status")))


def pending(tasks: DataFrame, stage: str | None = None) -> DataFrame:
    """All that is not completed, in order."""
    some = tasks if stage is None else tasks.where(F.col("stage") == stage)
    return some.where(F.col("status") != "COMPLETED").orderBy("task_id")


def progress(tasks: DataFrame) -> DataFrame:
    """Per stage: total, done, progress, whether it is complete, and the next task."""
    done = F.col("status") == "COMPLETED"
    return tasks.groupBy("stage").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(done.cast("long")).alias("done"),
        F.avg(done.cast("double")).alias("progress"),
        F.bool_and(done).alias("complete"),
        F.min(F.when(~done, F.col("task_id"))).alias("next_id"),
    )


def create_if_absent(tasks: DataFrame, seeds: DataFrame, key: list[str] | None = None) -> DataFrame:
    """tasks and those seeds whose key is new; a seed that comes twice is taken once."""
    key = key or KEY
    fresh = seeds.dropDuplicates(key).join(tasks.select(*key), key, "left_anti")
    return tasks.unionByName(fresh.select(*[c for c in tasks.columns if c in fresh.columns]), allowMissingColumns=True)


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """base with the non-null values of changes laid over it, and the rows that are new."""
    own = [c for c in base.columns if c not in key]
    over = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c not in key])
    joined = base.join(over, key, "full")
    return joined.select(*key, *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if f"_new_{c}" in joined.columns else F.col(c) for c in own]).select(*base.columns)


def replace_partition(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``rows`` replaced by them."""
    return base.join(rows.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(rows)


def seed_image_tasks(images: DataFrame, stage: str, kind: str = "image") -> DataFrame:
    return images.select(F.lit(stage).alias("stage"), F.lit(kind).alias("unit_kind"), F.col("id").cast("string").alias("unit_key"), F.lit("PENDING").alias("status"))


def seed_align_tasks(images: DataFrame) -> DataFrame:
    """A task for each image and for each unordered pair."""
    pairs = images.select(F.col("id").alias("a")).join(images.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    each = pairs.select(F.lit("ALIGN").alias("stage"), F.lit("pair").alias("unit_kind"), F.concat_ws(":", "a", "b").alias("unit_key"), F.lit("PENDING").alias("status"))
    return seed_image_tasks(images, "ALIGN").unionByName(each)


def seed_optimize_tasks(images: DataFrame) -> DataFrame:
    """Gain and colour for each image, and one bundle adjustment."""
    spark = images.sparkSession
    one = spark.createDataFrame([("OPTIMIZE", "ba", "global", "PENDING")], "stage string, unit_kind string, unit_key string, status string")
    return seed_image_tasks(images, "OPTIMIZE", "gain").unionByName(seed_image_tasks(images, "OPTIMIZE", "color")).unionByName(one)


def seed_render_tasks(contributors: DataFrame) -> DataFrame:
    """A task for each chunk with a contributor."""
    return contributors.select(F.lit("RENDER").alias("stage"), F.lit("chunk").alias("unit_kind"), F.col("chunk_id").alias("unit_key"), F.lit("PENDING").alias("status")).distinct()


def seed_burst_tasks(spark: SparkSession, frames: DataFrame) -> DataFrame:
    merge = spark.createDataFrame([("BURST_MERGE", "merge", "merged", "PENDING"), ("BURST_MERGE", "merge", "final", "PENDING")], "stage string, unit_kind string, unit_key string, status string")
    return seed_image_tasks(frames, "BURST_ALIGN", "frame").unionByName(merge)


def find_task(tasks: DataFrame, stage: str, unit_kind: str, unit_key: str) -> DataFrame:
    """The task of a unit; the key of a pair is found either way round."""
    part = unit_key.split(":")
    keys = [unit_key, ":".join(reversed(part))] if len(part) == 2 else [unit_key]
    return tasks.where((F.col("stage") == stage) & (F.col("unit_kind") == unit_kind) & F.col("unit_key").isin(*keys))


def contributors(chunks_of_images: DataFrame, tasks: DataFrame, blobs: DataFrame, most: int = 32) -> DataFrame:
    """chunk_id, image_id and the blob of each contributor, at most ``most`` a chunk by image_id; the missing are left out."""
    from pyspark.sql import Window

    colour = tasks.where("stage = 'OPTIMIZE' and unit_kind = 'color' and status = 'COMPLETED'").select(F.col("unit_key").cast("long").alias("image_id"), F.col("output_blob_id").alias("blob_id"))
    ranked = chunks_of_images.withColumn("_r", F.row_number().over(Window.partitionBy("chunk_id").orderBy("image_id"))).where(F.col("_r") <= most)
    return ranked.drop("_r").join(colour, "image_id").join(blobs, "blob_id")
