"""Streams: frames that arrive one by one, and windows over events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import raster


def running_merge(frames: DataFrame, sigma: float = 2000.0) -> DataFrame:
    """A robust mean per burst that grows with every frame: burst_id, frames, width, height, data.

    frames: a stream of burst_id, image_id, width, height, data, aligned already. The state is the first
    frame, the weighed sum and the weights: three images, however long the burst.
    """

    def update(key, batches, state: GroupState):
        if state.exists:
            w, h, n, first, total, weight = state.get
            ref = raster.unpack(bytes(first), w, h).astype(np.float64)
            total, weight = np.frombuffer(total).reshape(ref.shape).copy(), np.frombuffer(weight).reshape(ref.shape).copy()
        else:
            w = h = n = 0
            ref = total = weight = None
        for pdf in batches:
            for r in pdf.sort_values("image_id").itertuples():
                v = raster.unpack(bytes(r.data), int(r.width), int(r.height)).astype(np.float64)
                if ref is None:
                    ref, total, weight, w, h = v, np.zeros_like(v), np.zeros_like(v), int(r.width), int(r.height)
                k = np.exp(-((v - ref) ** 2) / (2 * sigma * sigma))
                total += k * v
                weight += k
                n += 1
        if ref is None:
            return
        state.update((w, h, n, raster.pack(ref.astype(np.uint16)), total.tobytes(), weight.tobytes()))
        yield pd.DataFrame({"burst_id": [key[0]], "frames": [n], "width": [w], "height": [h], "data": [raster.pack(raster.cut_off(total / weight))]})

    return frames.groupBy("burst_id").applyInPandasWithState(
        update, "burst_id long, frames int, width int, height int, data binary", "w int, h int, n int, first binary, total binary, weight binary", "update", GroupStateTimeout.NoTimeout
    )


def into_table(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run a stream in update mode to the end of what is there; the rows of each batch go to Parquet in ``folder``.

    Returns the last row of each key. A batch that is run again after a failure replaces what it wrote.
    """
    spark = stream.sparkSession
    write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, *(F.col("_last")[c].alias(c) for c in rest))


def windowed_mean(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Per window and event type: count, sum and mean of value; rows later than the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total", "mean")
