"""Spark data sources for raw and TIFF rasters: spark.read.format("rawimage"), df.write.format("tiff16")."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.functions import raster
from tessera.sources import raster_files


class RawImages(DataSource):
    """Sensor planes of the files that match ``path``, a partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "rawimage"

    def schema(self) -> str:
        return "path string, width int, height int, black int, filters long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _RawReader(self.options["path"])


class _RawReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*.dng")) if os.path.isdir(self.path) else glob.glob(self.path))
        return [InputPartition(f) for f in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or partition.value is None:
            return
        with open(partition.value, "rb") as f:
            x = raster_files.parse_dng(f.read())
        yield partition.value, x["width"], x["height"], x["black"], x["filters"], x["data"]


class Tiff16(DataSource):
    """Rasters (image_id, width, height, data) as files image_id.tif in ``path``, put there on commit."""

    @classmethod
    def name(cls) -> str:
        return "tiff16"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TiffWriter(self.options["path"])


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _TiffWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        attempt, files = TaskContext.get().taskAttemptId(), []
        for row in rows:
            final = os.path.join(self.path, f"{row.image_id}.tif")
            with open(part := f"{final}.{attempt}.part", "wb") as f:
                f.write(raster_files.tiff16(raster.unpack(bytes(row.data), row.width, row.height)))
            files.append((part, final))
        return _Written(files)

    def commit(self, messages) -> None:
        for m in messages:
            for part, final in m.files if m else ():
                os.replace(part, final)

    def abort(self, messages) -> None:
        for m in messages:
            for part, _ in m.files if m else ():
                if os.path.exists(part):
                    os.remove(part)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawImages)
    spark.dataSource.register(Tiff16)
