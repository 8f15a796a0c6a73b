"""Tables and lineage cuts that the operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch that goes to Python: with texts of 100 KB each, a batch is 100 MB.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows for an Arrow batch to BATCH_ROWS, since documents are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of all tables that this process has cut and not removed.
_written: list[str] = []
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share.

    Where it is unset, a folder of our own, gone with the process, if all runs on one machine; on a cluster
    nothing else is shared for certain, so that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.conf.get("tessera.shared.dir", None)
        if not where:
            if not (spark.sparkContext.master or "").split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            where = f"file://{own}"
            spark.conf.set("tessera.shared.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    for tables in getattr(_open, "stack", []):
        tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _written:
            _written.remove(path)


@contextlib.contextmanager
def transient(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables cut within go at the end, but for those given to ``keep``, the function it yields."""
    kept: set[str] = set()
    tables: list[str] = []
    _open.stack = [*getattr(_open, "stack", []), tables]

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._cut_at)
        return df

    try:
        yield keep
    finally:
        _open.stack = _open.stack[:-1]
        remove(spark, [p for p in tables if p not in kept and p in _written])


def give_back() -> None:
    """Return this process's free memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function over batches that gives the memory back at its end: Python workers live on, and the next stage shares their machine."""

    def around(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return around


#: Rows of a table that is broadcast, about 25 MB; a larger one is joined by a shuffle.
FEW = 500_000


def small(df: DataFrame, name: str) -> DataFrame:
    """df, written once; to be broadcast if it has at most FEW rows."""
    df = cut(df, name)
    return F.broadcast(df) if df.count() <= FEW else df


def free_names(columns: list[str], *stems: str) -> list[str]:
    """A name for each stem that none of the columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def bit_filter(places: DataFrame, bits: int) -> np.ndarray:
    """A fixed number of bits, packed low bit first, with those at ``places`` (one long column) set.

    Pieces of 8 KB are put together by the executors; the driver gets bits / 8 bytes at most, whatever
    the number of places.
    """

    def pieces(batches):
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(at >> 16).tolist():
                piece = have.setdefault(k, np.zeros(1 << 16, dtype=bool))
                piece[at[at >> 16 == k] & 0xFFFF] = True
            if len(have) > 1024:  # keep what one task holds small
                yield packed(have)
                have = {}
        yield packed(have)

    def packed(have):
        raw = [np.packbits(x, bitorder="little").tobytes() for x in have.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(have), pa.int64()), pa.array(raw, pa.binary())], names=["k", "bits"])

    column = F.col(places.columns[0])
    dealt = places.select(column.alias("at")).repartitionByRange(F.shiftright("at", 16)).sortWithinPartitions("at")
    out = np.zeros(bits >> 3, dtype=np.uint8)
    for k, raw in dealt.mapInArrow(pieces, "k long, bits binary").toLocalIterator():
        out[k << 13 : (k + 1) << 13] |= np.frombuffer(raw, dtype=np.uint8)
    return out


def has_bit(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places ``bit_filter`` has set."""
    return (packed[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def sweep(spark: SparkSession) -> None:
    """Remove all tables that this process has cut. Results that still read them must have been written before."""
    remove(spark, [*_written])
