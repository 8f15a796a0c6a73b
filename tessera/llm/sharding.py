"""Sharding: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
BUCKETS = 4096
STEP = 4096


class Feistel:
    """A permutation of 0..n-1 that a seed decides; ``at`` and ``back`` compute it and its inverse."""

    def __init__(self, n: int, seed: int = 42):
        self.n = n
        bits = max(2, (n - 1).bit_length() if n > 1 else 2)
        self.half = np.uint64((bits + 1) // 2)
        self.mask = np.uint64((1 << int(self.half)) - 1)
        state, self.keys = seed & (1 << 64) - 1, []
        for _ in range(ROUNDS):
            state = (state + 0x9E3779B97F4A7C15) & (1 << 64) - 1
            self.keys.append(np.uint64(state))

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(x.astype(np.uint64), self.keys[::-1] if back else self.keys, back)
        while len(far := np.flatnonzero(out >= self.n)):  # the domain is under four times n, so few walk on
            out[far] = self._once(out[far], self.keys[::-1] if back else self.keys, back)
        return out.astype(np.int64)

    def at(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def back(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


def numbered(keyed: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """keyed with a global row number ``row_no`` from 0, gapless, in an order that only the keys decide; and the count.

    Equal keys are counted before anything is sorted, so a group of copies is a row until it is dealt
    out again. A hash of the keys puts them into BUCKETS buckets; the counts of the buckets, the only
    rows that the driver sees, give each bucket's first number, and a window numbers within it.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    counted = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", bucket)
    sizes = dict(counted.groupBy("_b").agg(F.sum("_n").alias("n")).collect())
    firsts, total = [], 0
    for b in range(BUCKETS):
        firsts.append(total)
        total += sizes.get(b, 0)
    base = F.element_at(F.lit(np.array(firsts, dtype=np.int64)), F.col("_b") + 1)
    order = Window.partitionBy("_b").orderBy(*(F.col(k).asc_nulls_last() for k in keys)).rowsBetween(Window.unboundedPreceding, -1)
    rows = counted.withColumn("_at", base + F.coalesce(F.sum("_n").over(order), F.lit(0)))
    # dealt out in two steps, so that a large group of copies never is one long array
    steps = rows.select(*keys, "_at", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(STEP).cast("long"))).alias("_s"))
    each = steps.select(*keys, "_at", F.explode(F.sequence(F.col("_s"), F.least(F.col("_s") + STEP, F.col("_n")) - 1)).alias("_k"))
    return each.select(*keys, (F.col("_at") + F.col("_k")).alias("row_no")), total


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard and a slot by a seeded permutation of global row numbers.

    Returns id_col, size (UTF-8 bytes and 16), text_crc32, row_no, shard and slot. The place of row r
    is p = permutation(r): shard p mod n_shards, slot p div n_shards, so shards differ by one row at
    most and slots have no gap. Both are computable from r, n, seed and n_shards alone. A null text
    has no bytes (size 16, CRC of nothing, 0). Rows of equal id, size and CRC are interchangeable and
    get numbers of their own; null ids are numbered last of their bucket; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows, total = numbered(keyed, [id_col, "size", "text_crc32"])

    def run(batches):
        walk = Feistel(total, seed)
        for batch in batches:
            place = walk.at(batch.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place % n_shards, pa.int32()), pa.array(place // n_shards, pa.int64())], names=[*batch.schema.names, "shard", "slot"])

    return rows.mapInArrow(run, f"{id_col} {kind}, size long, text_crc32 long, row_no long, shard int, slot long")
