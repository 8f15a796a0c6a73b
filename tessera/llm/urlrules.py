"""URL filters: a memory-mapped, sorted array of 64-bit digests of rules, probed by vectorised binary search."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import shared_dir

_HEAD = struct.Struct("<8sQQQ")
_MAGIC = b"URLRULE2"


def rule_key(host: str, path: str) -> str:
    """host and path in one string; a host has no slash, so where a path begins with one it cannot be misread."""
    return f"{host}\x00{path}"


def index_bytes(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The index of (verdict, host, path) rules: digests in order, ends of the stored strings, lengths that paths have, verdicts, strings.

    The last of several rules with one host and path holds.
    """
    verdicts = {rule_key(h.lower(), p): v for v, h, p in rules}
    raw = sorted((xxhash.xxh64_intdigest(x := k.encode()), x, v == "block") for k, v in verdicts.items())
    sizes = sorted({len(k.partition("\x00")[2]) for k in verdicts})
    return b"".join(
        [
            _HEAD.pack(_MAGIC, len(raw), sum(len(x) for _, x, _ in raw), len(sizes)),
            np.array([d for d, _, _ in raw], dtype="<u8").tobytes(),
            np.cumsum([0, *(len(x) for _, x, _ in raw)], dtype="<u8").tobytes(),
            np.array(sizes, dtype="<u8").tobytes(),
            bytes(v for _, _, v in raw),
            *(x for _, x, _ in raw),
        ]
    )


def write_index(rules: Iterable[tuple[str, str, str]], path: str) -> None:
    with open(path, "wb") as f:
        f.write(index_bytes(rules))


class RuleIndex:
    """The file of ``write_index``, memory-mapped: digests are searched, stored strings settle collisions."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            magic, n, size, m = _HEAD.unpack(f.read(_HEAD.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no rule index")
        at = _HEAD.size
        self.keys = np.memmap(path, "<u8", "r", at, (n,)) if n else np.zeros(0, "<u8")
        self.ends = np.memmap(path, "<u8", "r", at + 8 * n, (n + 1,))
        at += 16 * n + 8
        self.path_sizes = np.memmap(path, "<u8", "r", at, (m,)).tolist() if m else []
        self.block = np.memmap(path, "u1", "r", at + 8 * m, (n,)) if n else np.zeros(0, "u1")
        self.text = np.memmap(path, "u1", "r", at + 8 * m + n, (size,)) if size else np.zeros(0, "u1")

    def stored(self, k: int) -> np.ndarray:
        return self.text[int(self.ends[k]) : int(self.ends[k + 1])]

    def find(self, keys: list[str]) -> np.ndarray:
        """The place of each key, -1 for none."""
        raw = [k.encode() for k in keys]
        digests = np.fromiter(map(xxhash.xxh64_intdigest, raw), dtype=np.uint64, count=len(raw))
        at = np.searchsorted(self.keys, digests)
        out = np.full(len(raw), -1, dtype=np.int64)
        for k in np.flatnonzero((at < len(self.keys)) & (np.append(self.keys, np.uint64(0))[at] == digests)):
            place = int(at[k])
            while place < len(self.keys) and self.keys[place] == digests[k]:  # all that share the digest
                if bytes(self.stored(place)) == raw[k]:
                    out[k] = place
                    break
                place += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """For each host and path the longest rule that fits, as (host + path, block), or none.

        Of rules of equal length the one with the longer host holds.
        """
        keys, owners = [], []
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            tail = host
            while tail:
                for n in self.path_sizes:
                    if n <= len(path):
                        keys.append(rule_key(tail, path[:n]))
                        owners.append(k)
                dot = tail.find(".")
                tail = tail[dot + 1 :] if dot >= 0 else ""
        best: list[tuple[int, int, int] | None] = [None] * len(hosts)
        places = self.find(keys)
        for q in np.flatnonzero(places >= 0):
            host, _, path = keys[q].partition("\x00")
            rank = (len(host) + len(path), len(host), int(places[q]))
            k = owners[q]
            if best[k] is None or rank > best[k]:
                best[k] = rank
        out: list[tuple[str, bool] | None] = []
        for b in best:
            out.append(None if b is None else (bytes(self.stored(b[2])).decode().replace("\x00", ""), bool(self.block[b[2]])))
        return out


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    host, path = rest[:cut].translate(_LOWER), rest[cut:]
    return host, path[: min((k for c in "?#" if (k := path.find(c)) >= 0), default=len(path))]


def _shared_index(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """The name under which executors find the index of the rules."""
    raw = index_bytes(rules)
    name = f"url-rules-{hashlib.sha256(raw).hexdigest()[:24]}.idx"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessera/{name}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        out = store.create(path)
        for k in range(0, len(raw), 1 << 20):
            out.write(bytearray(raw[k : k + (1 << 20)]))
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every URL by the longest rule that fits its host (or a parent domain) and begins its path.

    ``rules`` are (verdict, host, path). The driver writes their index once to the shared folder, Spark
    brings it to every executor, and all tasks there map the same file. Returns id_col, host, path, rule (null if none fits) and verdict (``default`` if none).
    A null URL and one without ``://`` have empty host and path and so no rule. Null ids and repeated
    rows stay, a row each; other columns are not carried.
    """
    name = _shared_index(pages.sparkSession, rules)

    def run(batches):
        index = RuleIndex(SparkFiles.get(name))
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            hosts, paths = [h for h, _ in parts], [p for _, p in parts]
            found = index.judge(hosts, paths)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(hosts, pa.string()),
                    pa.array(paths, pa.string()),
                    pa.array([f and f[0] for f in found], pa.string()),
                    pa.array([default if f is None else "block" if f[1] else "allow" for f in found], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    return pages.select(id_col, url_col).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string")
