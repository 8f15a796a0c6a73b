"""Embedding near-duplicates: randomised-rotation binary codes with correction factors.

A unit vector o is rotated at random and coded by its signs: x = sign(R o) / sqrt(D), with the stored
factor c = <x, R o>. For another unit vector q, <x, R q> / c estimates <o, q> without bias. With
cos(o, q) = t, R q splits into t R o and a rest of length sqrt(1 - t * t) across it, of which x sees at
most sqrt(1 - c * c); so the estimate is at least t - sqrt(1 - t * t) * sqrt(1 - c * c) / c. That bound
holds with certainty: pairs below it at the threshold cannot be links. Only codes and a byte for each
number of R q go between tasks (what the bytes lose is stored and widens the bound); the vectors follow
for those with an open pair, which are computed again in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, small
from tessera.llm.graph import components
from tessera.llm.textkit import mix

BLOCK = 8192
PIVOTS = 1024
TILE = 512


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as float64, shorter ones filled with zeros, each by a power of two so that squares neither vanish nor overflow."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    out = np.zeros((len(column), d))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0.0))[1][:, None])


class Codes:
    """Sign codes, one bit a dimension, the correction factor of each vector, and the rotated vector as bytes with a scale and the length of what they lose."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray):
        rotated = unit @ turn.T
        self.bits = np.packbits(rotated >= 0, axis=1)
        self.factor = (np.abs(rotated).sum(axis=1) / math.sqrt(unit.shape[1])).astype(np.float32)
        self.scale = (np.abs(rotated).max(axis=1) / 127).astype(np.float32)
        self.quant = np.rint(rotated / self.scale[:, None]).astype(np.int8)
        self.lost = np.linalg.norm(rotated - self.quant * self.scale[:, None].astype(np.float64), axis=1).astype(np.float32)

    #: Name, type and numbers of a vector (0 for d, -1 for d bits) of what goes from task to task.
    PARTS = (("bits", np.uint8, -1), ("factor", np.float32, 1), ("scale", np.float32, 1), ("quant", np.int8, 0), ("lost", np.float32, 1))

    @staticmethod
    def estimate(bits: np.ndarray, factor: np.ndarray, rotated: np.ndarray) -> np.ndarray:
        """Estimated inner products of coded vectors (rows) with rotated unit vectors (columns)."""
        d = rotated.shape[1]
        signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
        return (signs @ rotated.T.astype(np.float32)) / (factor[:, None] * math.sqrt(d)).astype(np.float32)

    @staticmethod
    def bound(factor: np.ndarray, threshold: float) -> np.ndarray:
        """The least estimate of a pair whose cosine is the threshold or more."""
        c = np.minimum(factor, 1.0)
        return threshold - math.sqrt(max(0.0, 1 - threshold * threshold)) * np.sqrt(1 - c * c) / c - 1e-5


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def open_pairs(left: dict, right: dict, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which codes of two blocks (or of one, ``same``) have a partner that their bound does not exclude."""
    here, there = np.zeros(len(left["factor"]), dtype=bool), np.zeros(len(right["factor"]), dtype=bool)
    rotated = right["quant"].astype(np.float32) * right["scale"][:, None]
    for i in range(0, len(here), TILE):
        rows = slice(i, i + TILE)
        factor = left["factor"][rows]
        guess = Codes.estimate(left["bits"][rows], factor, rotated)
        guess -= Codes.bound(factor, threshold)[:, None].astype(np.float32) - 1e-5
        guess += right["lost"][None, :] / factor[:, None]
        found = guess >= 0
        if same:
            found[np.arange(len(factor)), np.arange(i, i + len(factor))] = False
        here[rows] |= found.any(axis=1)
        there |= found.any(axis=0)
    return here, there


def block_links(left: dict, right: dict | None, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks (or within one): linked vectors weighed by copies, and the root of each vector."""
    both = left if right is None else {k: np.concatenate([left[k], right[k]]) for k in left}
    n, m = len(left["copies"]), len(both["copies"])
    cols = np.arange(n, m) if right is not None else np.arange(m)
    unit = both["vec"] / np.sqrt(np.einsum("ij,ij->i", both["vec"], both["vec"]))[:, None]
    both = both | vars(Codes(unit, turn))
    rotated = (unit[cols] @ turn.T).astype(np.float32)
    least = Codes.bound(both["factor"], threshold)
    count, root = np.zeros(m, dtype=np.int64), np.arange(m)
    for i in range(0, n, TILE):
        rows = np.arange(i, min(i + TILE, n))
        found = Codes.estimate(both["bits"][rows], both["factor"][rows], rotated) >= least[rows][:, None]
        r, c = np.nonzero(found)
        r, c = rows[r], cols[c]
        if right is None:
            r, c = r[r < c], c[r < c]
        for k in range(0, len(r), 1 << 16):
            a, b = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
            hit = cosines(both["vec"][a], both["vec"][b]) >= threshold
            a, b = a[hit], b[hit]
            if not len(a):
                continue
            np.add.at(count, a, both["copies"][b])
            np.add.at(count, b, both["copies"][a])
            while True:
                ra, rb = root[a], root[b]
                if (ra == rb).all():
                    break
                low = np.minimum(ra, rb)
                np.minimum.at(root, ra, low)
                np.minimum.at(root, rb, low)
                while (root[root] != root).any():
                    root = root[root]
    return count, root


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, block: int = BLOCK, pivots: int = PIVOTS, seed: int = 42
) -> DataFrame:
    """Vectors linked by a cosine of ``threshold`` or more, all against all.

    Returns id_col, n_links (other rows linked directly), component_id (the smallest id reachable by
    links) and kept (whether the row's id is that one). Equal vectors are one node with a number of
    copies, so a large group of copies costs one comparison. Nodes are put into cells round at most
    ``pivots`` pivots, a bounded sample by least hash, and cells into blocks of about ``block``; a pair of
    blocks is compared unless the angle between their pivots exceeds both radii and the link's angle,
    and a vector goes to a block only if the triangle inequality for angles allows a link there. A
    vector that is null, all zero or has a null, NaN or infinite component, or whose id is null, links
    with nothing. Vectors of unequal length compare as if filled up with zeros. Rows that share an id
    but not a vector are nodes of their own; equal rows link with each other.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vec_col)
    wide = F.transform(v, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = F.coalesce(v.isNotNull() & sound, F.lit(False)) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), F.when(valid, v).alias("vec"), F.when(valid, F.unhex(F.md5(F.concat_ws(",", v)))).alias("key"))
    nodes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    nodes = cut(nodes, "vectors")
    total, d = nodes.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    edge_schema = "node long, links long, root long"
    if not total:
        placed = nodes.withColumn("node", F.lit(0).cast("long"))
        found = spark.createDataFrame([], edge_schema)
    else:
        sample = nodes.orderBy(F.xxhash64("key"), "key").limit(max(1, min(pivots, math.ceil(total / block)))).select("vec").toArrow()
        centre = matrix(sample.column("vec"), d)
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
        turn = rotation(d, seed)
        angle = math.acos(threshold) + 1e-6

        def place(batches):
            for batch in batches:
                vec = matrix(batch.column(3), d)
                unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
                away = np.arccos(np.clip(unit @ centre.T, -1, 1))
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "away"])

        element = vectors.schema[vec_col].dataType.simpleString()
        placed = nodes.select("key", "least", "copies", "vec").mapInArrow(place, f"key binary, least {kind}, copies long, vec {element}, cell int, away double")
        placed = cut(placed.withColumn("node", F.monotonically_increasing_id()), "placed")
        extent = {r.cell: (r.n, r.radius) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}  # at most ``pivots`` rows
        first, parts, at = {}, {}, 0
        for c in sorted(extent):
            first[c], parts[c] = at, math.ceil(extent[c][0] / block)
            at += parts[c]
        between = np.arccos(np.clip(centre @ centre.T, -1, 1))
        cells = sorted(extent)
        radius = np.array([extent[c][1] for c in cells])
        cell_first, cell_parts = np.array([first[c] for c in cells]), np.array([parts[c] for c in cells])
        blocks = at

        def deal(batches):
            """Codes to every pair of blocks in which their vector may link, packed: pair = low block * blocks + high block."""
            for batch in batches:
                vec = matrix(batch.column(1), d)
                unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
                codes = vars(Codes(unit, turn))
                away = np.arccos(np.clip(unit @ centre[cells].T, -1, 1))
                node, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
                index = np.searchsorted(cells, cell)
                mine = cell_first[index] + (mix(node.astype(np.uint64)) % cell_parts[index].astype(np.uint64)).astype(np.int64)
                ok = (away <= radius[None, :] + angle) & (between[np.ix_(cell, cells)] <= radius[index][:, None] + radius[None, :] + angle)
                ok[np.arange(len(cell)), index] = True
                owner, to = np.nonzero(ok)
                n = cell_parts[to]
                owner, other = np.repeat(owner, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(cell_first[to], n)
                pair = np.minimum(mine[owner], other) * blocks + np.maximum(mine[owner], other)
                order = np.lexsort((owner, mine[owner], pair))
                owner, pair = owner[order], pair[order]
                starts = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (mine[owner[1:]] != mine[owner[:-1]])))
                groups = np.split(owner, starts[1:])
                columns = [pa.array([x[g].tobytes() for g in groups], pa.binary()) for x in (node, *(codes[name] for name, _, _ in Codes.PARTS))]
                yield pa.RecordBatch.from_arrays([pa.array(pair[starts]), pa.array(mine[owner[starts]]), *columns], names=names)

        names = ["pair", "block", "node", *(name for name, _, _ in Codes.PARTS)]
        dealt = placed.select("node", "vec", "cell").mapInArrow(deal, "pair long, block long, " + ", ".join(f"{x} binary" for x in names[2:]))

        def screen(group: pa.Table) -> pa.Table:
            pair, where = group.column("pair")[0].as_py(), group.column("block").to_numpy()

            def side(b: int) -> tuple[np.ndarray, dict]:
                some = group.take(pa.array(np.flatnonzero(where == b)))
                raw = lambda c: b"".join(some.column(c).to_pylist())
                wide = {0: d, -1: (d + 7) // 8}
                return np.frombuffer(raw("node"), np.int64), {c: np.frombuffer(raw(c), kind_).reshape((-1, wide[k]) if k in wide else -1) for c, kind_, k in Codes.PARTS}

            a, b = divmod(pair, blocks)
            (mine, left), (others, right) = side(a), side(b)
            here, there = open_pairs(left, right, a == b, threshold)
            sides = [(a, mine[here | there])] if a == b else [(a, mine[here]), (b, others[there])]
            return pa.table({"pair": pa.array(np.repeat(pair, sum(len(x) for _, x in sides)), pa.int64()), "block": pa.array(np.concatenate([np.repeat(k, len(x)) for k, x in sides]), pa.int64()), "node": pa.array(np.concatenate([x for _, x in sides]), pa.int64())})

        def compare(group: pa.Table) -> pa.Table:
            a, b = divmod(group.column("pair")[0].as_py(), blocks)
            where, node = group.column("block").to_numpy(), group.column("node").to_numpy()
            table = {"copies": group.column("copies").to_numpy(), "vec": matrix(group.column("vec"), d)}
            pick = lambda at: {k: x[at] for k, x in table.items()}
            if a == b:
                count, root = block_links(table, None, turn, threshold)
            else:
                low, high = np.flatnonzero(where == a), np.flatnonzero(where == b)
                node = node[np.concatenate([low, high])]
                count, root = block_links(pick(low), pick(high), turn, threshold)
            some = np.flatnonzero(count)
            return pa.table({"node": pa.array(node[some]), "links": pa.array(count[some]), "root": pa.array(node[root[some]])})

        opened = cut(dealt.groupBy("pair").applyInArrow(screen, "pair long, block long, node long"), "open")
        found = opened.join(placed.select("node", "copies", "vec"), "node").groupBy("pair").applyInArrow(compare, edge_schema)
        found = cut(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts_of = components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = placed.select("node", "least").join(parts_of, "node")
    least = small(linked.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    linked = linked.join(least, "component").select("node", "component_id")
    known = placed.select("node", "key", "least", "copies").join(linked, "node", "left").join(links, "node", "left")
    known = known.select("key", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "key").join(known, "key", "left")
    smallest = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), smallest.alias("component_id"), F.coalesce(F.col("id") == smallest, F.lit(True)).alias("kept"))
