"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import FEW, cut, transient


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the least node that each reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        if (low == root[a]).all() and (low == root[b]).all():
            return root
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(ends: DataFrame) -> DataFrame:
    """node, component of a graph whose edges (x, y) one task can hold."""
    kind = ends.schema["x"].dataType.simpleString()

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if tables:
            x, y = (pa.concat_arrays([b.column(k) for b in tables]).to_pylist() for k in (0, 1))
            names = sorted({*x, *y})
            place = {v: k for k, v in enumerate(names)}
            root = least_reached(np.array([place[v] for v in x]), np.array([place[v] for v in y]), len(names))
            kinds = tables[0].schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(names, kinds), pa.array([names[r] for r in root], kinds)], names=["node", "component"])

    return ends.select("x", "y").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """node, component: the least node that each node reaches; nodes without an edge are not there.

    A graph of at most ``few`` edges, about 25 MB, is done in one task. In a larger one
    edges between current roots are contracted: every root with a smaller neighbour hooks to its
    least one, chains of hooks are jumped to their ends, and the edges are renamed. A round leaves
    only roots that were least among their neighbours, so the roots at least halve. Each round's
    tables are cut to the shared folder and go at the end.
    """
    with transient(edges.sparkSession) as keep:
        pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
        ends = pairs.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct()
        ends = cut(ends, "edges")
        if ends.count() <= few:
            return keep(cut(_in_one_task(ends), "nodes"))
        nodes = cut(ends.select(F.col("x").alias("node")).union(ends.select("y")).distinct().select("node", F.col("node").alias("component")), "nodes")
        while not ends.isEmpty():
            hooks = cut(ends.groupBy("x").agg(F.min("y").alias("p")), "hooks")
            while True:
                up = hooks.select(F.col("x").alias("p"), F.col("p").alias("q"))
                jumped = hooks.join(up, "p", "left").select("x", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved"))
                jumped = cut(jumped, "jumped")
                moved = not jumped.where("moved").isEmpty()
                hooks = jumped.select("x", "p")
                if not moved:
                    break
            nodes = cut(nodes.join(hooks, nodes["component"] == hooks["x"], "left").select("node", F.coalesce("p", "component").alias("component")), "nodes")
            first = hooks.select(F.col("x"), F.col("p").alias("px"))
            second = hooks.select(F.col("x").alias("y"), F.col("p").alias("py"))
            renamed = ends.join(first, "x").join(second, "y", "left").select(F.col("px").alias("u"), F.coalesce("py", "y").alias("v")).where("u != v")
            ends = cut(renamed.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).distinct(), "edges")
        return keep(nodes)
