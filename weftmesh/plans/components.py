"""Connected components of an edge table, by alternating large-star and small-star rounds.

Published method: Kiveris et al., "Connected Components in MapReduce and Beyond"
(2014).  Every round is two aggregations by node; no neighbour list is ever
gathered, so a hub costs a partial minimum and a join row per edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def _star(pairs: DataFrame) -> DataFrame:
    """Edges (v, m) that hang each neighbour below the least node seen from u.

    ``pairs`` has columns u, v; m is the least of u and its neighbours v.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node of each one's component: roots hang below their least neighbour, then all paths are cut short."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high != low
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(root, root[root]):
            root = root[root]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if not parts:
            return
        nodes, least = _least_of(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        for k in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 100_000]), pa.array(least[k : k + 100_000])], ["node", "component"])

    return materialize(edges.coalesce(1).mapInArrow(run, "node bigint, component bigint"), "components")


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task_rows: int = 0) -> DataFrame:
    """``edges`` (a, b: bigint) -> one row (node, component) per node, component = least node.

    Self loops and repeated edges are allowed; null ends are dropped; an empty
    table gives an empty result.  At most ``one_task_rows`` edges, counted, are
    joined in one task; more of them take the rounds.
    """
    current = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = materialize(current, "components")
    if one_task_rows and current.limit(one_task_rows + 1).count() <= one_task_rows:
        return _in_one_task(current)
    nodes = current
    before = None
    for _ in range(max_rounds):
        both = current.where("u <> v").select("u", "v").union(current.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, current = current, materialize(small, "components")
        if last is not nodes:
            discard(last)
        mark = current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).head()
        mark = tuple(mark)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    everyone = nodes.select(F.col("u").alias("node")).union(nodes.select(F.col("v").alias("node"))).distinct()
    roots = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return everyone.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
