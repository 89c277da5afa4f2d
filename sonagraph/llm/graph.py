"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

#: Edges that the driver joins by itself (a megabyte); more take rounds of joins.
FEW = 1 << 16


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (row[0], row[1])


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, np.concatenate([root[a], root[b]]), np.concatenate([low, low]))
        while (root != root[root]).any():
            root = root[root]
    return nodes, nodes[root]


def components(edges: DataFrame, *done: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (u, v, longs): the smallest node
    reachable.  Up to ``few`` edges are joined on the driver.  Of more, each round rewires neighbours to
    the smallest one seen, so the rounds follow the logarithm of the longest path; groupings are
    pre-aggregated, joins are by node.

    Raises if ``max_rounds`` pass without a fixed point.  The result is a scratch table; ``done`` are
    those that nothing reads after the first round."""
    edges = edges.where("u <> v")
    if edges.count() <= few:
        held = edges.select("u", "v").toArrow()
        nodes, least = least_reachable(*(held.column(k).to_numpy() for k in ("u", "v")))
        out = edges.sparkSession.createDataFrame(pa.table({"node": nodes, "component": least}))
        out = materialize(out, "components")
        discard(*done)
        return out
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges", *done)
    last = _signature(edges)
    for _ in range(max_rounds if last[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "edges", edges)
        now = _signature(edges)
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError("components did not settle")
    # at the fixed point every edge leads to the root
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return materialize(stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components", edges)
