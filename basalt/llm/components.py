"""Connected components of an edge table by alternating large and small stars, and of arrays in a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import cut

MOST_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: the greater ones, else the smaller ones and itself) moved to its least neighbour."""
    least = edges.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
    joined = edges.join(least, F.col("a") == F.col("k"))
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b).

    Nothing is gathered: a hub's least neighbour is an aggregate, and the join on hubs is one that skew handling can split.
    Each round leaves fewer edges; their number of rounds grows with the logarithm of the longest path.
    """
    state = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        state = cut(_stars(_stars(both, large=True), large=False))
        new = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    nodes = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the classes of a[i] and b[i] in place; a label is the least index of its class."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label[:] = jump
