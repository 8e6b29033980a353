"""Connected components of a link table, in DataFrames, by alternating star contractions.

Each round hangs every node's larger neighbours on the least node it knows (large star), then
every node and its smaller neighbours on the least of these (small star). Rounds are written to
the shared folder, so the lineage stays short and a lost executor costs one round at most. The
number of rounds grows with the logarithm of the longest chain. Nodes are never gathered per
hub: minima are combined before the shuffle and joined back, and Spark splits skewed joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link to another one; root is the least node reachable, itself included.

    edges may hold repeats, both directions, links of a node to itself and nulls (both ignored).
    """
    x, y = F.col(a), F.col(b)
    now = written(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        after = written(_small_star(_large_star(now)), "links")
        was, state, now = state, _state(after), after
        if state == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a[i], b[i]) among n local nodes as at most n - 1 links (node, least node of its component)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    hung = np.flatnonzero(label != np.arange(n))
    return hung, label[hung]
