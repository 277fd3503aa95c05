"""Connected components of an edge table by alternating large and small stars.

Each round is two joins with per-vertex minima; its edges are written to the shared folder, so lineage stays short and a lost executor costs one
round. A vertex with very many edges is safe: minima are partial aggregates, written before the join, so that they are broadcast while Spark knows
them to be small, and beyond that the hot partition of edges is split (Spark splits none beside an aggregate of the same exchange). Nothing but a
count and a checksum of a round reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .storage import release, remove, written


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(vertex, component) for every vertex with an edge to another vertex; component is the smallest vertex reachable.

    ``edges`` has columns a and b of one orderable type. Loops, repeated edges and edges in either direction do no harm; rows with a null end are
    left out; without edges the result is empty. It raises if ``rounds`` rounds don't suffice (a path of n vertices takes about log n).
    """
    spark = edges.sparkSession
    clean = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now, path = written(clean, "edges")
    state = _checksum(now)
    for _ in range(rounds):
        if not state[0]:
            break
        stars, at = _large_star(now)
        moved, via = written(stars, "edges")
        remove(spark, path, at)
        stars, at = _small_star(moved)
        nxt, to = written(stars, "edges")
        remove(spark, via, at)
        release(spark)
        now, path, before, state = nxt, to, state, _checksum(nxt)
        if state == before:
            break
    else:
        raise RuntimeError(f"components need more than {rounds} rounds")
    # now every edge joins a vertex b to its component's smallest vertex a
    found = now.select(F.col("b").alias("vertex"), F.col("a").alias("component"))
    return found.union(now.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    got = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return got["n"], got["s"]


def _large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """Every vertex joins its larger neighbours to the smallest vertex of its neighbourhood. Also the path of the minima that it reads."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, at = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).withColumn("m", F.least("v", "m")), "minima")
    # the larger neighbours of v are the b of the ordered edges (v, b)
    return edges.join(least, edges["a"] == least["v"]).select(F.col("m").alias("a"), F.col("b")).distinct(), at


def _small_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """Every vertex joins its smaller neighbours and itself to the smallest of them. Also the path of the minima that it reads."""
    least, at = written(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("m")), "minima")
    moved = edges.join(least, edges["b"] == least["v"]).where("a != m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = least.select(F.col("m").alias("x"), F.col("v").alias("y"))
    return moved.union(own).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a != b").distinct(), at


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between numbers, as index arrays: each end joined to the smallest end of its component, so never more links than ends."""
    if not len(a):
        return a, b
    n = int(max(a.max(), b.max())) + 1
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    ends = np.unique(np.concatenate((a, b)))
    ends = ends[label[ends] != ends]
    return ends, label[ends]
