"""Connected components of a graph that Spark holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b: long); component is the smallest node that can be reached.

    Large-star and small-star steps take turns until the edges no longer change; they are then stars around the
    smallest nodes. A step is a grouped minimum, combined before its shuffle, and an equi-join. No step needs the
    neighbours of a node in one place. Every round is written, so a lost executor costs one round at most.
    """
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    down = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")

    def large_star(e: DataFrame) -> DataFrame:
        n = both(e)
        least = n.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        return n.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small_star(e: DataFrame) -> DataFrame:
        n = down(e)
        least = n.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        return n.join(least, F.col("a") == F.col("u")).select("b", "m").unionAll(least.select("u", "m")).toDF("a", "b")

    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        out = materialize(down(e).distinct(), "components")
        state = out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return out, tuple(state)

    stars, before = written(edges)
    while True:
        stars, now = written(small_star(large_star(stars)))
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(stars.select("b", "b").distinct())
        before = now


def forest(x: np.ndarray, y: np.ndarray) -> list:
    """Edges, one fewer than the nodes of each part, that join what the pairs (x, y) join."""
    names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    label = np.arange(len(names))
    p, q = at[: len(x)], at[len(x) :]
    while True:
        low = label.copy()
        m = np.minimum(label[p], label[q])
        np.minimum.at(low, p, m)
        np.minimum.at(low, q, m)
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(int(names[k]), int(names[label[k]])) for k in np.flatnonzero(label != np.arange(len(names)))]
