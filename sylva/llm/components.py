"""Connected components of an edge table: ties inside tasks first, alternating star contractions between them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.runtime import discard, materialize, ship_package

#: Edges that a task is given to tie, and how many it holds at once (16 bytes each, and some copies of them).
TASK_EDGES, HELD_EDGES = 500_000, 1_000_000
#: A node with more than this part of all edges is hot; there are at most twice as many hot nodes as the part goes into 1.
HOT_PART, HOT_LEAST = 1000, 1000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, of nodes 0 to n - 1 with edges between a[i] and b[i]."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        open_ = x != y
        if not open_.any():
            return up
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = up[up]
            if (above == up).all():
                break
            up = above


def _tie(edges: DataFrame) -> DataFrame:
    """a, b: for each part of a partition its nodes with the smallest node that they are tied to there."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            up = roots(at[: len(a)], at[len(a) :], len(nodes))
            leaf = up != np.arange(len(nodes))
            return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[up[leaf]])], ["a", "b"])

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            if sum(len(h[0]) for h in held) >= HELD_EDGES:
                yield flush()
        if held:
            yield flush()

    return edges.mapInArrow(stars, "a long, b long")


def _large_star(e: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of its neighbours and itself.

    The edges of hot nodes meet the few rows of these by a broadcast, so that no task takes all edges of one node.
    """
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"), "n")
    hot = F.col("n") > max(HOT_LEAST, n // HOT_PART)
    up, few = both.filter("b > a"), F.broadcast(least.filter(hot).select("node", "m"))
    cold = up.join(few.select("node"), F.col("a") == F.col("node"), "left_anti").join(least.filter(~hot), F.col("a") == F.col("node"))
    return cold.unionByName(up.join(few, F.col("a") == F.col("node")), allowMissingColumns=True).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
    tied = e.join(least, F.col("a") == F.col("node"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether each node is tied to one root and no root to another."""
    left, right = e.select(F.col("a").alias("x"), "b"), e.select(F.col("b").alias("x"), F.lit(None).cast("long").alias("b"))
    nodes = left.unionByName(right).groupBy("x").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max(F.col("b").isNull()).alias("root"))
    return not nodes.agg(F.max(F.col("low").isNotNull() & (F.col("root") | (F.col("low") < F.col("high")))).alias("more")).first().more


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``edges`` (a, b: long). Loops are ignored.

    Tasks tie their own edges first, which leaves an edge a node and task, and again in as few tasks as these edges need;
    if they need more than one, a large and a small star move ties between tasks, and so on until nothing is left to move.
    The lineage is cut in every round by a table in the shared folder; the number of rounds grows with the logarithm of
    the number of tasks.
    """
    ship_package(edges.sparkSession)
    # distinct by partial sums: a point that many blocks tie to one other has one edge
    e = materialize(_tie(edges.filter("a <> b").select("a", "b").distinct()), "edges")
    for _ in range(rounds):
        n = e.count()
        stars = materialize(_tie(e.coalesce(max(1, math.ceil(n / TASK_EDGES)))), "stars")
        discard(e)
        e = stars
        if n <= TASK_EDGES or _is_forest_of_stars(e):
            break
        e = materialize(_small_star(_large_star(stars, n)), "edges")
        discard(stars)
    else:
        raise RuntimeError("the components have not settled")
    # one row for a node that several tasks tied to the same root
    return e.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
