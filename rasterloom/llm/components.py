"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import store

#: Links that one task reduces to a forest, about.
FOREST_LINKS = 1 << 16


def _forest(links: DataFrame, n: int) -> DataFrame:
    """Links (node, least node of its tree) with the same components, fewer than nodes in each share of the ``n`` links."""

    def run(batches: Iterable[pa.RecordBatch]):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])

    return map_arrow(links.repartition(-(-max(n, 1) // FOREST_LINKS)), run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``links(u, v)``; label is the least node reachable.

    Shares of the links are reduced to forests first, so a dense group of near copies
    enters with about as many links as nodes.  Each round is two joins with one row per
    node on one side, so a hub is split like any skewed join.  Rounds are bounded by the
    square of the logarithm of the number of nodes and in practice grow with the logarithm
    of the longest path; ``rounds`` would do for paths of 2**60 nodes, and what has not
    settled then is an error, never a partial result.  Edges are written to the shared
    folder between rounds.  Self-links are allowed; no links, no rows.
    """
    edges = store.written(links.select("u", "v").distinct(), "links")
    found = edges.count()
    forest = store.written(_forest(edges, found).distinct(), "links")
    store.discard(edges)
    edges = forest
    before = None
    for _ in range(rounds):
        edges_next = store.written(_small_star(_large_star(edges).union(edges.where("u = v")).distinct()).distinct(), "links")
        mark = edges_next.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.discard(edges)
        edges = edges_next
        if before == mark:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return edges.where("u != v").select(F.col("u").alias("node"), F.col("v").alias("label"))
