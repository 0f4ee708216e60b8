"""Connected components of an edge table, by alternating star contraction.

Each round links every larger neighbour of a node to the node's smallest
neighbour, then every smaller one too; components become stars around their
smallest node in a logarithmic number of rounds. A node's neighbours are never
gathered: rounds are a min() per node, pre-aggregated before its shuffle, and a
join. Every round is written to the shared folder.

Up to FEW edges (a bound, not a share of the input) stay in one partition, where
the same plan needs no shuffle; more are dealt out. Components that are known
already are contracted first, so links that come later cost their own number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import FileStore, materialize, release, scratch

#: Edges of 16 bytes that one task contracts.
FEW = 10_000


def _large_star(edges: DataFrame, how: str) -> DataFrame:
    """how: the join, where all edges are in one partition."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.coalesce(1) if how else both
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least.hint(how) if how else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, how: str) -> DataFrame:
    """Edges have a > b: a node's smaller neighbours, and itself, go to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.hint(how) if how else least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    found = moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b")
    return (found.coalesce(1) if how else found).distinct()


def _state(edges: DataFrame) -> tuple[int, object]:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, path: str | None = None) -> DataFrame:
    """edges (a, b), any order, may repeat -> (node, root) for every node that isn't its own root. path: a folder to work in."""
    spark = edges.sparkSession
    root = path or scratch(spark, "components")
    files = FileStore(spark, root)
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{root}/0")
    k, state = 0, _state(now)
    while state[0]:
        k += 1
        how = "merge" if state[0] <= FEW else ""
        # Large stars are written, as the next step reads them twice.
        large = _large_star(now.coalesce(1) if how else now, how)
        if how:
            step = materialize(_small_star(large, how), f"{root}/{k}")
        else:
            step = materialize(_small_star(materialize(large, f"{root}/{k}-large"), how), f"{root}/{k}")
            files.delete(f"{root}/{k}-large")
        files.delete(f"{root}/{k - 1}")
        now, before = step, state
        state = _state(now)
        release(spark)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def joined(roots: DataFrame, more: DataFrame, path: str | None = None) -> DataFrame:
    """roots (node, root), as components() returns them, after more edges (a, b)."""
    path = path or scratch(roots.sparkSession, "components")
    ends = more.select("a", "b").distinct()
    for c in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    new = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), path)
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(moved.unionByName(new), f"{path}/joined")
