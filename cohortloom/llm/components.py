"""Connected components of an edge table: distributed union-find by star contraction.

DataFrame functions only. Every round replaces the edges by stars around local
minima (large star, then small star), so the number of rounds is logarithmic in
the length of the longest path. Nothing comes to the driver but one number per
round, and each round's edges are written to the shared folder, which cuts the
lineage and survives lost executors.

A vertex of a very large component is the centre of many edges; both stars
take minima, which Spark combines before it shuffles, and send the result back
by a join, which adaptive execution may split; no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .workspace import Workspace


def _minima(edges: DataFrame) -> DataFrame:
    """For each vertex (column ``a``) the least of its neighbours and itself, ``m``."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex has one edge, to a vertex that has none of its own: then the edges are stars around roots."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, space: Workspace, name: str = "components", rounds: int = 40) -> DataFrame:
    """(``id``, ``component``) for every vertex in ``edges`` (columns ``a``, ``b``, of one comparable type).

    ``component`` is the least id that can be reached. Self-loops, repeated edges and
    either direction are allowed; nulls are ignored; no edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = space.save(e, f"{name}-0")
    for k in range(1, rounds + 1):
        if _settled(e):
            break
        # Large star: link every greater neighbour of v, to the least vertex that v knows.
        low = _minima(e)
        big = e.select(F.col("a").alias("n"), F.col("b").alias("a")).join(low, "a").select(F.col("n").alias("a"), F.col("m").alias("b"))
        big = big.unionByName(low.select("a", F.col("m").alias("b")).where("a <> b")).distinct()
        # Small star: link v, and its smaller neighbours, to the least of them.
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = space.save(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{name}-{k}")
        space.drop(f"{name}-{k - 1}")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
