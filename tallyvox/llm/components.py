"""Connected components of a link table that no task or driver holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.session import materialize, release


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reachable.

    Large-star and small-star steps alternate until the links are stars around the smallest
    nodes. Both are a minimum per node, combined before the shuffle, and an equi-join, which
    adaptive execution splits at hubs. Each round is cut with a reliable checkpoint; runs jobs
    when called. Links of a node to itself and null ends are ignored.

    With `rounds`, only so many are made: nodes of one component are reachable from each other, but
    a group of many steps may still be several components.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    if rounds is not None:
        for _ in range(rounds):
            edges = materialize(_small_star(_large_star(materialize(edges))))
        edges = edges.groupBy("a").agg(F.min("b").alias("b"))
    else:
        edges = materialize(edges)
        state = _state(edges)
        while True:
            edges = materialize(_small_star(_large_star(edges)))
            release(edges.sparkSession)
            now = _state(edges)
            if now == state:
                break
            state = now
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots if rounds is None else roots.join(members, "node", "left_anti"))
