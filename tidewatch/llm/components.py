"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scratch import save


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every end of the edges ``a, b``; equal roots mean connected.

    Every round points each node to the neighbour of least random rank (itself, if it is the
    least), then replaces edges by those between the nodes pointed to.  Ranks are drawn anew
    in each round, so a constant share of the nodes drops out whatever the shape of the graph,
    and the number of rounds grows with the logarithm of the number of nodes.  Each round is
    written out.  A hub's edges are aggregated before the shuffle, and joins read written
    tables on both sides, so that adaptive execution can split a hub.  No edges: no rows.
    """
    edges = save(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    pointers = []
    while not pointers or not edges.isEmpty():
        turn = len(pointers)
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("rank"), F.col(c).alias("node"))
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        least = both.groupBy("node").agg(F.min(rank("other")).alias("least"))
        pointed = save(least.select("node", F.least(F.col("least"), rank("node"))["node"].alias("parent")), "pointers")
        pointers.append(pointed)
        left = edges.join(pointed.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        both_ends = left.join(pointed.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        moved = both_ends.filter("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = save(moved.distinct(), "edges")
    found = pointers[0].select("node", F.col("parent").alias("root"))
    for pointed in pointers[1:]:
        later = pointed.select(F.col("node").alias("root"), "parent")
        found = found.join(later, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    return found


def smallest_member(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` and the smallest ``first`` in its component, for ``members`` with unique ``node``; edges are ``a, b``."""
    rooted = members.join(components(edges), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    rooted = save(rooted, "rooted")
    least = save(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")
    return rooted.join(least, "root").select("node", F.col("least").alias("first"))
