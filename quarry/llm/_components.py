"""Connected components of an edge table, by rounds of joins over written tables that shrink the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import discard, spool


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of links (a, b): comp is the smallest node that they reach.

    Each round hangs every node on its neighbour of least rank, a hash of the node, unless its own is less, and puts the
    neighbour in its place in all edges.  Ranks are as good as random, so a fixed share of the nodes goes in each round
    and the rounds are few, on long paths too.  Joins have written tables on both sides: Spark can split a node of many edges.
    """
    start = edges = spool(links.filter("a <> b").select(*_ordered("a", "b")).distinct(), "edges")
    ups = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("rank"), "b")).alias("x"))
        up = spool(least.filter(F.struct("x.rank", "x.b") < F.struct(F.xxhash64("a").alias("rank"), F.col("a").alias("b"))).select(F.col("a").alias("node"), F.col("x.b").alias("up")), "up")
        ups.append(up)
        one, two = (up.select(F.col("node").alias(k), F.col("up").alias(f"{k}_up")) for k in ("a", "b"))
        moved = edges.join(one, "a", "left").join(two, "b", "left").select(*_ordered(F.coalesce("a_up", "a"), F.coalesce("b_up", "b")))
        last, edges = edges, spool(moved.filter("a <> b").distinct(), "edges")
        if last is not start:
            discard(last)
    roots = start.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    for up in ups:
        roots = roots.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    roots = spool(roots, "roots")
    names = spool(roots.groupBy("root").agg(F.min("node").alias("comp")), "names")
    out = spool(roots.join(names, "root").select("node", "comp"), "labels")
    discard(start, *([edges] if edges is not start else []), roots, names, *ups)
    return out
