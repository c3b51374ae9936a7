"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored

#: Links of one written file, about.
PER_FILE = 500_000


#: Links of a node that make it hot, at least; and how many nodes can be hot, as each takes that share of the links' ends.
LEAST, HOT = 1000, 50_000
#: Links beyond which nodes are joined by a shuffle only: by the size of compressed files Spark would broadcast them all.
BY_SHUFFLE = 100_000


def _with_low(edges: DataFrame, low: DataFrame, links: int) -> DataFrame:
    """The edges (u, v) with the row (k, m, n) of low whose k is u; n is how many edges have it, at most.

    A node may have most of the links. The rows of such hot nodes, HOT at most, are broadcast; the others are joined by a shuffle.
    """
    here = F.col("u") == F.col("k")
    if links <= LEAST:
        return edges.join(low, here)
    rest_of = lambda df: df.hint("merge") if links > BY_SHUFFLE else df
    many = max(LEAST, 2 * links // HOT)
    if (hot := low.where(F.col("n") > many)).isEmpty():
        return edges.join(rest_of(low), here)
    held = edges.join(F.broadcast(hot), here, "left")
    rest = held.where("k is null").select("u", "v").join(rest_of(low.where(F.col("n") <= many)), here)
    return held.where("k is not null").unionByName(rest)


def _state(edges: DataFrame) -> tuple[int, int]:
    n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return n, int(total or 0)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node of its component.

    Each step is two groupings with partial aggregates and two joins; links are never gathered in one place, nor those of a
    node. Links with a null end and from a node to itself are passed over; without links there are no rows.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct()
    edges = stored(spark, edges, "edges")
    now, before = _state(edges), None
    while now != before and now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.count("*").alias("n")).select("k", F.least("k", "m").alias("m"), "n")
        large = _with_low(both.where("v > u"), low, now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_low(large, low, now[0]).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()
        edges = stored(spark, small, "edges", files=1 + now[0] // PER_FILE)  # a step makes no more links than there are
        before, now = now, _state(edges)
    # Each node but the roots has one link now, to its root.
    of = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return of.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
