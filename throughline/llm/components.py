"""Connected components of a distributed edge list, by alternating star steps.

A large-star step links every neighbour of a node that is larger than the node to the least node
around it; a small-star step does so with the smaller neighbours and the node itself. Both keep
the components, and their alternation ends with a star around each component's least node after
a number of rounds that grows with the logarithm of its size. Each round is written to the
checkpoint folder; nothing but the number of changed edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from throughline.session import cut


def _rehung(pairs: DataFrame, least: DataFrame, keep) -> DataFrame:
    return pairs.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _rehung(both, least, F.col("v") > F.col("u")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (_rehung(down, least, F.col("v") != F.col("m"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges` (u, v: long): the least node that it reaches.

    Loops and repeated edges are allowed; an edge with a null end is ignored; an empty edge list
    gives an empty result.
    """
    now = cut(edges.filter("u is not null and v is not null and u != v").select("u", "v").distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        new = cut(small_star(large_star(now)))
        same = new.count() == now.count() and new.join(now, ["u", "v"], "left_anti").isEmpty()
        now = new
        if same:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
