"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dizin.llm.common import forget, written


def _minima(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "minima")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``links(a, b)``; the component is its smallest node.

    Links are undirected and may repeat; self links and null ends do not count. Nodes without a link
    are not returned. Each round joins links with one minimum per node, both read from written
    tables, so a hub's rows can be split among tasks; no group is ever gathered. The number of
    rounds grows with the logarithm of the longest chain.
    """
    edges = written(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minima(both)
        large = written(
            both.hint("merge").join(least, "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .filter("u <> v")
            .distinct(),
            "large",
        )
        forget(least)
        least = _minima(large)
        small = large.hint("merge").join(least, "u").select("u", "v", "m")
        stars = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct(),
            "stars",
        )
        now = stars.agg(F.count("*"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first()
        forget(least), forget(large), forget(edges)
        edges = stars
        if now == state or now[0] == 0:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
