"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import dropped, staged


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """One row (node, component) for every node that an edge names; component is its smallest reachable node.

    Each round links every larger neighbour of a node to the smallest node it sees, then every smaller one
    (Kiveris et al., Connected Components in MapReduce and Beyond). The edges never grow in number, all
    work is joins and aggregates with map-side combining, and each round's edges are a table in the shared
    folder, so lost executors cost one round at most. Loops and null ends are ignored but a loop still
    names its node. An empty table gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = pairs.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    links = staged(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(least, large.u == least.n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = staged(small.select("e.u", "e.v").where("u <> v").distinct())
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        dropped(links)
        links = new
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    found = stars.unionByName(roots)
    return found.unionByName(nodes.join(found, "node", "left_anti").distinct())
