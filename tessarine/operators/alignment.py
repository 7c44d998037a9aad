"""Union of two graphs under an alignment (left, right) of their entities.

Pairs with a null end align nothing, repeated pairs count once, and an entity may stand in several pairs. Repeated triples stay; a null label makes
a null label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components


def _sided(triples: DataFrame, side: str) -> DataFrame:
    return triples.select(*(F.concat(F.lit(f"{side}:"), F.col(c)).alias(c) for c in ("h", "r", "t")))


def disjoint_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return _sided(left, "left").unionByName(_sided(right, "right"))


def _pairs(alignment: DataFrame) -> DataFrame:
    return alignment.select(F.concat(F.lit("left:"), F.col("left")).alias("left"), F.concat(F.lit("right:"), F.col("right")).alias("right")).distinct()


def same_as_union(left: DataFrame, right: DataFrame, alignment: DataFrame) -> DataFrame:
    """The union and a triple (left, same-as, right) for each aligned pair."""
    return disjoint_union(left, right).unionByName(_pairs(alignment).select(F.col("left").alias("h"), F.lit("same-as").alias("r"), F.col("right").alias("t")))


def swap_union(left: DataFrame, right: DataFrame, alignment: DataFrame) -> DataFrame:
    """The union and copies of its triples with an aligned head, or tail, replaced by its partner."""
    both, pairs = disjoint_union(left, right), _pairs(alignment)
    map_ = pairs.select(F.col("left").alias("a"), F.col("right").alias("b")).unionByName(pairs.select(F.col("right").alias("a"), F.col("left").alias("b")))
    heads = both.join(map_, both.h == map_.a).select(F.col("b").alias("h"), "r", "t")
    tails = both.join(map_, both.t == map_.a).select("h", "r", F.col("b").alias("t"))
    return both.unionByName(heads).unionByName(tails)


def collapse_union(left: DataFrame, right: DataFrame, alignment: DataFrame) -> DataFrame:
    """The union with aligned entities merged into the least of their component."""
    both = disjoint_union(left, right)
    map_ = connected_components(_pairs(alignment), "left", "right")
    m = lambda c: map_.select(F.col("node").alias(c), F.col("component").alias(f"{c}_to"))
    found = both.join(m("h"), "h", "left").join(m("t"), "t", "left")
    return found.select(F.coalesce("h_to", "h").alias("h"), "r", F.coalesce("t_to", "t").alias("t"))
