"""Restriction, set operations, membership and filters over triples.

Labels join by equality, so a triple with a null label is in no restriction and no table of known triples: inverted
restrictions and ``without_known`` keep it, others drop it. Repeated triples stay as often as they are, except in ``steps``,
``candidate_sizes`` and ``training_instances``, which take sets. Columns besides h, r and t are dropped. Empty tables give empty results; ``steps``
gives one row, whose similarity is null for an empty first table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["h", "r", "t"]


def restrict(triples: DataFrame, entities: DataFrame | None = None, relations: DataFrame | None = None, invert_entities: bool = False, invert_relations: bool = False) -> DataFrame:
    """Triples whose head and tail are (or, inverted, are not) among ``entities`` (label) and whose relation is among ``relations`` (label)."""
    out = triples
    for given, columns, invert in ((entities, "ht", invert_entities), (relations, "r", invert_relations)):
        if given is not None:
            for c in columns:
                out = out.join(given.select(F.col("label").alias(c)), c, "left_anti" if invert else "left_semi")
    return out.select(*KEY)


def merge(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(*KEY) for t in tables])


def with_membership(triples: DataFrame, **tables: DataFrame) -> DataFrame:
    """``triples`` with a column in_<name> for every table: whether the triple is in it."""
    out = triples
    for name, table in tables.items():
        out = out.join(table.select(*KEY).distinct().withColumn(f"in_{name}", F.lit(True)), KEY, "left").na.fill(False, [f"in_{name}"])
    return out


def without_known(triples: DataFrame, known: DataFrame) -> DataFrame:
    return triples.join(known.select(*KEY), KEY, "left_anti")


def steps(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: triples in just one of the two tables, those in the first, and the similarity 1 - steps / size of the first."""
    marked = a.select(*KEY, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*KEY, F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = marked.groupBy(*KEY).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sums = each.agg(F.coalesce(F.sum((F.col("a") != F.col("b")).cast("long")), F.lit(0)).alias("steps"), F.coalesce(F.sum("a"), F.lit(0)).cast("long").alias("size"))
    return sums.select("steps", "size", (1 - F.try_divide("steps", "size")).alias("similarity"))


def known_targets(triples: DataFrame, target: str = "t") -> DataFrame:
    """Number of known targets of every pair of the other two columns (the index of a filtered evaluation)."""
    keys = [c for c in KEY if c != target]
    return triples.groupBy(*keys).agg(F.count_distinct(target).alias("targets"))


def candidate_sizes(evaluated: DataFrame, known: DataFrame, num_entities: int) -> DataFrame:
    """Candidates left for the head and for the tail of every triple once known ones are filtered; the triple itself stays."""
    every = known.select(*KEY).unionByName(evaluated.select(*KEY)).distinct()
    tails = every.groupBy("h", "r").agg(F.count("*").alias("nt"))
    heads = every.groupBy("r", "t").agg(F.count("*").alias("nh"))
    found = evaluated.join(tails, ["h", "r"]).join(heads, ["r", "t"])
    return found.select(*KEY, (F.lit(num_entities + 1) - F.col("nh")).alias("head_candidates"), (F.lit(num_entities + 1) - F.col("nt")).alias("tail_candidates"))


def training_instances(triples: DataFrame, target: str = "t") -> DataFrame:
    """Every pair with the sorted set of its targets."""
    keys = [c for c in KEY if c != target]
    return triples.groupBy(*keys).agg(F.sort_array(F.collect_set(target)).alias("targets"))
