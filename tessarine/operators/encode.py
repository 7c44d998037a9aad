"""Dictionary encoding, decoding, condensing and inverse triples.

Null labels have no id, and triples with one are dropped on encoding. Repeated triples are one after ``encode`` and stay in the
other functions. Empty tables give empty dictionaries and results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

INVERSE = "_inverse"


def dense_ids(values: DataFrame, column: str, name: str = "id") -> DataFrame:
    """Distinct values of a column with dense ids in their order.

    Sorted by ranges, so no task holds all of them: ids are places within a range plus the sizes of those before.
    """
    ranged = staged(values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    first = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    inner = ranged.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1)
    return inner.join(first, "part").select(column, (F.col("first") + F.col("place")).cast("long").alias(name))


def entity_dictionary(triples: DataFrame) -> DataFrame:
    """(label, id) of all heads and tails, ids dense in code-point order."""
    return dense_ids(triples.select(F.col("h").alias("label")).unionByName(triples.select(F.col("t").alias("label"))), "label")


def relation_dictionary(triples: DataFrame) -> DataFrame:
    """(label, id) of all relations; an inverse relation comes right after its own."""
    suffix = F.col("r").endswith(INVERSE)
    own = F.when(suffix, F.expr(f"substring(r, 1, length(r) - {len(INVERSE)})")).otherwise(F.col("r"))
    keyed = triples.select(F.struct(own.alias("own"), suffix.alias("inverse"), F.col("r").alias("label")).alias("key"))
    return dense_ids(keyed, "key").select("key.label", "id")


def encode(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct triples as ids; those with an unknown label go."""
    e = lambda c: entities.select(F.col("label").alias(c), F.col("id").alias(f"{c}_id"))
    r = relations.select(F.col("label").alias("r"), F.col("id").alias("r_id"))
    found = triples.join(e("h"), "h").join(r, "r").join(e("t"), "t")
    return found.select(F.col("h_id").alias("h"), F.col("r_id").alias("r"), F.col("t_id").alias("t")).distinct()


def decode(ids: DataFrame, entities: DataFrame, relations: DataFrame, unknown: str = "[UNKNOWN]") -> DataFrame:
    """Id triples with their labels; ids without one get ``unknown``."""
    e = lambda c: entities.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    r = relations.select(F.col("id").alias("r"), F.col("label").alias("r_label"))
    found = ids.join(e("h"), "h", "left").join(r, "r", "left").join(e("t"), "t", "left")
    return found.select("h", "r", "t", *(F.coalesce(f"{c}_label", F.lit(unknown)).alias(f"{c}_label") for c in "hrt"))


def with_inverses(ids: DataFrame) -> DataFrame:
    """(h, 2r, t) and (t, 2r + 1, h) of every triple."""
    pair = F.array(F.struct("h", (F.col("r") * 2).alias("r"), "t"), F.struct(F.col("t").alias("h"), (F.col("r") * 2 + 1).alias("r"), F.col("h").alias("t")))
    return ids.select(F.explode(pair).alias("x")).select("x.h", "x.r", "x.t")


def condense(ids: DataFrame, relations: bool = False) -> DataFrame:
    """Triples with the entity ids (and relation ids) that occur renumbered densely in their order."""
    e = dense_ids(ids.select(F.col("h").alias("old")).unionByName(ids.select(F.col("t").alias("old"))), "old", "new")
    out = ids.join(e.select(F.col("old").alias("h"), F.col("new").alias("nh")), "h").join(e.select(F.col("old").alias("t"), F.col("new").alias("nt")), "t")
    if relations:
        out = out.join(dense_ids(ids.select(F.col("r").alias("old")), "old", "new").select(F.col("old").alias("r"), F.col("new").alias("nr")), "r")
    return out.select(F.col("nh").alias("h"), F.col("nr" if relations else "r").alias("r"), F.col("nt").alias("t"))


def reindexed(*graphs: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Several labelled graphs as ids of one dictionary of entities and one of relations, which come after them."""
    whole = graphs[0].select("h", "r", "t")
    for g in graphs[1:]:
        whole = whole.unionByName(g.select("h", "r", "t"))
    entities, relations = staged(entity_dictionary(whole)), staged(relation_dictionary(whole))
    return [encode(g, entities, relations) for g in graphs], entities, relations


def inverted(mapping: DataFrame, key: str = "label", value: str = "id") -> DataFrame:
    """A dictionary with keys and values exchanged; a value that stands for several keys raises ValueError."""
    if mapping.count() != mapping.select(value).distinct().count():
        raise ValueError("not one to one")
    return mapping.select(F.col(value).alias(key), F.col(key).alias(value))


def valid_ids(ids: DataFrame, num_entities: int, num_relations: int) -> DataFrame:
    """The triples whose ids are in range."""
    inside = lambda c, n: (F.col(c) >= 0) & (F.col(c) < n)
    return ids.where(inside("h", num_entities) & inside("t", num_entities) & inside("r", num_relations))
