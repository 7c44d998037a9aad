"""Counts, relation patterns, cardinalities, functionality, leakage and sampling statistics of triples.

The counts, ``functionality``'s divisor, ``inverse_frequency`` and ``pair_weights`` take every row, repeated ones too; patterns,
injectivity, similarities and sampling statistics take triples once. Null labels are a label of their own in counts and
take part in no pattern, similarity or join. Ties are broken by name where one of several is chosen. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import dropped, staged
from .components import connected_components


def relation_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("r").agg(F.count("*").alias("count"))


def _ends(triples: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("h").alias("entity"), F.lit("head").alias("position")), F.struct(F.col("t").alias("entity"), F.lit("tail").alias("position"))))
    return triples.select("r", ends.alias("x")).select("r", "x.entity", "x.position")


def entity_counts(triples: DataFrame) -> DataFrame:
    return _ends(triples).groupBy("entity", "position").agg(F.count("*").alias("count"))


def entity_relation_counts(triples: DataFrame) -> DataFrame:
    return _ends(triples).groupBy("entity", "r", "position").agg(F.count("*").alias("count"))


def functionality(triples: DataFrame) -> DataFrame:
    """Distinct heads (tails) over triples of every relation. Two levels of counts, so no set is gathered."""
    heads = triples.groupBy("r", "h").agg(F.count("*").alias("n")).groupBy("r").agg(F.sum("n").alias("n"), F.count("h").alias("heads"))
    tails = triples.select("r", "t").distinct().groupBy("r").agg(F.count("t").alias("tails"))
    return heads.join(tails, "r").select("r", (F.col("heads") / F.col("n")).alias("functionality"), (F.col("tails") / F.col("n")).alias("inverse_functionality"))


def injectivity(triples: DataFrame) -> DataFrame:
    """Share of heads with one tail and of tails with one head, and how many heads and tails support it."""
    pairs = triples.select("h", "r", "t").distinct()
    side = lambda key, name: pairs.groupBy("r", key).agg((F.count("*") == 1).alias("one")).groupBy("r").agg(F.count("*").alias(f"n_{name}"), F.avg(F.col("one").cast("double")).alias(name))
    found = side("h", "head_injective").join(side("t", "tail_injective"), "r")
    return found.select("r", (F.col("n_head_injective") + F.col("n_tail_injective")).alias("support"), F.col("head_injective"), F.col("tail_injective"))


def cardinality_types(triples: DataFrame) -> DataFrame:
    """Confidence of each cardinality type of a relation, zero ones left out."""
    x = injectivity(triples)
    a, b = F.col("tail_injective"), F.col("head_injective")
    kinds = [("one-to-one", a * b), ("one-to-many", a * (1 - b)), ("many-to-one", (1 - a) * b), ("many-to-many", (1 - a) * (1 - b))]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("relation_type"), c.alias("confidence")) for k, c in kinds)))
    return x.select("r", "support", each.alias("x")).select("r", "support", "x.relation_type", "x.confidence").where("confidence > 0")


def symmetry(triples: DataFrame) -> DataFrame:
    """Support and confidence of symmetry and anti-symmetry of every relation."""
    pairs = triples.select("h", "r", "t").distinct()
    back = pairs.select(F.col("t").alias("h"), "r", F.col("h").alias("t"), F.lit(1).alias("hit"))
    sums = pairs.join(back, ["h", "r", "t"], "left").groupBy("r").agg(F.count("*").alias("support"), F.count("hit").alias("hits"))
    share = F.col("hits") / F.col("support")
    kinds = F.explode(F.array(F.struct(F.lit("symmetry").alias("pattern"), share.alias("confidence")), F.struct(F.lit("anti-symmetry").alias("pattern"), (1 - share).alias("confidence"))))
    return sums.select("r", "support", kinds.alias("x")).select("r", "x.pattern", "support", "x.confidence")


def inversion(triples: DataFrame) -> DataFrame:
    """For ordered pairs of different relations that share a reversed pair: share of the first's pairs whose reverse the second holds."""
    pairs = triples.select("h", "r", "t").distinct()
    back = pairs.select(F.col("t").alias("h"), F.col("h").alias("t"), F.col("r").alias("inverse"))
    hits = pairs.join(back, ["h", "t"]).where("r <> inverse").groupBy("r", "inverse").agg(F.count("*").alias("hits"))
    return hits.join(relation_counts(pairs).withColumnRenamed("count", "support"), "r").select("r", "inverse", "support", (F.col("hits") / F.col("support")).alias("confidence"))


def composition(triples: DataFrame, at_once: int = 100_000_000, in_task: int = 3_000_000) -> DataFrame:
    """Confidence of r1(x, y), r2(y, z) => r(x, z), by distinct ends (x, z) of two-step paths; rules without a hit are left out.

    Two-step paths far outnumber triples, so they are never rows: (x, y) meets y's tails as lists of ids, which go to the task of x and a range of z
    and are told apart there, some ``in_task`` a task. Starts x are taken in as many rounds as leave some ``at_once`` paths in each, whose shuffle files go with it.
    """
    from .encode import encode, entity_dictionary, relation_dictionary

    spark = triples.sparkSession
    entities, relations = staged(entity_dictionary(triples)), staged(relation_dictionary(triples))
    edges = staged(encode(triples, entities, relations).select(*(F.col(c).cast("long").alias(c) for c in "hrt")))
    n, n_r = entities.count(), relations.count()
    dropped(entities)
    far = F.shiftright("t", 16).alias("part")
    # dealt first, so that rows are shuffled and not parts of lists; edges are distinct
    dealt = edges.select(F.col("h").alias("y"), F.col("r").alias("r2"), far, "t").repartition("y", "r2", "part")
    lists = staged(dealt.groupBy("y", "r2", "part").agg(F.collect_list("t").alias("z")))
    steps = edges.groupBy(F.col("t").alias("y")).agg(F.count("*").alias("n")).join(edges.groupBy(F.col("h").alias("y")).agg(F.count("*").alias("m")), "y")
    paths = steps.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    rounds = max(1, -(-paths // at_once))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-paths // (rounds * in_task)))
    n_bits, code_bits = max(1, n.bit_length()), (n_r * n_r + n_r).bit_length()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, xs = [], None
        for batch in batches:
            z = batch.column("z")
            size = pc.list_value_length(z).to_numpy()
            held.append((np.repeat(batch.column("x").to_numpy(), size), z.flatten().to_numpy(), np.repeat(batch.column("code").to_numpy(), size)))
        if not held:
            return
        x, z, code = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        if 2 * n_bits + code_bits > 62:
            xs, x = np.unique(x, return_inverse=True)
        keys = np.sort((x << (n_bits + code_bits)) | (z << code_bits) | code)
        if not len(keys):
            return
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
        ends, code = keys >> code_bits, keys & ((1 << code_bits) - 1)
        direct = code >= n_r * n_r
        pairs, sums = np.unique(code[~direct], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.full(len(pairs), -1)), pa.array(sums)], names=["pair", "r", "n"])
        # each triple meets the paths between its ends, which lie beside it
        path_ends, path_code = ends[~direct], code[~direct]
        low, high = (np.searchsorted(path_ends, ends[direct], side=s) for s in ("left", "right"))
        many = high - low
        r = np.repeat(code[direct] - n_r * n_r, many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        found, sums = np.unique(path_code[at] * n_r + r, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found // max(1, n_r)), pa.array(found % max(1, n_r)), pa.array(sums)], names=["pair", "r", "n"])

    total = None
    for k in range(rounds):
        mine = edges.where(F.pmod("h", F.lit(rounds)) == k)
        ways = mine.select(F.col("h").alias("x"), F.col("r").alias("r1"), F.col("t").alias("y")).join(lists, "y").select("x", (F.col("r1") * n_r + F.col("r2")).alias("code"), "part", "z")
        own = mine.select(F.col("h").alias("x"), (F.col("r") + n_r * n_r).alias("code"), far, F.array("t").alias("z"))
        sums = ways.unionByName(own).repartition(tasks, "x", "part").mapInArrow(count, "pair long, r long, n long")
        sums = staged(sums.groupBy("pair", "r").agg(F.sum("n").alias("n")))
        total = sums if total is None else total.unionByName(sums)
    total = staged(total.groupBy("pair", "r").agg(F.sum("n").alias("n")))
    dropped(lists)
    dropped(edges)
    support = total.where("r < 0").select("pair", F.col("n").alias("support"))
    name = lambda c: relations.select(F.col("label").alias(c), F.col("id").cast("long").alias(f"{c}_id"))
    found = total.where("r >= 0").withColumnRenamed("r", "r_id").join(support, "pair").withColumn("r1_id", F.expr(f"pair div {max(1, n_r)}")).withColumn("r2_id", F.col("pair") % max(1, n_r))
    for c in ("r1", "r2", "r"):
        found = found.join(name(c), f"{c}_id")
    return found.select("r1", "r2", "r", "support", (F.col("n") / F.col("support")).alias("confidence"))


def skyline(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group that no other row with at least the support and confidence beats (support, confidence de-duplicated)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("support"), F.desc("confidence")).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("confidence").over(w)
    return rows.select(*keys, "support", "confidence").distinct().withColumn("best", best).where("best is null or confidence > best").drop("best")


def pattern_types(triples: DataFrame, least_support: int = 1, least_confidence: float = 0.0) -> DataFrame:
    """Every pattern that a relation takes part in as its conclusion: r, pattern (symmetry, anti-symmetry, inversion, composition), support and confidence of its best rule, with enough of both."""
    one = symmetry(triples).select("r", "pattern", "support", "confidence")
    two = inversion(triples).select(F.col("inverse").alias("r"), F.lit("inversion").alias("pattern"), "support", "confidence")
    three = composition(triples).select("r", F.lit("composition").alias("pattern"), "support", "confidence")
    every = one.unionByName(two).unionByName(three).where((F.col("support") >= least_support) & (F.col("confidence") >= least_confidence) & (F.col("confidence") > 0))
    best = every.groupBy("r", "pattern").agg(F.max(F.struct("confidence", "support")).alias("x"))
    return best.select("r", "pattern", F.col("x.support").alias("support"), F.col("x.confidence").alias("confidence"))


def graph_info(triples: DataFrame) -> DataFrame:
    """One row: distinct triples, entities and relations."""
    pairs = triples.select("h", "r", "t").distinct()
    ends = pairs.select(F.explode(F.array("h", "t")).alias("e")).agg(F.count_distinct("e").alias("entities"))
    return pairs.agg(F.count("*").alias("triples"), F.count_distinct("r").alias("relations")).crossJoin(ends)


def jaccard(triples: DataFrame, reverse: bool = False) -> DataFrame:
    """Jaccard similarity of the pair sets of two relations that share a pair (the second's pairs reversed, if so asked)."""
    pairs = triples.select("h", "r", "t").distinct()
    size = relation_counts(pairs)
    other = pairs.select(F.col("t").alias("h"), F.col("h").alias("t"), F.col("r").alias("r2")) if reverse else pairs.select("h", "t", F.col("r").alias("r2"))
    hits = pairs.withColumnRenamed("r", "r1").join(other, ["h", "t"]).where("r1 <> r2").groupBy("r1", "r2").agg(F.count("*").alias("hits"))
    found = hits.join(size.select(F.col("r").alias("r1"), F.col("count").alias("n1")), "r1").join(size.select(F.col("r").alias("r2"), F.col("count").alias("n2")), "r2")
    return found.select("r1", "r2", (F.col("hits") / (F.col("n1") + F.col("n2") - F.col("hits"))).alias("similarity"))


def leaking_relations(triples: DataFrame, threshold: float = 0.97) -> DataFrame:
    """Relations that are near copies or near inverses of a kept one: of each component, all but the one with the most pairs (ties: the first)."""
    near = jaccard(triples).unionByName(jaccard(triples, reverse=True)).where(F.col("similarity") >= threshold)
    parts = connected_components(near.select(F.col("r1").alias("src"), F.col("r2").alias("dst")))
    sized = parts.join(relation_counts(triples).withColumnRenamed("r", "node"), "node")
    nth = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("count"), "node"))
    return sized.withColumn("nth", nth).where("nth > 1").select(F.col("node").alias("r"), "component", "count")


def bernoulli(triples: DataFrame) -> DataFrame:
    """Tails per head, heads per tail and the probability to corrupt the head, for every relation."""
    pairs = triples.select("h", "r", "t").distinct()
    tph = pairs.groupBy("r", "h").agg(F.count("*").alias("n")).groupBy("r").agg(F.avg("n").alias("tph"))
    hpt = pairs.groupBy("r", "t").agg(F.count("*").alias("n")).groupBy("r").agg(F.avg("n").alias("hpt"))
    return tph.join(hpt, "r").select("r", "tph", "hpt", (F.col("tph") / (F.col("tph") + F.col("hpt"))).alias("head_probability"))


def pseudo_types(triples: DataFrame) -> DataFrame:
    """How many entities each relation takes as heads and as tails: the pools of pseudo-typed corruption."""
    ends = _ends(triples).distinct()
    return ends.groupBy("r").agg(F.count(F.when(F.col("position") == "head", 1)).alias("heads"), F.count(F.when(F.col("position") == "tail", 1)).alias("tails"))


def inverse_frequency(triples: DataFrame) -> DataFrame:
    return relation_counts(triples).select("r", (1 / F.col("count")).alias("weight"))


def pair_weights(triples: DataFrame, target: str = "t") -> DataFrame:
    """Every triple's weight 1 / frequency of its pair, so that each pair counts once in macro averages."""
    keys = [c for c in ("h", "r", "t") if c != target]
    n = triples.groupBy(*keys).agg(F.count("*").alias("n"))
    return triples.join(n, keys).select("h", "r", "t", (1 / F.col("n")).alias("weight"))


def triple_set_hash(triples: DataFrame) -> DataFrame:
    """One row: a hash of the set of triples that doesn't depend on their order, from sums of row hashes, and their number."""
    rows = triples.select("h", "r", "t").distinct().select(F.md5(F.concat_ws("\t", "h", "r", "t")).alias("m"))
    part = lambda a: F.sum(F.conv(F.substring("m", a, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), *((part(a) % F.lit(2**32)).cast("long").alias(f"h{i}") for i, a in enumerate((1, 9, 17, 25))))
