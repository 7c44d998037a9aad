"""Ranks of true triples among all, filtered or sampled candidates under a model, and their evaluation.

Candidates exclude the true entity: the optimistic rank is one more than the candidates with a greater score, the pessimistic
one more than those with a score as great, the realistic their mean. Filtering never lists all candidates: greater and
equal scores are counted over blocks of all entities, and those of known triples, which are scored on their own, taken off.
Scores that agree to nine places are equal.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.engine import Model, against_all, score_triples, with_vectors
from ..sources.staging import staged
from .splitting import unit_hash

PLACES = 9
_FIXED = {"h": ("r", "t"), "t": ("h", "r"), "r": ("h", "t")}
SIDES = {"head": "h", "tail": "t", "relation": "r"}


def _queries(model: Model, triples: DataFrame) -> DataFrame:
    """Distinct triples with their scores."""
    found = score_triples(model, triples.select("h", "r", "t").distinct())
    return staged(found.withColumn("score", F.round("score", PLACES)))


def _counted(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Greater and equal scores by key, of rows with ``own`` and ``score``."""
    return scores.groupBy(*keys).agg(F.sum((F.col("score") > F.col("own")).cast("long")).alias("greater"), F.sum((F.col("score") == F.col("own")).cast("long")).alias("equal"), F.count("*").alias("n"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Ranks from the counts of candidates other than the true one."""
    return rows.select("h", "r", "t", "side", (F.col("greater") + 1).alias("optimistic"), (F.col("greater") + F.col("equal") + 1).alias("pessimistic"), (F.col("greater") + F.col("equal") / 2 + 1).alias("realistic"), (F.col("n") + 1).alias("candidates"))


def ranks(model: Model, triples: DataFrame, known: DataFrame | None = None, sides: tuple[str, ...] = ("head", "tail"), restrict: DataFrame | None = None) -> DataFrame:
    """h, r, t, side, optimistic, pessimistic and realistic rank and candidates of every distinct triple.

    ``known`` (h, r, t): triples that are no candidates; ``restrict`` (id): the only candidates besides the true one. Triples of
    ids without a vector have no rank; null ids neither.
    """
    asked, out = _queries(model, triples), []
    for side in sides:
        s = SIDES[side]
        a, b = _FIXED[s]
        queries = with_vectors(asked.select("h", "r", "t", F.col("score").alias("own")), model, a + b)
        table = model.relations if s == "r" else model.entities
        candidates = table if restrict is None else table.join(restrict.select("id").distinct(), "id", "left_semi")

        def count(scores, ids, columns, s=s):
            scores, own = np.round(scores, PLACES), columns["own"][:, None]
            other = ids[None] != columns[s][:, None]
            return pa.RecordBatch.from_arrays([*(pa.array(columns[c]) for c in "hrt"), *(pa.array((x & other).sum(1)) for x in (scores > own, scores == own)), pa.array(other.sum(1))], names=[*"hrt", "greater", "equal", "n"])

        raw = against_all(model, queries, s, count, "h long, r long, t long, greater long, equal long, n long", ["h", "r", "t", "own"], candidates)
        raw = raw.groupBy("h", "r", "t").agg(*(F.sum(c).alias(c) for c in ("greater", "equal", "n")))
        if known is not None:
            other = known.select("h", "r", "t").distinct().withColumnRenamed(s, "other")
            if restrict is not None:
                other = other.join(restrict.select(F.col("id").alias("other")).distinct(), "other", "left_semi")
            pairs = asked.select("h", "r", "t", F.col("score").alias("own")).join(other, [a, b]).where(F.col("other") != F.col(s))
            # the known triple is scored in place of the true one, whose id waits beside it
            swapped = pairs.select(F.col("other").alias(s), a, b, F.col(s).alias("true"), "own")
            scored = score_triples(model, swapped).withColumn("score", F.round("score", PLACES))
            taken = _counted(scored.withColumnRenamed(s, "other").withColumnRenamed("true", s), ["h", "r", "t"])
            taken = taken.select("h", "r", "t", *(F.col(c).alias(f"known_{c}") for c in ("greater", "equal", "n")))
            raw = raw.join(taken, ["h", "r", "t"], "left").select("h", "r", "t", *((F.col(c) - F.coalesce(f"known_{c}", F.lit(0))).alias(c) for c in ("greater", "equal", "n")))
        out.append(_ranked(raw.withColumn("side", F.lit(side))))
    return reduce(DataFrame.unionByName, out)


def sampled_negatives(triples: DataFrame, entities: DataFrame, known: DataFrame, per_side: int = 50, seed: int = 0) -> DataFrame:
    """(h, r, t, side, other): for every triple and side the ``per_side`` entities that a hash puts first among those that make no known triple.

    Hash ranges propose half as many again as are needed and as the triple's known ones could take; where an entity table is too small for that, all are proposed.
    """
    n = entities.count()
    asked = triples.select("h", "r", "t").distinct()
    out = []
    for side in ("head", "tail"):
        s = SIDES[side]
        a, b = _FIXED[s]
        pool = entities.select(F.col("id").alias("other")).withColumn("at", F.floor(unit_hash("other", seed=seed) * n).cast("long"))
        size = known.groupBy(a, b).agg(F.count_distinct(s).alias("known"))
        wanted = asked.join(size, [a, b], "left").withColumn("span", F.least(F.lit(n), (per_side * 3 + 2 * F.coalesce("known", F.lit(0))).cast("long") + 20))
        start = F.floor(unit_hash("h", "r", "t", seed=seed + 1) * n).cast("long")
        places = wanted.withColumn("start", start).withColumn("at", F.explode(F.expr("sequence(0L, span - 1)"))).withColumn("at", (F.col("start") + F.col("at")) % n)
        proposed = places.join(pool, "at").where(F.col("other") != F.col(s)).select("h", "r", "t", "other")
        seen = known.select(a, b, F.col(s).alias("other")).distinct()
        free = proposed.join(seen, [a, b, "other"], "left_anti")
        from .graph import top_per_group

        best = top_per_group(free.withColumn("u", unit_hash("h", "r", "t", "other", seed=seed + 2)), ["h", "r", "t"], ["u", "other"], per_side)
        out.append(best.select("h", "r", "t", F.lit(side).alias("side"), "other"))
    return out[0].unionByName(out[1])


def sampled_ranks(model: Model, triples: DataFrame, negatives: DataFrame) -> DataFrame:
    """Ranks among given candidates (h, r, t, side, other) instead of all entities; the true entity and repeats among them don't count."""
    asked, out = _queries(model, triples).withColumnRenamed("score", "own"), []
    for side, s in SIDES.items():
        a, b = _FIXED[s]
        mine = negatives.where(F.col("side") == side).select("h", "r", "t", "other").distinct().where(F.col("other") != F.col(s))
        pairs = mine.join(asked, ["h", "r", "t"]).select(F.col("other").alias(s), a, b, F.col(s).alias("true"), "own")
        scored = score_triples(model, pairs).withColumn("score", F.round("score", PLACES))
        counted = _counted(scored.withColumnRenamed(s, "other").withColumnRenamed("true", s), ["h", "r", "t"])
        out.append(_ranked(counted.withColumn("side", F.lit(side))))
    return reduce(DataFrame.unionByName, out)


def by_type(found: DataFrame) -> DataFrame:
    """One row a rank type: h, r, t, side, rank_type, rank and candidates."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("rank_type"), F.col(k).cast("double").alias("rank")) for k in ("optimistic", "realistic", "pessimistic"))))
    return found.select("h", "r", "t", "side", "candidates", kinds.alias("x")).select("h", "r", "t", "side", "x.rank_type", "x.rank", "candidates")


def evaluate(model: Model, triples: DataFrame, known: DataFrame | None = None, sides: tuple[str, ...] = ("head", "tail"), ks: tuple[int, ...] = (1, 3, 5, 10), restrict: DataFrame | None = None) -> DataFrame:
    """Every rank metric of a model: side ('head', 'tail', 'both'), rank_type, metric, value."""
    from .ranking import all_metrics

    return all_metrics(by_type(staged(ranks(model, triples, known, sides, restrict))), ks)


def evaluate_sampled(model: Model, triples: DataFrame, known: DataFrame, entities: DataFrame, per_side: int = 50, seed: int = 0, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``evaluate`` against so many sampled negatives a side."""
    from .ranking import all_metrics

    found = sampled_ranks(model, triples, sampled_negatives(triples, entities, known, per_side, seed))
    return all_metrics(by_type(staged(found)), ks)


def labelled_scores(model: Model, triples: DataFrame, sides: tuple[str, ...] = ("head", "tail")) -> DataFrame:
    """Scores of all candidates of the distinct keys of ``triples`` with y, 1 for a true one: side, score, y. For classification metrics."""
    out = []
    for side in sides:
        s = SIDES[side]
        a, b = _FIXED[s]
        keys = with_vectors(triples.select(a, b).distinct(), model, a + b)

        def spread(scores, ids, columns, a=a, b=b):
            n, m = scores.shape
            return pa.RecordBatch.from_arrays([*(pa.array(np.repeat(columns[c], m)) for c in (a, b)), pa.array(np.tile(ids, n)), pa.array(np.round(scores.ravel(), PLACES))], names=[a, b, s, "score"])  # noqa: B023

        every = against_all(model, keys, s, spread, f"{a} long, {b} long, {s} long, score double", [a, b])
        true = triples.select("h", "r", "t").distinct().withColumn("y", F.lit(1).cast("long"))
        out.append(every.join(true, ["h", "r", "t"], "left").select(F.lit(side).alias("side"), "score", F.coalesce("y", F.lit(0).cast("long")).alias("y")))
    return reduce(DataFrame.unionByName, out)


def flat(results: DataFrame) -> dict[str, float]:
    """Metrics by key ``side.rank_type.metric``, of the few rows that an evaluation returns."""
    return {f"{r.side}.{r.rank_type}.{r.metric}": r.value for r in results.collect()}
