"""Ranks of true triples among filtered candidates, and metrics of ranks.

Every row is a rank, repeated ones too; null ranks are left out. Undefined values (no rows, a divisor of zero) are null, and an empty table gives
no rows. Ties of scores part the optimistic from the pessimistic rank; their mean is the realistic one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def ranks_from_scores(scores: str = "scores", true: str = "true"):
    """Struct of optimistic, pessimistic, realistic rank and options, of a true score among an array that holds it; NaN scores don't count."""
    valid = F.filter(scores, lambda s: ~F.isnan(s))
    above = F.size(F.filter(valid, lambda s: s > F.col(true)))
    not_below = F.size(F.filter(valid, lambda s: s >= F.col(true)))
    return F.struct((above + 1).alias("optimistic"), not_below.alias("pessimistic"), ((above + 1 + not_below) / 2).alias("realistic"), F.size(valid).alias("options"))


def monotone_ranks(ids: DataFrame, num_entities: int) -> DataFrame:
    """Filtered ranks and candidates of every id triple, for tails and heads, under a score that grows with the predicted id.

    With distinct scores the rank is 1 + greater candidates that aren't known: the place among each pair's known ones instead
    of a row for every candidate. Repeated triples each have a place; null ids have no rank.
    """
    n = F.lit(num_entities)
    sides = []
    for side, keys, c in (("tail", ["h", "r"], "t"), ("head", ["r", "t"], "h")):
        # places from above by ranges, so that a pair of a hot relation and entity is no single task's
        placed = positions(ids.select("h", "r", "t", (-F.col(c)).alias("below")), keys, ["below"], "known_above")
        size = ids.groupBy(*keys).agg(F.count("*").alias("known"))
        sides.append(placed.join(size, keys).select("h", "r", "t", F.lit(side).alias("side"), (n - F.col(c) - F.col("known_above")).alias("rank"), (n - F.col("known") + 1).alias("candidates")))
    return sides[0].unionByName(sides[1])


def metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 10), weight: str | None = None) -> DataFrame:
    """Metrics by side and over both ('both'): count, mean rank, reciprocal rank, hits, and those adjusted for chance.

    Sums of all are made in one pass by grouping sets. ``weight``: a column of weights for macro averages.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    harmonic = F.log("candidates") + F.lit(0.5772156649015329) + 1 / (2 * F.col("candidates")) - 1 / (12 * F.col("candidates") * F.col("candidates"))
    rows = ranks.select(
        "side", w.alias("w"), F.col("rank").cast("double").alias("rank"), ((F.col("candidates") + 1) / 2).alias("expected"),
        (harmonic / F.col("candidates")).alias("expected_rr"), *(F.least(F.lit(1.0), F.lit(float(k)) / F.col("candidates")).alias(f"expected_{k}") for k in ks),
    )
    mean = lambda c: F.sum(c * F.col("w")) / F.sum("w")
    sums = rows.groupingSets([["side"], []], "side").agg(
        F.count("*").alias("count"), mean(F.col("rank")).alias("mean_rank"), mean(1 / F.col("rank")).alias("mrr"), F.exp(mean(F.log("rank"))).alias("geometric_mean_rank"),
        (F.sum("w") / F.sum(F.col("w") / F.col("rank"))).alias("harmonic_mean_rank"), mean(F.col("expected")).alias("e"), mean(F.col("expected_rr")).alias("err"),
        *(mean((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in ks), *(mean(F.col(f"expected_{k}")).alias(f"e{k}") for k in ks), F.grouping_id().alias("g"),
    )
    adjusted = [((F.col(f"hits_{k}") - F.col(f"e{k}")) / (1 - F.col(f"e{k}"))).alias(f"adjusted_hits_{k}") for k in ks]
    return sums.select(
        F.when(F.col("g") == 1, "both").otherwise(F.col("side")).alias("side"), "count", "mean_rank", "mrr", "geometric_mean_rank", "harmonic_mean_rank", *(f"hits_{k}" for k in ks),
        (F.col("mean_rank") / F.col("e")).alias("adjusted_mean_rank"), (1 - (F.col("mean_rank") - 1) / (F.col("e") - 1)).alias("adjusted_mean_rank_index"),
        ((F.col("mrr") - F.col("err")) / (1 - F.col("err"))).alias("adjusted_mrr"), *adjusted,
    )


def marginal_scores(triples: DataFrame) -> DataFrame:
    """Marginal baseline of every known (h, r, t): p(t | h) p(t | r), normalised over the tails with a score above zero for (h, r)."""
    by_h = triples.groupBy("h", "t").agg(F.count("*").alias("n")).withColumn("ph", F.col("n") / F.sum("n").over(Window.partitionBy("h"))).drop("n")
    by_r = triples.groupBy("r", "t").agg(F.count("*").alias("n"))
    size = by_r.groupBy("r").agg(F.sum("n").alias("all"))
    by_r = by_r.join(size, "r").select("r", "t", (F.col("n") / F.col("all")).alias("pr"))
    pairs = triples.select("h", "r").distinct()
    found = pairs.join(by_h, "h").join(by_r, ["r", "t"])
    total = F.sum(F.col("ph") * F.col("pr")).over(Window.partitionBy("h", "r"))
    return found.select("h", "r", "t", (F.col("ph") * F.col("pr") / total).alias("score"))


def soft_inverse_scores(triples: DataFrame, least: float = 0.0) -> DataFrame:
    """(h, r, t, score): for every pair of ends that some triple has, how much relations alike to ``r`` speak for it.

    A triple (h, s, t) speaks for (h, r, t) by the Jaccard similarity of the pairs of r and s, and for (t, r, h) by that of the pairs of r
    and the turned pairs of s; sums over all s but r itself. Similarities of ``least`` or less don't speak. Repeated triples speak once.
    """
    from .analysis import jaccard

    pairs = triples.select("h", "r", "t").distinct()
    same = jaccard(triples).where(F.col("similarity") > least).select(F.col("r1").alias("to"), F.col("r2").alias("r"), "similarity")
    turned = jaccard(triples, reverse=True).where(F.col("similarity") > least).select(F.col("r1").alias("to"), F.col("r2").alias("r"), "similarity")
    # one row a pair of relations that are alike: few
    ahead = pairs.join(same, "r").select("h", F.col("to").alias("r"), "t", "similarity")
    back = pairs.join(turned, "r").select(F.col("t").alias("h"), F.col("to").alias("r"), F.col("h").alias("t"), "similarity")
    return ahead.unionByName(back).groupBy("h", "r", "t").agg(F.sum("similarity").alias("score"))


def positions(rows: DataFrame, keys: list[str], order: list[str], place: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, among those of the same ``keys`` in the order of columns ``order``. Places come from ranges of keys and order, so a hot key is no single task's."""
    ranged = staged(rows.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)), F.col("part").alias("of"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    within = ranged.withColumn("within", F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order)) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"key_{i}")) for i, k in enumerate(keys)]
    joined = within.join(starts, (F.col("part") == F.col("of")) & reduce(Column.__and__, same))
    return joined.select(*rows.columns, (F.col("start") + F.col("within")).cast("long").alias(place))


def medians(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, median) of ``value``, weighted or not; the mean of the two middle values where half of the weight lies on either side.

    Equal values meet in one row first; running weights are made by ranges of values, so no task or buffer holds a whole group.
    """
    w = F.col(weight) if weight else F.lit(1).cast("long")
    levels = rows.select(*keys, F.col(value).cast("double").alias("x"), w.alias("w")).groupBy(*keys, "x").agg(F.sum("w").alias("w"))
    levels = staged(levels.repartitionByRange(*keys, "x").withColumn("part", F.spark_partition_id()))
    parts = levels.groupBy(*keys, "part").agg(F.sum("w").alias("pw"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "part", F.coalesce(F.sum("pw").over(before), F.lit(0)).alias("start"), F.sum("pw").over(Window.partitionBy(*keys)).alias("total"))
    inner = Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = levels.withColumn("within", F.sum("w").over(inner)).join(parts, [*keys, "part"]).withColumn("twice", 2 * (F.col("start") + F.col("within")))
    at = lambda c: F.min(F.when(c, F.col("x")))
    return placed.groupBy(*keys).agg(((at(F.col("twice") >= F.col("total")) + at(F.col("twice") > F.col("total"))) / 2).alias("median"))


def dispersion(ranks: DataFrame) -> DataFrame:
    """Median, population variance and standard deviation, and the scaled median absolute deviation of ranks, by side."""
    middle = staged(medians(ranks, ["side"], "rank").withColumnRenamed("median", "median_rank"))
    by_side = ranks.groupBy("side").agg(F.var_pop("rank").alias("variance"), F.stddev_pop("rank").alias("standard_deviation")).join(middle, "side")
    off = ranks.join(middle, "side").select("side", F.abs(F.col("rank") - F.col("median_rank")).alias("off"))
    spread = medians(off, ["side"], "off").select("side", (F.col("median") / 0.6745).alias("mad"))
    return by_side.join(spread, "side").select("side", "median_rank", "variance", "standard_deviation", "mad")


def power_sum(n: str, p: str, exact: int = 256) -> Column:
    """The sum of k to the power p for k from 1 to n: the first terms one by one, the rest by the Euler-Maclaurin formula, exact to a double's places."""
    m = f"least({n}, {exact}L)"
    head = f"aggregate(sequence(1L, {m}), 0D, (a, k) -> a + power(k, {p}))"
    whole = f"if({p} = -1D, ln({n} / {m}), (power({n}, {p} + 1) - power({m}, {p} + 1)) / if({p} = -1D, 1D, {p} + 1))"
    first = f"{p} * (power({n}, {p} - 1) - power({m}, {p} - 1)) / 12"
    third = f"{p} * ({p} - 1) * ({p} - 2) * (power({n}, {p} - 3) - power({m}, {p} - 3)) / 720"
    return F.expr(f"{head} + if({n} <= {exact}, 0D, {whole} + (power({n}, {p}) - power({m}, {p})) / 2 + {first} - {third})")


def log_mean_power(n: str, p: str, exact: int = 256) -> Column:
    """The logarithm of the mean of k to the power p for k from 1 to n; by sums of k to the power p less one, so that tiny powers keep their places."""
    m = f"least({n}, {exact}L)"
    less = lambda x: f"expm1({p} * ln({x}))"
    head = f"aggregate(sequence(1L, {m}), 0D, (a, k) -> a + {less('k')})"
    area = lambda x: f"{x} * ({less(x)} - {p}) / ({p} + 1)"
    first = f"{p} * (power({n}, {p} - 1) - power({m}, {p} - 1)) / 12"
    third = f"{p} * ({p} - 1) * ({p} - 2) * (power({n}, {p} - 3) - power({m}, {p} - 3)) / 720"
    return F.expr(f"log1p(({head} + if({n} <= {exact}, 0D, {area(n)} - {area(m)} + ({less(n)} - {less(m)}) / 2 + {first} - {third})) / {n})")


def log_means_in_order(sizes: DataFrame) -> DataFrame:
    """Sizes (n, share, ...) with the columns g1 and g2 of ``log_mean_power`` for share and twice share, from powers that are added one by one from k = 1.

    Plain sums lose the last places as a plain SQL sum does. All sizes of one share are read off one sweep; they are distinct counts, so few.
    """

    def run(table: pa.Table) -> pa.Table:
        n, share = table.column("n").to_numpy(), table.column("share")[0].as_py()
        most, totals, found = int(n.max()), [0.0, 0.0], [np.zeros(len(n)), np.zeros(len(n))]
        for at in range(1, most + 1, 1 << 20):
            k = np.arange(at, min(at + (1 << 20), most + 1), dtype=np.float64)
            mine = np.flatnonzero((n >= at) & (n < at + len(k)))
            for i, p in enumerate((share, 2 * share)):
                # a cumulative sum adds in order
                sums = np.cumsum(np.append(totals[i], k**p))
                found[i][mine] = np.log(sums[n[mine] - at + 1] / n[mine])
                totals[i] = sums[-1]
        return pa.table({"n": table.column("n"), "share": table.column("share"), "g1": pa.array(found[0]), "g2": pa.array(found[1])})

    each = sizes.select("n", "share").where("n > 0").distinct().groupBy("share").applyInArrow(run, "n long, share double, g1 double, g2 double")
    return sizes.join(each, ["n", "share"], "left")


def all_metrics(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), weight: str | None = None, in_order: bool = False) -> DataFrame:
    """Every rank metric by side (and over both) and rank type: side, rank_type, metric, value.

    ``rows``: side, rank_type, rank, candidates, and a column of weights if ``weight`` names one. What random ranks would give is in closed form:
    a metric's expectation adjusts it and its variance gives the z-score (larger is better). Rows of no candidates but the true one count
    with expectation one and no variance; a metric whose divisor is zero is null. Null ranks are left out. ``in_order``: what random ranks
    would give the geometric mean comes from sums term by term, as SQL has it, with the places that those lose.
    """
    keys = ["side", "rank_type"]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = rows.where("rank is not null").select(F.explode(F.array("side", F.lit("both"))).alias("side"), "rank_type", F.col("rank").cast("double").alias("rank"), F.col("candidates").cast("long").alias("n"), w.alias("w"))
    rows = staged(rows)
    hits = [F.sum(F.when(F.col("rank") <= k, F.col("w")).otherwise(0.0)).alias(f"hit_{k}") for k in ks]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("count"), F.sum("w").alias("all_w"), F.sum(F.col("w") * F.col("rank")).alias("sr"), F.sum(F.col("w") * F.log("rank")).alias("sl"),
        F.sum(F.col("w") / F.col("rank")).alias("si"), F.sum(F.col("w") * F.col("rank") * F.col("rank")).alias("ss"), *hits,
    )
    # moments of a uniform rank among n; what follows has a row for each number of candidates and weight
    sizes = staged(rows.groupBy(*keys, "n", "w").agg(F.count("*").alias("c"))).join(sums.select(*keys, "all_w"), keys).withColumn("share", F.col("w") / F.col("all_w"))
    size, c = F.col("n").cast("double"), F.col("c")
    sizes = sizes.withColumn("h1", power_sum("n", "-1D") / size).withColumn("h2", power_sum("n", "-2D") / size)
    sizes = log_means_in_order(sizes) if in_order else sizes.withColumn("g1", log_mean_power("n", "share")).withColumn("g2", log_mean_power("n", "(2 * share)"))
    moment = lambda name, mean, variance: [F.sum(c * F.col("share") * mean).alias(f"e_{name}"), F.sum(c * F.col("share") * F.col("share") * variance).alias(f"v_{name}")]
    p = {k: F.least(F.lit(1.0), F.lit(float(k)) / size) for k in ks}
    expected = sizes.groupBy(*keys).agg(
        *moment("am", (size + 1) / 2, (size * size - 1) / 12), *moment("ih", F.col("h1"), F.col("h2") - F.col("h1") * F.col("h1")),
        *(x for k in ks for x in moment(f"hit_{k}", p[k], p[k] * (1 - p[k]))), F.exp(F.sum(c * F.col("g1"))).alias("e_gm"), F.expm1(F.sum(c * (F.col("g2") - 2 * F.col("g1")))).alias("v_gm"),
    )
    middle = staged(medians(rows, keys, "rank", "w"))
    off = rows.join(middle, keys).select(*keys, F.abs(F.col("rank") - F.col("median")).alias("off"), "w")
    spread = medians(off, keys, "off", "w").select(*keys, (F.col("median") / 0.6745).alias("mad"))
    found = sums.join(expected, keys).join(middle, keys).join(spread, keys)
    am, gm, ih, hm = F.col("sr") / F.col("all_w"), F.exp(F.col("sl") / F.col("all_w")), F.col("si") / F.col("all_w"), F.col("all_w") / F.col("si")
    variance = F.greatest(F.col("ss") / F.col("all_w") - am * am, F.lit(0.0))
    over = lambda a, b: F.when(F.abs(b) > 1e-12, a / b)
    reindexed = lambda x, e: over(x - F.col(e), 1 - F.col(e))
    z = lambda x, e, v: over(x - F.col(e), F.sqrt(F.greatest(v, F.lit(0.0))))
    values = {
        "count": F.col("count").cast("double"), "arithmetic_mean_rank": am, "inverse_arithmetic_mean_rank": 1 / am, "geometric_mean_rank": gm, "inverse_geometric_mean_rank": 1 / gm,
        "harmonic_mean_rank": hm, "inverse_harmonic_mean_rank": ih, "median_rank": F.col("median"), "inverse_median_rank": 1 / F.col("median"), "variance": variance, "standard_deviation": F.sqrt(variance),
        "median_absolute_deviation": F.col("mad"), "adjusted_arithmetic_mean_rank": over(am, F.col("e_am")), "adjusted_arithmetic_mean_rank_index": reindexed(am, "e_am"), "z_arithmetic_mean_rank": -z(am, "e_am", F.col("v_am")),
        "adjusted_geometric_mean_rank_index": reindexed(gm, "e_gm"), "z_geometric_mean_rank": -z(gm, "e_gm", F.col("v_gm") * F.col("e_gm") * F.col("e_gm")),
        "adjusted_inverse_harmonic_mean_rank": reindexed(ih, "e_ih"), "z_inverse_harmonic_mean_rank": z(ih, "e_ih", F.col("v_ih")),
    }
    for k in ks:
        share = F.col(f"hit_{k}") / F.col("all_w")
        values |= {f"hits_at_{k}": share, f"adjusted_hits_at_{k}": reindexed(share, f"e_hit_{k}"), f"z_hits_at_{k}": z(share, f"e_hit_{k}", F.col(f"v_hit_{k}"))}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items())))
    return found.select(*keys, each.alias("x")).select(*keys, "x.metric", "x.value")


def z_scores(ranks: DataFrame, k: int = 10) -> DataFrame:
    """Mean rank and hits at k less their expectations for random ranks, in standard errors (larger is better), by side."""
    n, p = F.col("candidates").cast("double"), F.least(F.lit(1.0), F.lit(float(k)) / F.col("candidates"))
    sums = ranks.groupBy("side").agg(
        F.sum((n + 1) / 2 - F.col("rank")).alias("d"), F.sum((n * n - 1) / 12).alias("v"), F.sum((F.col("rank") <= k).cast("double") - p).alias("dh"), F.sum(p * (1 - p)).alias("vh")
    )
    return sums.select("side", (F.col("d") / F.sqrt("v")).alias("z_mean_rank"), (F.col("dh") / F.sqrt("vh")).alias("z_hits"))


def bootstrap(ranks: DataFrame, rounds: int = 20, seed: int = 0) -> DataFrame:
    """Mean reciprocal rank of resamples: each row counts as often as a Poisson draw of mean 1 says, which hashes make repeatable."""
    u = F.pmod(F.xxhash64(F.lit(seed), "h", "r", "t", "side", "round"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    bounds, p, total = [], 0.36787944117144233, 0.0
    for i in range(1, 9):
        total += p
        bounds.append(total)
        p /= i
    times = sum((F.when(u >= b, 1).otherwise(0) for b in bounds[1:]), F.when(u >= bounds[0], 1).otherwise(0))
    each = ranks.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("times", times)
    return each.groupBy("round").agg((F.sum(F.col("times") / F.col("rank")) / F.sum("times")).alias("mrr"))
