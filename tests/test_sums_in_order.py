import math

from pyspark.sql import functions as F

from tessarine.operators import ranking


def test_geometric_mean_expects_what_sums_in_order_give(spark):
    """A plain sum of 100,000 powers close to 1 loses places, which the query must lose like its SQL."""
    m = 400_000
    rows = spark.range(m).select(F.lit("tail").alias("side"), F.lit("realistic").alias("rank_type"), (F.col("id") % 50 + 1).alias("rank"), (F.lit(100_000) + F.col("id") % 2).alias("candidates"))
    total, at = 0.0, {}
    for k in range(1, 100_002):
        total += k ** (1 / m)
        at[k] = total / k
    e = math.exp(m / 2 * (math.log(at[100_000]) + math.log(at[100_001])))
    gm = math.exp(sum(math.log(k) for k in range(1, 51)) / 50)
    got = {x: {r.metric: r.value for r in ranking.all_metrics(rows, in_order=x).where("side = 'tail'").collect()} for x in (True, False)}
    name = "adjusted_geometric_mean_rank_index"
    want = (gm - e) / (1 - e)
    assert abs(got[True][name] / want - 1) < 1e-13
    assert abs(got[False][name] / want - 1) > 1e-13
    # the z-score's variance is a small difference of such sums
    assert got[True].keys() == got[False].keys() and all(math.isclose(got[True][k], v, rel_tol=1e-9) for k, v in got[False].items() if k != "z_geometric_mean_rank")


def test_sizes_of_several_shares(spark):
    rows = [(1, 0.5), (7, 0.5), (7, 1e-3), (300, 1e-3), (None, 0.5), (0, 0.5)]
    got = {(r.n, r.share): (r.g1, r.g2) for r in ranking.log_means_in_order(spark.createDataFrame(rows, "n long, share double")).collect()}
    assert got.keys() == set(rows)
    for (n, share), found in got.items():
        want = tuple(math.log(sum(k ** (i * share) for k in range(1, n + 1)) / n) for i in (1, 2)) if n else (None, None)
        assert found == want or all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-15) for a, b in zip(found, want, strict=True))
