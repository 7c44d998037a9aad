import numpy as np
from pyspark.sql import functions as F

from tessarine.models import engine, fitting
from tessarine.models.engine import Model


def _table(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")


def test_dense_gradients_are_rows_of_parts_not_of_pairs_of_blocks(spark):
    """600 queries and 700 entities in blocks of 8 rows make 6,600 pairs of blocks; a block's rows were written with each."""
    rng = np.random.default_rng(4)
    n = 700
    triples = spark.createDataFrame([(i, 0, int(t)) for i, t in enumerate(rng.integers(0, n, 600))], "h long, r long, t long")
    e, r = rng.normal(size=(n, 4)), rng.normal(size=(2, 4))
    model = Model("distmult", {"d": 4}, _table(spark, e), _table(spark, r))
    queries = engine.with_vectors(triples.select("h", "r").withColumn("n", F.lit(1.0)), model, "hr")
    seeds = lambda x, _: (float(x.sum()), np.cos(x))
    got = fitting._dense(model, queries, "t", seeds, ["n"], n, query_rows=8, entity_rows=8).collect()
    assert len(got) < 20 * n
    s = (e[:600] * r[0]) @ e.T
    g = np.cos(s)
    want = g.T @ (e[:600] * r[0])
    want[:600] += g @ e * r[0]
    sums = np.zeros((n, 4))
    for x in got:
        if x.kind == 0:
            sums[x.id] += x.g
    assert np.allclose(sums, want)
    assert np.allclose(sum(np.array(x.g) for x in got if x.kind == 1), (g @ e * e[:600]).sum(0))
    assert np.isclose(sum(x.g[0] for x in got if x.kind == 3), s.sum())
