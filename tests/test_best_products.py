import numpy as np
from pyspark.sql import functions as F

from tessarine.models import engine
from tessarine.models.engine import Model
from tessarine.operators import prediction


def _table(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")


def test_best_products_of_several_blocks_and_ties(spark):
    rng = np.random.default_rng(3)
    e, r = rng.normal(size=(90, 6)), rng.normal(size=(5, 6))
    e[40:60] = e[0]  # copies: many triples tie
    e[7] = 0
    model = Model("distmult", {"d": 6}, _table(spark, e).repartition(3), _table(spark, r))
    scores = engine.Model("distmult", {"d": 6}, None, None).scorer()(e[:, None, None], r[None, :, None], e[None, None])
    for k in (1, 30, 500):
        for few in (5, 2):
            want = sorted((-s, h, q, t) for (h, q, t), s in np.ndenumerate(scores[:, :few]))[:k]
            wanted = prediction._best_products(model, k, model.relations.where(F.col("id") < few), "h long, r long, t long, score double", rows=16, some=10)
            got = [(-x.score, x.h, x.r, x.t) for x in wanted.orderBy(F.desc("score"), "h", "r", "t").limit(k).collect()]
            assert [x[1:] for x in got] == [x[1:] for x in want] and np.allclose([x[0] for x in got], [x[0] for x in want])
    assert [tuple(x)[:3] for x in prediction.predict_all(model, 30).collect()] == [x[1:] for x in sorted((-s, h, q, t) for (h, q, t), s in np.ndenumerate(scores))[:30]]
    assert prediction.predict_all(Model("distmult", {"d": 6}, model.entities.where("false"), model.relations), 3).count() == 0
    every = prediction.predict_all(Model("distmult", {"d": 6}, model.entities.where("id < 3"), model.relations), 1000)
    assert every.count() == 45
