import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessarine.models.engine import Model
from tessarine.operators import prediction
from tessarine.plans import catalog, model_catalog  # noqa: F401 - the second adds its queries to the first


def _table(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")


def _best(e, r, k):
    """Ids of the k best triples by brute force, ties by ids."""
    scores = Model("distmult", {"d": e.shape[1]}, None, None).scorer()(e[:, None, None], r[None, :, None], e[None, None])
    h, q, t = np.indices(scores.shape).reshape(3, -1)
    order = np.lexsort((t, q, h, -scores.ravel()))[:k]
    return [tuple(map(int, x)) for x in zip(h[order], q[order], t[order], strict=True)]


def _found(model, k, **sizes):
    top = prediction._best_products(model, k, model.relations, "h long, r long, t long, score double", **sizes)
    return [tuple(x)[:3] for x in top.orderBy(F.desc("score"), "h", "r", "t").limit(k).collect()]


def test_query_has_all_relations(spark, tmp_path):
    v = np.random.default_rng(5).normal(size=(24, 64)).astype(np.float32)
    v[17] *= 3  # the best triples have a relation that isn't among the first ten
    pq.write_table(pa.table({"vec_id": pa.array(range(24), pa.int64()), "embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * 24, pa.int64())}), tmp_path / "embeddings.parquet")
    got = [tuple(x) for x in catalog.QUERIES["predict_all"](spark, str(tmp_path)).select("h", "r", "t", "score").collect()]
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{os.path.join(tmp_path, 'embeddings.parquet')}'")
    want = con.sql(catalog.ORACLES["predict_all"]).fetchall()
    wide = v.astype(float)
    assert [x[:3] for x in got] == [tuple(x[:3]) for x in want] == _best(wide, wide, 100)
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-6)
    assert 17 in {x[1] for x in got} and len({x[1] for x in got}) > 1


@pytest.mark.parametrize("scale", [(1.0, 1.0), (1e-60, 1.0), (1e60, 1e-30), (1.0, 1e-200)])
def test_best_products_of_many_relations_at_any_scale(spark, scale):
    rng = np.random.default_rng(11)
    e, r = rng.standard_t(3, size=(70, 8)) * scale[0], rng.standard_t(3, size=(120, 8)) * scale[1]
    r[100:110], e[30:40] = r[3], e[2]  # copies tie
    e[5], r[9] = 0, 0
    model = Model("distmult", {"d": 8}, _table(spark, e).repartition(3), _table(spark, r).repartition(5))
    for k, sizes in ((1, {}), (40, {"rows": 16, "some": 8}), (3000, {"rows": 25, "some": 70})):
        assert _found(model, k, **sizes) == _best(e, r, k)


def test_best_products_where_a_few_rows_are_far_longer(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=(40, 4))
    e[3] *= 1e50
    model = Model("distmult", {"d": 4}, _table(spark, e), _table(spark, e))
    assert _found(model, 6000, rows=16, some=5) == _best(e, e, 6000)


def test_best_products_where_all_triples_tie(spark):
    e = np.ones((45, 4))
    model = Model("distmult", {"d": 4}, _table(spark, e).repartition(4), _table(spark, e))
    assert _found(model, 60, rows=16, some=7) == _best(e, e, 60)
