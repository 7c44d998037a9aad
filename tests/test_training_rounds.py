import numpy as np
from pyspark.sql import functions as F

from tessarine.operators import training
from tessarine.operators.splitting import basic_negatives


def _brute(spark, ids, n, dim, epochs, rate, seed):
    """The same steps over whole arrays."""
    rows = lambda df: np.array([list(x) for x in df.orderBy("id").select("v").toPandas()["v"]])
    ent = rows(training.initial_vectors(spark.range(n), dim, seed))
    rel_ids = sorted(x.r for x in ids.select("r").distinct().collect())
    rel = rows(training.initial_vectors(spark.createDataFrame([(r,) for r in rel_ids], "id long"), dim, seed + 1))
    losses = []
    for epoch in range(epochs):
        pos = [(x.h, x.r, x.t, 1.0) for x in ids.collect()]
        neg = [(x.h, x.r, x.t, 0.0) for x in basic_negatives(ids, n, 1, seed=seed + 2 * epoch + 2).collect()]
        h, r, t, y = (np.array(c) for c in zip(*pos, *neg, strict=True))
        h, r, t = h.astype(int), np.searchsorted(rel_ids, r), t.astype(int)
        s = (ent[h] * rel[r] * ent[t]).sum(1)
        slope = (1 / (1 + np.exp(-s)) - y)[:, None]
        losses.append(float(np.mean(np.logaddexp(0, s) - y * s)))
        ge, gr = np.zeros_like(ent), np.zeros_like(rel)
        np.add.at(ge, h, slope * rel[r] * ent[t])
        np.add.at(ge, t, slope * rel[r] * ent[h])
        np.add.at(gr, r, slope * ent[h] * ent[t])
        ce, cr = np.bincount(np.append(h, t), minlength=n), np.bincount(r, minlength=len(rel))
        ent, rel = ent - rate * ge / np.maximum(ce, 1)[:, None], rel - rate * gr / np.maximum(cr, 1)[:, None]
    return ent, rel, losses


def _graph(spark, n=300, m=900):
    rng = np.random.default_rng(7)
    rows = {(int(h), int(r) * 5 - 5, int(t)) for h, r, t in zip(rng.integers(0, n - 9, m), rng.integers(0, 4, m), rng.integers(0, n - 9, m) ** 2 % (n - 9), strict=True)}
    return spark.createDataFrame([*sorted(rows), (3, 0, 3)], "h long, r long, t long").distinct()


def test_vectors_equal_whole_arrays_whatever_the_rounds(spark):
    ids = _graph(spark)
    want = _brute(spark, ids, 300, 5, 3, 2.0, 11)
    for size in (10**9, 500):
        entities, relations, losses = training.train(ids, 300, dim=5, epochs=3, rate=2.0, seed=11, round_size=size)
        for got, whole in ((entities, want[0]), (relations, want[1])):
            assert np.allclose([x.v for x in got.orderBy("id").collect()], whole, rtol=1e-9, atol=1e-12)
        assert [x.id for x in entities.orderBy("id").collect()] == list(range(300))
        assert np.allclose(losses, want[2])


def test_messages_never_fill_the_disk_at_once(spark, monkeypatch):
    """What an epoch stages grew with its samples: rows of four vectors each. Now it is blocks of entities only, and a round sends its share of messages."""
    ids, written, sent = _graph(spark, 60, 4000), [], []
    write, send = training.staged, training._sent

    def staged(df):
        out = write(df)
        written.append((df.columns, out.count()))
        return out

    def _sent(*args):
        out = send(*args)
        sent.append(sum(len(x.code) // 4 for x in out.collect()))
        return out

    monkeypatch.setattr(training, "staged", staged)
    monkeypatch.setattr(training, "_sent", _sent)
    training.train(ids, 60, dim=4, epochs=2, round_size=2000)
    n = ids.count()
    assert all(rows <= 60 + 8 * 4 for columns, rows in written if columns != ["h", "r", "t"])
    assert sum(sent) == 2 * 4 * n and max(sent[-4:]) < 2 * n


def test_drawn_is_initial_vectors(spark):
    for seed in (0, 3, -2):
        want = training.initial_vectors(spark.range(1000).select((F.col("id") * 7919).alias("id")), 6, seed).orderBy("id").collect()
        assert np.array_equal(training.drawn(np.array([x.id for x in want]), 6, seed), [x.v for x in want])


def test_edges(spark):
    none = spark.createDataFrame([], "h long, r long, t long")
    entities, relations, losses = training.train(none, 0, dim=4, epochs=1)
    assert entities.count() == 0 and relations.count() == 0 and losses == [None]
    entities, relations, losses = training.train(none, 3, dim=4, epochs=1)
    assert {x.id: x.v for x in entities.collect()} == {x.id: x.v for x in training.initial_vectors(spark.range(3), 4, 0).collect()}
    one = spark.createDataFrame([(0, 0, 0)], "h long, r long, t long")
    entities, _, losses = training.train(one, 1, dim=4, epochs=2)
    assert entities.count() == 1 and np.isfinite(losses).all()
