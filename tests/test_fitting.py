import numpy as np
import pytest
from pyspark.sql import functions as F

from tessarine.models import engine, fitting, tape
from tessarine.models.fitting import Trainer
from tessarine.models.objectives import loss_of
from tessarine.models.tape import Value
from tessarine.operators import ranking


def graph(spark, n=24):
    rows = [(i, i % 2, (i + 1 + i % 2) % n) for i in range(n)] + [(i, 2, (5 * i) % n) for i in range(0, n, 3)]
    return spark.createDataFrame(rows + rows[:3], "h long, r long, t long").repartition(3), n, rows


def gathered(found, kind, n, width):
    out = np.zeros((n, width))
    for r in found.where(F.col("kind") == kind).collect():
        out[r.id] += r.g
    return out


def vectors(model):
    return ({r.id: np.array(r.v) for r in t.collect()} for t in (model.entities, model.relations))


@pytest.mark.parametrize("name, loss", [("distmult", "infonce"), ("ermlp", "bce"), ("transe_l2", "margin_ranking")])
def test_sampled_gradients_are_those_of_the_whole_loss(spark, name, loss):
    triples, n, rows = graph(spark)
    rows = sorted(set(rows))
    model = engine.created(name, spark.range(n), spark.range(3), 4, seed=3)
    trainer = Trainer(loss=loss, negatives=3)
    samples = fitting.staged(fitting.sampled(triples.distinct(), "basic", 3, n, 7))
    negatives = {}
    for s in samples.collect():
        negatives.setdefault((s.h, s.r, s.t), {})[s.j] = (s.other, s.r, s.t) if s.on_head else (s.h, s.r, s.other)
        assert s.other != (s.h if s.on_head else s.t) and 0 <= s.other < n
    e, r = vectors(model)
    E, R = Value(np.array([e[i] for i in range(n)]), True), Value(np.array([r[i] for i in range(3)]), True)
    w = {k: Value(x, True) for k, x in model.weights.items()}
    at = lambda x: [np.array([p[i] for p in x]) for i in range(3)]
    h, q, t = at(rows)
    positive = model.form(E[h], R[q], E[t], w, model.dims)
    h, q, t = at([negatives[x][j] for x in rows for j in range(3)])
    negative = model.form(E[h], R[q], E[t], w, model.dims).reshape(len(rows), 3)
    total = loss_of(loss, positive, negative)
    total.backward()
    terms = {"infonce": 1, "bce": 4, "margin_ranking": 3}[loss]
    found = fitting.staged(fitting.pair_gradients(model, triples.distinct(), samples, trainer, 1 / (len(rows) * terms), terms))
    assert np.allclose(gathered(found, 0, n, E.shape[1]), E.grad) and np.allclose(gathered(found, 1, 3, R.shape[1]), R.grad)
    for x in fitting._weight_rows(found):
        if x.kind == 3:
            assert np.isclose(x.g[0], total.x)
        else:
            assert np.allclose(x.g, list(w.values())[x.id].grad.ravel())


@pytest.mark.parametrize("loss, smoothing", [("bce", 0.0), ("bce", 0.1), ("mse", 0.0), ("cross_entropy", 0.0)])
@pytest.mark.parametrize("side", ["h", "t"])
def test_gradients_of_all_candidates(spark, loss, smoothing, side):
    triples, n, rows = graph(spark)
    model = engine.created("complex", spark.range(n), spark.range(3), 4, seed=5)
    e, r = vectors(model)
    E, R = Value(np.array([e[i] for i in range(n)]), True), Value(np.array([r[i] for i in range(3)]), True)
    fixed = [0, 1] if side == "t" else [2, 1]
    pairs = sorted({(x[fixed[0]], x[1]) for x in rows})
    labels = np.array([[((a, b, c) if side == "t" else (c, b, a)) in set(rows) for c in range(n)] for a, b in pairs], float)
    one, q = (np.array(x)[:, None] for x in zip(*pairs, strict=True))
    every = np.arange(n)[None]
    scores = model.form(E[one if side == "t" else every], R[q], E[every if side == "t" else one], {}, model.dims)
    if loss == "cross_entropy":
        y = labels / labels.sum(1, keepdims=True)
        total = (tape.log_sum_exp(scores) - (scores * y).sum(-1)).sum()
    else:
        y = (1 - smoothing) * labels + smoothing / (n - 1) * (1 - labels)
        total = fitting.LOSSES[loss].terms(scores, y).sum()
    total.backward()
    found = fitting.staged(fitting.all_gradients(model, triples, side, Trainer(loss=loss, smoothing=smoothing), 1.0, n))
    assert np.allclose(gathered(found, 0, n, 8), E.grad) and np.allclose(gathered(found, 1, 3, 8), R.grad)
    assert np.isclose(sum(x.g[0] for x in found.where("kind = 3").collect()), total.x)


def test_merge_updates_every_vector_once(spark):
    rng = np.random.default_rng(2)
    n, width = 400, 3
    v = rng.normal(size=(n, width))
    g = [(int(i), rng.normal(size=width).tolist()) for i in rng.integers(0, n + 50, 900)]
    zero = [0.0] * width
    table = spark.createDataFrame([(i, v[i].tolist(), zero, zero) for i in range(n)], "id long, v array<double>, a array<double>, b array<double>")
    grads = spark.createDataFrame(g, "id long, g array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.id: np.array(r.v) for r in fitting.merged(table, grads, width, Trainer(optimizer="sgd"), 0.5, 1).collect()}
        adam = {r.id: r for r in fitting.merged(table, grads, width, Trainer(clip_norm=1.0), 0.1, 1, "unit").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sums = np.zeros((n + 50, width))
    for i, x in g:
        sums[i] += x
    assert got.keys() == set(range(n)) and all(np.allclose(got[i], v[i] - 0.5 * sums[i]) for i in range(n))
    assert all(np.isclose(np.linalg.norm(r.v), 1) for r in adam.values()) and len(adam) == n


@pytest.mark.parametrize("options", [{}, {"sampler": "bernoulli", "loss": "nssa", "loss_settings": {"margin": 2.0}}, {"sampler": "pseudo_typed", "loss": "bce", "optimizer": "adagrad", "rate": 0.1}, {"batches": 2, "penalties": {"lp": 0.001}, "schedule": fitting.exponential(0.9)}])
def test_training_lowers_the_loss(spark, options):
    triples, n, _ = graph(spark)
    model = engine.created("transe", spark.range(n), spark.range(3), 8, seed=1)
    seen = []
    trained, losses = fitting.train(model, triples, Trainer(negatives=4, rate=0.05) if not options else Trainer(**({"negatives": 4, "rate": 0.05} | options)), 4, listeners=(lambda epoch, loss, m: seen.append(epoch),))
    assert seen == [0, 1, 2, 3] and losses[-1] < losses[0] and trained.entities.count() == n and trained.entities.columns == ["id", "v"]


def test_training_against_all_candidates_and_shared_weights(spark):
    triples, n, _ = graph(spark)
    model = engine.created("proje", spark.range(n), spark.range(3), 6, seed=1)
    trained, losses = fitting.train(model, triples, Trainer(loss="mse", rate=0.05), 4, "all", ("h", "t"))
    assert losses[-1] < losses[0] and not np.allclose(trained.weights["head"], model.weights["head"])
    _, losses = fitting.train(model, triples, Trainer(), 5, listeners=(lambda *a: True,))
    assert len(losses) == 1
    assert fitting.loss_on(model, triples, Trainer()) > 0
    assert fitting.train(model, triples.where("false"), Trainer(), 1)[1] == [0.0]
    with pytest.raises(ValueError):
        fitting.train(model, triples, Trainer(loss="nssa"), 1, "all")


def test_positions(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, i * 37 % 101) for i in range(300)]
    got = ranking.positions(spark.createDataFrame(rows, "k string, i long, o long"), ["k"], ["o", "i"]).collect()
    want = {}
    for k, i, o in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        want[k, i] = sum(1 for x in want if x[0] == k)
    assert {(r.k, r.i): r.place for r in got} == want


def test_entities_of_tokens_are_trained_through_them(spark):
    triples, n, _ = graph(spark)
    tokens = spark.createDataFrame([(i, t) for i in range(n) for t in {i % 5, 5 + i % 3, 8 + i % 7}], "id long, token long")
    vocabulary = engine.initial(spark.range(15), 6, 4)
    model = engine.created("distmult", spark.range(n), spark.range(3), 6, seed=1)
    trained, losses = fitting.train(model, triples, Trainer(loss="bce", negatives=4, rate=0.05), 5, tokens=tokens, vocabulary=vocabulary)
    assert losses[-1] < losses[0] and trained.vocabulary.count() == 15
    v = {r.id: np.array(r.v) for r in trained.vocabulary.collect()}
    made = {}
    for r in tokens.collect():
        made.setdefault(r.id, []).append(v[r.token])
    assert all(np.allclose(r.v, np.mean(made[r.id], axis=0)) for r in trained.entities.collect())
    # entities that training never saw have vectors by their tokens
    from tessarine.operators.messages import token_vectors

    new = token_vectors(spark.createDataFrame([(99, 1), (99, 6)], "id long, token long"), trained.vocabulary, 6).first()
    assert np.allclose(new.v, (v[1] + v[6]) / 2)
    g = spark.createDataFrame([(0, [3.0] * 6), (1, [6.0] * 6)], "id long, g array<double>")
    sums = {}
    for r in fitting.to_tokens(g, tokens).collect():
        sums[r.id] = sums.get(r.id, 0) + r.g[0]
    assert sums == {0: 1.0, 1: 2.0, 5: 1.0, 6: 2.0, 8: 1.0, 9: 2.0}
