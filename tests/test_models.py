import numpy as np
import pytest

from tessarine.models import engine, forms, objectives, tape
from tessarine.models.tape import Value
from tessarine.operators import evaluation, prediction

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("name", forms.FORMS)
def test_scores_broadcast_and_gradients_are_those_of_differences(name):
    form = forms.FORMS[name]
    dims = forms.dimensions(form, 8, l=3, **({"k": 4} if name in ("transr", "transd", "ntn") else {}))
    wide, narrow = form.widths(dims)
    h, r, t = RNG.normal(size=(5, wide)), RNG.normal(size=(5, narrow)), RNG.normal(size=(7, wide))
    w = {k: RNG.normal(size=s) for k, s in form.sizes(dims)[2].items()}
    run = lambda h, r, t, w, wanted=False: form(h, r, t, {k: Value(x, wanted) for k, x in w.items()}, dims)
    every = run(Value(h[:, None]), Value(r[:, None]), Value(t[None]), w)
    assert every.shape == (5, 7) and np.allclose(run(Value(h), Value(r), Value(t[:5]), w).x, np.diag(every.x[:, :5]))
    seed, t = RNG.normal(size=5), t[:5]
    values = {"h": Value(h, True), "r": Value(r, True), "t": Value(t, True)}
    weights = {k: Value(x, True) for k, x in w.items()}
    form(values["h"], values["r"], values["t"], weights, dims).backward(seed)
    arrays = {"h": h, "r": r, "t": t} | w
    for key, array in arrays.items():
        if not array.size:
            continue
        at = tuple(RNG.integers(n) for n in array.shape)
        moved = []
        for step in (1e-6, -1e-6):
            x = array.copy()
            x[at] += step
            a = arrays | {key: x}
            moved.append(float((run(Value(a["h"]), Value(a["r"]), Value(a["t"]), {k: a[k] for k in w}).x * seed).sum()))
        got = (values.get(key) or weights[key]).grad
        assert np.isclose((moved[0] - moved[1]) / 2e-6, got[at], rtol=1e-3, atol=1e-5), key


def slow_loss(name, p, n):
    sp = lambda x: np.logaddexp(0, x)
    if name in ("cross_entropy", "infonce"):
        m, s = (0, 1) if name == "cross_entropy" else (0.02, 0.05)
        return np.mean([np.log(np.exp((a - m) / s) + np.exp(b / s).sum()) - (a - m) / s for a, b in zip(p, n, strict=True)])
    if name in ("nssa", "adversarial_bce"):
        m = 9 if name == "nssa" else 0
        return np.mean([0.5 * (sp(-(a + m)) + (np.exp(b) / np.exp(b).sum() * sp(b + m)).sum()) for a, b in zip(p, n, strict=True)])
    d = n - p[:, None]
    pairs = {"margin_ranking": np.maximum(0, d + 1), "soft_margin_ranking": sp(d + 1), "pairwise_logistic": sp(d)}
    if name in pairs:
        return pairs[name].mean()
    x, y = np.concatenate([p, n.ravel()]), np.r_[np.ones(len(p)), np.zeros(n.size)]
    q = 1 / (1 + np.exp(-x))
    s = 2 * y - 1
    bce = -(y * np.log(q) + (1 - y) * np.log(1 - q))
    terms = {
        "bce": bce, "bce_after_sigmoid": bce, "mse": (x - y) ** 2, "pointwise_hinge": np.maximum(0, 1 - s * x), "soft_pointwise_hinge": sp(1 - s * x), "softplus": sp(-s * x),
        "double_margin": 0.5 * y * np.maximum(0, 1 - x) + 0.5 * (1 - y) * np.maximum(0, 0.5 + x), "focal": (1 - np.where(y == 1, q, 1 - q)) ** 2 * bce,
    }
    return terms[name].mean()


@pytest.mark.parametrize("name", objectives.LOSSES)
def test_losses(name):
    p, n = RNG.normal(size=6), RNG.normal(size=(6, 4))
    a, b = Value(p, True), Value(n, True)
    loss = objectives.loss_of(name, a, b)
    assert np.isclose(loss.x, slow_loss(name, p, n))
    loss.backward()
    if name not in ("nssa", "adversarial_bce"):  # their weights are constants to the gradient
        step = np.zeros_like(n)
        step[2, 1] = 1e-6
        assert np.isclose((slow_loss(name, p, n + step) - slow_loss(name, p, n - step)) / 2e-6, b.grad[2, 1], atol=1e-6)
    total = objectives.loss_of(name, Value(p), Value(n), reduction="sum")
    terms = {"pointwise": 30, "pairwise": 24, "setwise": 6}[objectives.LOSSES[name].kind]
    assert np.isclose(total.x, loss.x * terms)


def test_losses_refuse_what_they_cannot_take():
    p, n = Value([0.0]), Value([[1.0]])
    with pytest.raises(ValueError):
        objectives.loss_of("infonce", p, n, smoothing=0.1)
    with pytest.raises(ValueError):
        objectives.loss_of("margin_ranking", p, n, weights=np.ones(1))


def test_penalties():
    v = Value(np.array([[3.0, 4.0], [0.0, 1.0]]))
    assert np.isclose(objectives.lp(v).x, 3) and np.isclose(objectives.power_sum(v).x, 13) and np.isclose(objectives.norm_limit(v).x, 24)
    assert np.isclose(objectives.orthogonality(v, Value(np.array([[4.0, -3.0], [0.0, 2.0]]))).x, 1 - 1e-5)
    assert np.isclose(objectives.combined(v, {"lp": 1, "power_sum": 3}, 2).x, 2 * (3 / 4 + 39 / 4))


def test_adapters():
    x = Value(np.array([-3.0, 0.0, 5.0]))
    assert forms.clamped(x, -1, 2).x.tolist() == [-1, 0, 2] and np.allclose(forms.affine(x, np.log(2), 1).x, [-5, 1, 11])
    base = forms.averaged(forms.FORMS["distmult"].score)
    h, r, t = ([Value(RNG.normal(size=(4, 3))) for _ in range(2)] for _ in range(3))
    want = 0.5 * ((h[0].x * r[0].x * t[0].x).sum(-1) + (t[1].x * r[1].x * h[1].x).sum(-1))
    assert np.allclose(base(h, r, t, {}).x, want) and np.allclose(forms.FORMS["simple"].score(h, r, t, {}).x, want)


def small(spark, name="distmult", n=40, **kwargs):
    return engine.created(name, spark.range(n), spark.range(3), 6, seed=1, **kwargs)


def test_ranks_are_those_of_all_candidates(spark):
    model = small(spark)
    rows = [(i, i % 3, (7 * i + 3) % 40) for i in range(40)] + [(i, i % 3, (i + 1) % 40) for i in range(0, 40, 2)]
    known = spark.createDataFrame(rows + rows[:5] + [(99, 0, 1)], "h long, r long, t long")
    e, r = ({x.id: np.array(x.v) for x in table.collect()} for table in (model.entities, model.relations))
    score = lambda a, b, c: round(float((e[a] * r[b] * e[c]).sum()), 9)
    want = {}
    for a, b, c in rows[:10]:
        for side in ("head", "tail"):
            own = score(a, b, c)
            other = [score(x, b, c) if side == "head" else score(a, b, x) for x in range(40) if ((x, b, c) if side == "head" else (a, b, x)) not in rows]
            want[a, b, c, side] = (1 + sum(x > own for x in other), 1 + sum(x >= own for x in other), len(other) + 1)
    got = evaluation.ranks(model, spark.createDataFrame(rows[:10] + [(99, 0, 1)], known.schema), known)
    assert {(x.h, x.r, x.t, x.side): (x.optimistic, x.pessimistic, x.candidates) for x in got.collect()} == want
    assert evaluation.ranks(model, known.where("false"), known).count() == 0
    few = evaluation.ranks(model, known.limit(3), known, restrict=spark.range(5))
    assert all(x.candidates <= 6 for x in few.collect())


def test_equal_scores_part_the_ranks(spark):
    model = small(spark, initializer="ones", relation_initializer="ones")
    one = evaluation.ranks(model, spark.createDataFrame([(0, 0, 1)], "h long, r long, t long")).collect()
    assert all((x.optimistic, x.realistic, x.pessimistic, x.candidates) == (1, 20.5, 40, 40) for x in one)


def test_predictions(spark):
    model = small(spark)
    asked = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "h long, r long")
    every = prediction.predict_target(model, asked, "tail").collect()
    assert len(every) == 80
    best = prediction.predict_target(model, asked, "tail", 5).collect()
    for h, r in ((1, 0), (2, 1)):
        order = sorted((-x.score, x.t) for x in every if (x.h, x.r) == (h, r))[:5]
        assert sorted((-x.score, x.t) for x in best if (x.h, x.r) == (h, r)) == order
    known = spark.createDataFrame([(x.h, x.r, x.t) for x in best if x.h == 1], "h long, r long, t long")
    new = prediction.predict_target(model, asked, "tail", 5, known=known, drop_known=True).collect()
    assert len(new) == 10 and not {(x.h, x.r, x.t) for x in new} & {tuple(x) for x in known.collect()}
    assert {x.t for x in prediction.predict_target(model, asked, "tail", targets=spark.range(3)).collect()} == {0, 1, 2}
    top = prediction.predict_all(model, 7).collect()
    assert len(top) == 7 and np.isclose(top[0].score, max(x.score for x in prediction.predict_triples(model, spark.range(40).selectExpr("id h").crossJoin(spark.range(3).selectExpr("id r")).crossJoin(spark.range(40).selectExpr("id t"))).collect()))
    assert prediction.count_scores(model, asked, "tail").first().scores == 80
    sure = prediction.predict_uncertain(model, known, rate=0.0).collect()
    assert all(x.uncertainty == 0 for x in sure)


def test_saved_models_score_alike(spark, tmp_path):
    model = engine.created("ermlp", spark.range(9), spark.range(2), 4, m=3)
    engine.save(model, f"file://{tmp_path}/model")
    again = engine.load(spark, f"file://{tmp_path}/model")
    triples = spark.createDataFrame([(1, 0, 2), (3, 1, 8)], "h long, r long, t long")
    scores = [sorted((x.h, x.score) for x in engine.score_triples(m, triples).collect()) for m in (model, again)]
    assert scores[0] == scores[1] and len(scores[0]) == 2


def test_tape_functions():
    v = Value(np.array([[0.3, -1.2, 2.0]]), True)
    out = tape.softmax(v) * tape.log_sum_exp(v).reshape(1, 1) + tape.elu(v) + tape.maximum(v, 0.1) / tape.sqrt(v * v + 1)
    out.sum().backward()
    f = lambda x: (np.exp(x) / np.exp(x).sum() * np.log(np.exp(x).sum()) + np.where(x > 0, x, np.expm1(x)) + np.maximum(x, 0.1) / np.sqrt(x * x + 1)).sum()
    for i in range(3):
        step = np.eye(3)[i] * 1e-6
        assert np.isclose((f(v.x[0] + step) - f(v.x[0] - step)) / 2e-6, v.grad[0, i], atol=1e-6)
