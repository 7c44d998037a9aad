import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tessarine.models import engine, listeners
from tessarine.operators import classification
from tessarine.plans import experiment, registry
from tessarine.sources import datasets


def graph(spark, n=150):
    return spark.createDataFrame(sorted({(f"e{i % 30}", f"r{i % 3}", f"e{(i + 1 + i % 3 + 3 * (i // 30)) % 30}") for i in range(n)}), "h string, r string, t string")


@pytest.fixture(scope="module")
def data(spark):
    return datasets.from_triples(graph(spark), (0.7, 0.15), seed=2)


def test_datasets(spark, data, tmp_path):
    n = graph(spark).count()
    assert set(data.parts) == set(datasets.PARTS) and data.merged().count() == n
    assert {r.part: r.triples for r in data.summary().collect()}["training"] == int(0.7 * n + 1e-9)
    data.save(f"file://{tmp_path}/d")
    again = datasets.get(spark, f"file://{tmp_path}/d")
    assert again.merged().exceptAll(data.merged()).count() == 0 and again.similarity(data) == 1
    ids, entities, relations = data.encoded(inverses=True)
    assert ids["training"].count() == 2 * data.training.count() and ids["testing"].count() == data.testing.count()
    assert data.remixed(1).merged().exceptAll(data.merged()).count() == 0
    assert data.deteriorated(0.5).training.count() < data.training.count()
    few = data.restricted(relations=spark.createDataFrame([("r1",)], "label string"))
    assert {r.r for r in few.merged().collect()} == {"r1"}
    with pytest.raises(TypeError):
        datasets.get(spark, 5)
    assert datasets.verified(data, "nations")["relations"] == (3, 55)
    assert datasets.known_datasets(spark, "^wn", most=100_000).count() == 1


def test_files_and_archives(spark, tmp_path):
    rows = "\n".join("\t".join(r) for r in graph(spark).collect())
    (tmp_path / "t.tsv").write_text(rows)
    (tmp_path / "test.tsv").write_text("e1\tr1\te2\nnew\tr1\te2\ne1\tnew\te2\n")
    (tmp_path / "n.tsv").write_text("e1\tage\t4.5\ne2\tage\tx\n")
    found = datasets.from_paths(spark, str(tmp_path / "t.tsv"), str(tmp_path / "test.tsv"), literals=str(tmp_path / "n.tsv"))
    assert found.testing.count() == 1 and [tuple(r) for r in found.literals.collect()] == [("e1", "age", 4.5)]
    assert datasets.from_path(spark, str(tmp_path / "t.tsv")).merged().count() == graph(spark).count()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/t.tsv", "head\trel\ttail\n" + rows + "\nshort\n")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(tmp_path / "t.tsv", "x/t.tsv")
    for name, header in (("a.zip", True), ("a.tar.gz", False)):
        got = datasets.archived_triples(spark, f"file://{tmp_path}/{name}", "t.tsv", header=header)
        assert got.exceptAll(graph(spark)).count() == 0 and got.count() == graph(spark).count()
    assert set(datasets.from_archive(spark, f"file://{tmp_path}/a.zip", "t.tsv").parts) == set(datasets.PARTS)
    two = datasets.inductive(graph(spark, 400), 0.5, (0.6, 0.2)).encoded()
    assert set(two) == {"training", "inference", "testing", "validation"}
    path = datasets.fetched(spark, f"file://{tmp_path}/t.tsv", f"file://{tmp_path}/cache")
    assert spark.read.text(path).count() == graph(spark).count()


def test_run_learns_and_saves(spark, data, tmp_path):
    tracker = listeners.Tracker()
    kept = listeners.Checkpoints(f"file://{tmp_path}/c", listeners.every(1), listeners.keep_last(1))
    result = experiment.run(spark, data, "TransE", dimension=12, loss="NSSA", loss_settings={"margin": 3.0}, epochs=6, rate=0.1, negatives=8, tracker=tracker, checkpoints=kept, constrainer="ball")
    assert result.losses[-1] < result.losses[0] and 0 < result.metric("mrr") <= 1 and result.metric("hits@10") == result.metrics["both.realistic.hits_at_10"]
    assert tracker.done and tracker.parameters["model"] == "TransE" and sum(m["metric"] == "loss" for m in tracker.metrics) == 6
    assert kept.held == {6}
    result.save(f"file://{tmp_path}/r")
    again = engine.load(spark, f"file://{tmp_path}/r/model")
    ids = data.encoded()[0]["testing"]
    assert sorted(r.score for r in engine.score_triples(again, ids).collect()) == sorted(r.score for r in engine.score_triples(result.model, ids).collect())


def test_early_stopping_and_other_evaluators(spark, data, tmp_path):
    result = experiment.run(spark, data, "distmult", dimension=4, loss="bce", epochs=5, rate=1e-9, stopper="early", stopper_settings={"frequency": 1, "patience": 1, "path": f"file://{tmp_path}/best"}, training_loop="LCWA", evaluator="classification")
    assert len(result.losses) == 2 and result.stopped == 0 and 0 <= result.metrics["both.roc_auc"] <= 1
    sampled = experiment.run(spark, data, "um", dimension=4, epochs=1, evaluator="sampled", sampled_negatives=5, inverses=True, evaluate_on="validation")
    assert sampled.metric("head.pessimistic.amri") <= 1
    scores = experiment.inverse_stability(experiment.run(spark, data, "distmult", dimension=4, epochs=1, inverses=True), data.encoded()[0]["testing"]).collect()
    assert len(scores) == data.testing.count() and all(abs(abs(r.forward - r.backward) - r.difference) < 1e-12 for r in scores)


def test_configurations_search_and_ablation(spark, data, tmp_path):
    assert experiment.errors({"dataset": 1, "model": "nope", "epochs": 0, "wrong": "x"}) and not experiment.errors({"dataset": 1, "model": "Dist-Mult"})
    (tmp_path / "c.json").write_text(json.dumps({"pipeline": {"dataset": "?", "model": "distmult", "epochs": 1, "dimension": 4}}))
    assert len(experiment.from_file(spark, f"file://{tmp_path}/c.json", dataset=data).losses) == 1
    with pytest.raises(ValueError):
        experiment.from_configuration(spark, {"model": "distmult"})
    found = experiment.search(spark, data, {"rate": {"low": 0.001, "high": 0.1, "log": True}, "loss": {"choices": ["bce", "nope"]}}, 2, sampler="random", seed=3, model="distmult", dimension=4, epochs=1)
    assert len(found.trials) == 2 and found.value == max(t[2] for t in found.trials if t[2] is not None) and found.table(spark).count() == 2
    configurations = experiment.grid([data], ["um"], ["bce", "margin_ranking"], ["sgd"], ["sampled", "lcwa"], epochs=1, dimension=3)
    assert len(configurations) == 3 and experiment.ablation(spark, configurations[:2]).count() == 2
    _, table = experiment.replicated(spark, {"dataset": data, "model": "um", "epochs": 1, "dimension": 3}, 2)
    assert table.where("deviation is not null").count() > 50


def test_registry():
    assert registry.resolve("loss", "MarginRankingLoss") == "margin_ranking" and registry.resolve("model", "TransE") == "transe" and registry.resolve("rank_metric", "Hits@7") == "hits_at_7"
    assert registry.metric_key("head.optimistic.mrr") == ("head", "optimistic", "inverse_harmonic_mean_rank") and registry.metric_key("hits_at.5") == ("both", "realistic", "hits_at_5")
    for wrong in (("loss", "x"), ("nothing", "x")):
        with pytest.raises(ValueError):
            registry.resolve(*wrong)


def test_stopping_and_checkpoints():
    values = iter([0.1, 0.2, 0.2001, 0.15, 0.3])
    stop = listeners.EarlyStopping(lambda m: next(values), 2, 2)
    assert [stop(e, 0.0, None) for e in range(8)] == [False] * 7 + [True] and stop.best_epoch == 3
    assert listeners.is_improvement(1.0, 0.5, False) and not listeners.is_improvement(1.0, 1.005, True, 0.01)
    assert listeners.final_checkpoints(10, listeners.every(2), listeners.keep_last(2)) == {8, 10}
    assert listeners.final_checkpoints(10, listeners.any_of(listeners.explicit([3]), listeners.every(5)), listeners.keep_any(listeners.keep_multiples(10), listeners.keep_explicit([3]))) == {3, 10}
    assert listeners.final_checkpoints(4, listeners.when_best(), listeners.keep_best(), {1: 0.1, 2: 0.5, 3: 0.4, 4: 0.5}) == {2}


def test_tables_of_results(spark, tmp_path):
    both = listeners.Trackers(listeners.ConsoleTracker(), listeners.TableTracker(spark, f"file://{tmp_path}/t", "csv"))
    both.start("x")
    both.log_parameters({"a": {"b": 1}})
    both.log_metrics({"m": 0.5}, 3)
    both.end()
    assert spark.read.csv(f"file://{tmp_path}/t").count() == 2


def test_top_indicators(spark):
    rows = spark.createDataFrame([(3.0, 1), (2.0, 0), (2.0, 1), (1.0, 0)], "score double, y long")
    r = classification.top_indicator_rates(rows).first()
    # two are true; the border is shared by one of each kind
    assert (r.tp, r.fp, r.fn, r.tn, r.scores) == (1.5, 0.5, 0.5, 1.5, 4) and r.accuracy == 0.75
    assert classification.top_indicator_rates(rows.withColumn("y", F.lit(0).cast("long"))).first().precision is None
