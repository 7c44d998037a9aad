"""Experiments: train a model on a dataset, evaluate it, search settings, compare grids of them.

A configuration is a dictionary (or JSON file) of the arguments of ``run``; names are looked up in the registry. Tables stay
distributed throughout; what a result keeps on the driver are losses and metrics.
"""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import engine, fitting, listeners
from ..models.engine import Model
from ..models.fitting import Trainer
from ..operators import evaluation, relational
from ..sources import datasets
from ..sources.datasets import Dataset
from . import registry


@dataclass
class Result:
    """A trained model with its dictionaries, the loss of each epoch, the metrics by key, and seconds by phase."""

    model: Model
    entities: DataFrame
    relations: DataFrame
    losses: list[float]
    metrics: dict[str, float]
    seconds: dict[str, float]
    configuration: dict = field(default_factory=dict)
    stopped: int | None = None

    def metric(self, key: str) -> float:
        return self.metrics[".".join(registry.metric_key(key))]

    def save(self, path: str) -> None:
        """Model, dictionaries and results below ``path``, in any file system that Spark knows."""
        engine.save(self.model, f"{path}/model")
        self.entities.write.mode("overwrite").parquet(f"{path}/entity_dictionary")
        self.relations.write.mode("overwrite").parquet(f"{path}/relation_dictionary")
        spark = self.entities.sparkSession
        rows = [("metric", k, None if v is None else float(v)) for k, v in self.metrics.items()] + [("loss", str(k), float(x)) for k, x in enumerate(self.losses)] + [("seconds", k, float(v)) for k, v in self.seconds.items()]
        spark.createDataFrame(rows, "kind string, name string, value double").coalesce(1).write.mode("overwrite").json(f"{path}/results")
        spark.createDataFrame([(json.dumps(self.configuration, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/configuration")


def _trainer(loss, loss_settings, optimizer, rate, epochs, negatives, sampler, batches, smoothing, regularizer, regularizer_weight, schedule, constrainer, clip_norm, clip_value, seed) -> Trainer:
    return Trainer(
        loss=registry.resolve("loss", loss), loss_settings=loss_settings or {}, optimizer=registry.resolve("optimizer", optimizer), rate=rate, negatives=negatives, sampler=registry.resolve("negative_sampler", sampler),
        batches=batches, smoothing=smoothing, penalties={registry.resolve("regularizer", regularizer): regularizer_weight} if regularizer else {}, schedule=registry.schedule(schedule, epochs),
        clip_value=clip_value, clip_norm=clip_norm, constrain=registry.resolve("constrainer", constrainer) if constrainer else None, seed=seed,
    )


def run(
    spark: SparkSession, dataset, model: str = "transe", dimension: int = 32, model_settings: dict | None = None, initializer: str = "xavier_uniform", loss: str = "margin_ranking", loss_settings: dict | None = None,
    optimizer: str = "adam", rate: float = 0.01, epochs: int = 5, negatives: int = 1, sampler: str = "basic", batches: int = 1, smoothing: float = 0.0, training_loop: str = "sampled", regularizer: str | None = None,
    regularizer_weight: float = 0.01, schedule: str = "constant", constrainer: str | None = None, clip_norm: float | None = None, clip_value: float | None = None, inverses: bool = False, stopper: str = "none", stopper_settings: dict | None = None,
    evaluator: str = "rank", filtered: bool = True, evaluate_on: str = "testing", restrict_to: DataFrame | None = None, sampled_negatives: int = 50, ks: tuple[int, ...] = (1, 3, 5, 10),
    tracker: listeners.Tracker | None = None, checkpoints: listeners.Checkpoints | None = None, dataset_settings: dict | None = None, seed: int = 0, **dims: int,
) -> Result:
    """Trains on the dataset's training part and evaluates on another part, among all candidates but known ones, among sampled ones, or by classification.

    With ``inverses`` each triple is also trained from its tail, as relation 2 r + 1. ``restrict_to`` (label): the only entities that are candidates.
    """
    configuration = {k: v for k, v in locals().items() if k not in ("spark", "dataset", "tracker", "checkpoints", "restrict_to")}
    tracker = tracker or listeners.Tracker()
    tracker.start(model)
    tracker.log_parameters({k: v for k, v in configuration.items() if v is not None})
    began, seconds = time.time(), {}
    data: Dataset = datasets.get(spark, dataset, **(dataset_settings or {}))
    ids, entities, relations = data.encoded(inverses)
    seconds["data"] = time.time() - began
    name = registry.resolve("model", model)
    numbers = relations.select("id") if not inverses else relations.select(F.explode(F.array(2 * F.col("id"), 2 * F.col("id") + 1)).alias("id"))
    made = engine.created(name, entities.select("id"), numbers, dimension, seed, registry.resolve("initializer", initializer), settings=model_settings, **dims)
    trainer = _trainer(loss, loss_settings, optimizer, rate, epochs, negatives, sampler, batches, smoothing, regularizer, regularizer_weight, schedule, constrainer, clip_norm, clip_value, seed)
    known = relational.merge(*ids.values()).distinct() if filtered else None
    candidates = entities.join(restrict_to.select("label").distinct(), "label", "left_semi").select("id") if restrict_to is not None else None

    def evaluated(m: Model, part: DataFrame) -> dict[str, float]:
        kind = registry.resolve("evaluator", evaluator)
        if kind == "sampled":
            return evaluation.flat(evaluation.evaluate_sampled(m, part, relational.merge(*ids.values()).distinct(), entities.select("id"), sampled_negatives, seed, ks))
        if kind == "classification":
            return classified(m, part)
        return evaluation.flat(evaluation.evaluate(m, part, known, ks=ks, restrict=candidates))

    heard: list[Callable] = [listeners.tracked(tracker)]
    early = None
    if registry.resolve("stopper", stopper) == "early":
        by_class = registry.resolve("evaluator", evaluator) == "classification"
        options = {"metric": "both.average_precision" if by_class else "mrr"} | (stopper_settings or {})
        key = options.pop("metric") if by_class else ".".join(registry.metric_key(options.pop("metric")))
        part = ids.get("validation", ids[evaluate_on])
        early = listeners.EarlyStopping(lambda m: evaluated(m, part)[key], **options)
        heard.append(early)
    if checkpoints is not None:
        heard.append(checkpoints)
    began = time.time()
    loop = registry.resolve("training_loop", training_loop)
    trained, history = fitting.train(made, ids["training"], trainer, epochs, "sampled" if loop == "sampled" else "all", ("h", "t") if loop == "symmetric" else ("t",), tuple(heard))
    if early is not None and early.path and early.best_epoch is not None:
        trained = early.best(spark)
    seconds["training"] = time.time() - began
    began = time.time()
    metrics = evaluated(trained, ids[evaluate_on])
    seconds["evaluation"] = time.time() - began
    tracker.log_metrics({evaluate_on: metrics}, len(history))
    tracker.end()
    return Result(trained, entities, relations, history, metrics, seconds, configuration, early.best_epoch if early else None)


def classified(model: Model, triples: DataFrame) -> dict[str, float]:
    """Classification metrics of the scores of all candidates, by side and over both: as many are taken for true as are."""
    from ..operators import classification

    rows = evaluation.staged(evaluation.labelled_scores(model, triples))
    out = {}
    for side in ("head", "tail", "both"):
        mine = rows if side == "both" else rows.where(F.col("side") == side)
        for r in classification.top_indicator_rates(mine).collect():
            out |= {f"{side}.{k}": v for k, v in r.asDict().items()}
        out |= {f"{side}.{k}": v for k, v in classification.roc_auc(mine).first().asDict().items()}
    return out


def from_configuration(spark: SparkSession, configuration: dict, **more) -> Result:
    """A run by a configuration; an entry ``pipeline`` may hold it."""
    if problems := errors(configuration):
        raise ValueError("; ".join(problems))
    return run(spark, **(configuration.get("pipeline", configuration) | more))


def from_file(spark: SparkSession, path: str, **more) -> Result:
    """A run by a JSON file, in any file system that Spark knows."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return from_configuration(spark, json.loads(text), **more)


#: The arguments of ``run`` that are names, with their kinds.
_NAMES = {"model": "model", "loss": "loss", "optimizer": "optimizer", "sampler": "negative_sampler", "training_loop": "training_loop", "regularizer": "regularizer", "schedule": "schedule", "constrainer": "constrainer", "initializer": "initializer", "stopper": "stopper", "evaluator": "evaluator"}


def errors(configuration: dict) -> list[str]:
    """What is wrong with a configuration: unknown arguments and names, and numbers that can't be."""
    import inspect

    given = configuration.get("pipeline", configuration)
    known = inspect.signature(run).parameters
    out = [f"no argument {k}" for k in given if k not in known and not isinstance(given[k], int)]
    for k, kind in _NAMES.items():
        if given.get(k) is not None and isinstance(given[k], str):
            try:
                registry.resolve(kind, given[k])
            except ValueError as e:
                out.append(str(e))
    out += [f"{k} must be positive" for k in ("dimension", "epochs", "rate", "negatives", "batches") if given.get(k) is not None and not given[k] > 0]
    return out if "dataset" in given else [*out, "a dataset is missing"]


def replicated(spark: SparkSession, configuration: dict, replicates: int, path: str | None = None, **more) -> tuple[list[Result], DataFrame]:
    """Runs that differ by their seeds, and a table metric, mean, deviation, least, most over them. Results are saved below ``path``."""
    found = []
    for k in range(replicates):
        found.append(from_configuration(spark, configuration, **(more | {"seed": k})))
        if path:
            found[-1].save(f"{path}/replicate-{k}")
    rows = [(k, m, float(v)) for k, r in enumerate(found) for m, v in r.metrics.items() if v is not None]
    table = spark.createDataFrame(rows, "replicate long, metric string, value double").groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"), F.min("value").alias("least"), F.max("value").alias("most"))
    return found, table


def suggested(ranges: dict[str, dict], rng: np.random.Generator) -> dict[str, object]:
    """One draw from ranges by argument: {"type": "int" | "float" | "categorical", "low", "high", "step", "log", "choices"}."""
    out = {}
    for name, r in ranges.items():
        kind = r.get("type", "categorical" if "choices" in r else "float")
        if kind == "categorical":
            out[name] = r["choices"][int(rng.integers(len(r["choices"])))]
        elif r.get("log"):
            x = float(np.exp(rng.uniform(np.log(r["low"]), np.log(r["high"]))))
            out[name] = round(x) if kind == "int" else x
        elif kind == "int":
            step = r.get("step", 1)
            out[name] = int(r["low"] + step * rng.integers((r["high"] - r["low"]) // step + 1))
        elif kind == "float":
            x = float(rng.uniform(r["low"], r["high"]))
            out[name] = x if "step" not in r else r["low"] + r["step"] * round((x - r["low"]) / r["step"])
        else:
            raise ValueError(f"no type {kind} of a range")
    return out


@dataclass
class Search:
    """The best run's number, arguments and value, and (trial, arguments, value, error) of all."""

    best: int
    arguments: dict
    value: float
    trials: list[tuple[int, dict, float | None, str | None]]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, json.dumps(a), v, e) for k, a, v, e in self.trials], "trial long, arguments string, value double, error string")


def search(spark: SparkSession, dataset, ranges: dict[str, dict], trials: int, metric: str = "both.realistic.inverse_harmonic_mean_rank", larger_is_better: bool = True, sampler: str = "random", seed: int = 0, **fixed) -> Search:
    """Runs with arguments drawn from ranges ("random") or all their combinations ("grid"), the best by a metric on the validation part.

    A trial that raises ValueError is recorded and passed over.
    """
    data, rng = datasets.get(spark, dataset), np.random.default_rng(seed)
    if sampler == "grid":
        axes = {n: r["choices"] if "choices" in r else list(np.arange(r["low"], r["high"] + r.get("step", 1) / 2, r.get("step", 1)).tolist()) for n, r in ranges.items()}
        drawn = [dict(zip(axes, x, strict=True)) for x in itertools.islice(itertools.product(*axes.values()), trials)]
    else:
        drawn = [suggested(ranges, rng) for _ in range(trials)]
    part, found, key = "validation" if "validation" in data.parts else "testing", [], ".".join(registry.metric_key(metric))
    for k, arguments in enumerate(drawn):
        try:
            found.append((k, arguments, run(spark, data, **(fixed | arguments | {"evaluate_on": part})).metrics[key], None))
        except ValueError as e:
            found.append((k, arguments, None, str(e)))
    good = [f for f in found if f[2] is not None]
    if not good:
        raise ValueError("no trial came to an end")
    top = (max if larger_is_better else min)(good, key=lambda f: f[2])
    return Search(top[0], top[1], top[2], found)


def grid(datasets_: list, models: list[str], losses: list[str], optimizers: list[str], training_loops: list[str], inverses: tuple[bool, ...] = (False,), **shared) -> list[dict]:
    """The configurations of an ablation: all combinations, but losses that a training loop can't take."""
    out = []
    for d, m, x, o, t, i in itertools.product(datasets_, models, losses, optimizers, training_loops, inverses):
        loop, loss = registry.resolve("training_loop", t), registry.resolve("loss", x)
        if loop != "sampled" and fitting.LOSSES[loss].kind != "pointwise" and loss != "cross_entropy":
            continue
        out.append(shared | {"dataset": d, "model": m, "loss": loss, "optimizer": o, "training_loop": loop, "inverses": i})
    return out


def ablation(spark: SparkSession, configurations: list[dict], metric: str = "mrr", path: str | None = None) -> DataFrame:
    """A table configuration, value of runs by the configurations; results are saved below ``path``."""
    key, rows = ".".join(registry.metric_key(metric)), []
    for k, c in enumerate(configurations):
        result = from_configuration(spark, c)
        if path:
            result.save(f"{path}/{k:04d}")
        rows.append((k, json.dumps({n: v for n, v in c.items() if n != "dataset"}, default=str), float(result.metrics[key])))
    return spark.createDataFrame(rows, "run long, configuration string, value double")


def inverse_stability(result: Result, triples: DataFrame) -> DataFrame:
    """Of a model trained with inverses, every triple's score and that of its inverse: h, r, t, forward, backward, difference."""
    doubled = triples.select("h", (F.col("r") * 2).alias("r"), "t")
    forward = engine.score_triples(result.model, doubled, "forward").select("h", F.floor(F.col("r") / 2).alias("r"), "t", "forward")
    turned = triples.select(F.col("t").alias("h"), (F.col("r") * 2 + 1).alias("r"), F.col("h").alias("t"))
    backward = engine.score_triples(result.model, turned, "backward").select(F.col("t").alias("h"), F.floor(F.col("r") / 2).alias("r"), F.col("h").alias("t"), "backward")
    return forward.join(backward, ["h", "r", "t"]).withColumn("difference", F.abs(F.col("forward") - F.col("backward")))
