"""What goes on beside training: early stopping, checkpoints, evaluations and trackers of results.

A listener is called as ``listener(epoch, loss, model)`` after each epoch and ends the training by returning True.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .engine import Model, load, save


def is_improvement(best: float, current: float, larger_is_better: bool = True, relative_delta: float = 0.0) -> bool:
    """Whether ``current`` is better, by more than the relative difference."""
    better = current > best if larger_is_better else current < best
    return better and not math.isclose(current, best, rel_tol=relative_delta)


@dataclass
class EarlyStopping:
    """Evaluates every ``frequency`` epochs and stops after ``patience`` evaluations without improvement. The best model is kept at ``path`` if one is given."""

    evaluate: Callable[[Model], float]
    frequency: int = 10
    patience: int = 2
    relative_delta: float = 0.01
    larger_is_better: bool = True
    path: str | None = None
    results: list[tuple[int, float]] = field(default_factory=list)
    best_epoch: int | None = None
    left: int | None = None

    def __call__(self, epoch: int, loss: float, model: Model) -> bool:
        if (epoch + 1) % self.frequency:
            return False
        value = self.evaluate(model)
        self.results.append((epoch, value))
        best = next((v for e, v in self.results if e == self.best_epoch), None)
        if best is None or is_improvement(best, value, self.larger_is_better, self.relative_delta):
            self.best_epoch, self.left = epoch, self.patience
            if self.path:
                save(model, self.path)
            return False
        self.left -= 1
        return self.left <= 0

    def best(self, spark: SparkSession) -> Model | None:
        return load(spark, self.path) if self.path and self.best_epoch is not None else None


# schedules tell whether an epoch (from 1) gets a checkpoint; values are those of a metric by epoch


def every(n: int) -> Callable[[int, dict[int, float]], bool]:
    return lambda epoch, values: epoch % n == 0


def explicit(epochs: Iterable[int]) -> Callable[[int, dict[int, float]], bool]:
    wanted = frozenset(epochs)
    return lambda epoch, values: epoch in wanted


def when_best(larger_is_better: bool = True) -> Callable[[int, dict[int, float]], bool]:
    def schedule(epoch: int, values: dict[int, float]) -> bool:
        before = [v for e, v in values.items() if e < epoch]
        return epoch in values and (not before or is_improvement(max(before) if larger_is_better else min(before), values[epoch], larger_is_better))

    return schedule


def any_of(*schedules: Callable) -> Callable[[int, dict[int, float]], bool]:
    return lambda epoch, values: any([s(epoch, values) for s in schedules])


# keepers tell which of the epochs with a checkpoint stay


def keep_last(n: int) -> Callable[[list[int], dict[int, float]], set[int]]:
    return lambda epochs, values: set(sorted(epochs)[-n:]) if n else set()


def keep_multiples(n: int) -> Callable[[list[int], dict[int, float]], set[int]]:
    return lambda epochs, values: {e for e in epochs if e % n == 0}


def keep_explicit(kept: Iterable[int]) -> Callable[[list[int], dict[int, float]], set[int]]:
    kept = frozenset(kept)
    return lambda epochs, values: set(epochs) & kept


def keep_best(larger_is_better: bool = True) -> Callable[[list[int], dict[int, float]], set[int]]:
    def keeper(epochs: list[int], values: dict[int, float]) -> set[int]:
        known = [e for e in epochs if e in values]
        if not known:
            return set()
        top = (max if larger_is_better else min)(values[e] for e in known)
        return {e for e in known if values[e] == top}

    return keeper


def keep_any(*keepers: Callable) -> Callable[[list[int], dict[int, float]], set[int]]:
    return lambda epochs, values: set().union(*(k(epochs, values) for k in keepers))


def final_checkpoints(epochs: int, schedule: Callable, keeper: Callable | None = None, values: dict[int, float] | None = None) -> set[int]:
    """The epochs whose checkpoints are left in the end, without training."""
    held: set[int] = set()
    for epoch in range(1, epochs + 1):
        seen = {e: v for e, v in (values or {}).items() if e <= epoch}
        if schedule(epoch, seen):
            held.add(epoch)
        if keeper is not None:
            held &= keeper(sorted(held), seen)
    return held


@dataclass
class Checkpoints:
    """Models saved below ``root`` as a schedule asks; those that the keeper doesn't keep are removed."""

    root: str
    schedule: Callable = every(10)
    keeper: Callable | None = None
    evaluate: Callable[[Model], float] | None = None
    values: dict[int, float] = field(default_factory=dict)
    held: set[int] = field(default_factory=set)

    def path(self, epoch: int) -> str:
        return f"{self.root.rstrip('/')}/epoch-{epoch:07d}"

    def __call__(self, epoch: int, loss: float, model: Model) -> bool:
        epoch += 1
        self.values[epoch] = self.evaluate(model) if self.evaluate else -loss
        if self.schedule(epoch, self.values):
            save(model, self.path(epoch))
            self.held.add(epoch)
        if self.keeper is not None:
            spark = model.entities.sparkSession
            for gone in self.held - self.keeper(sorted(self.held), self.values):
                at = spark._jvm.org.apache.hadoop.fs.Path(self.path(gone))
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
                self.held.discard(gone)
        return False


class Tracker:
    """Takes a run's parameters and its metrics by step; an undefined one is NaN. This one keeps them in dictionaries."""

    def __init__(self):
        self.name: str | None = None
        self.parameters: dict[str, object] = {}
        self.metrics: list[dict[str, object]] = []
        self.done: bool | None = None

    def start(self, name: str | None = None) -> None:
        self.name = name

    def log_parameters(self, parameters: dict) -> None:
        self.parameters |= flattened(parameters)

    def log_metrics(self, metrics: dict, step: int | None = None) -> None:
        self.metrics += [{"step": step, "metric": k, "value": float("nan") if v is None else float(v)} for k, v in flattened(metrics).items()]

    def end(self, success: bool = True) -> None:
        self.done = success


class ConsoleTracker(Tracker):
    """Prints what it takes."""

    def log_parameters(self, parameters: dict) -> None:
        super().log_parameters(parameters)
        for k, v in flattened(parameters).items():
            print(f"parameter {k} = {v}")  # noqa: T201

    def log_metrics(self, metrics: dict, step: int | None = None) -> None:
        super().log_metrics(metrics, step)
        for k, v in flattened(metrics).items():
            print(f"step {step}: {k} = {v}")  # noqa: T201


class TableTracker(Tracker):
    """Appends everything to a table of run, kind, step, name, value: ``kind`` is csv, json or parquet, the path any that Spark can write."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "json"):
        super().__init__()
        self.spark, self.path, self.kind = spark, path, kind

    def end(self, success: bool = True) -> None:
        super().end(success)
        rows = [(self.name, "parameter", None, k, str(v)) for k, v in self.parameters.items()] + [(self.name, "metric", m["step"], m["metric"], str(m["value"])) for m in self.metrics]
        frame: DataFrame = self.spark.createDataFrame(rows, "run string, kind string, step long, name string, value string").coalesce(1)
        frame.write.mode("append").format(self.kind).save(self.path)


class Trackers(Tracker):
    """Hands everything on to several trackers."""

    def __init__(self, *trackers: Tracker):
        super().__init__()
        self.trackers = trackers

    def start(self, name: str | None = None) -> None:
        for t in self.trackers:
            t.start(name)

    def log_parameters(self, parameters: dict) -> None:
        for t in self.trackers:
            t.log_parameters(parameters)

    def log_metrics(self, metrics: dict, step: int | None = None) -> None:
        for t in self.trackers:
            t.log_metrics(metrics, step)

    def end(self, success: bool = True) -> None:
        for t in self.trackers:
            t.end(success)


def flattened(nested: dict, prefix: str = "") -> dict[str, object]:
    """A nested dictionary with its keys joined by dots."""
    out = {}
    for k, v in nested.items():
        name = f"{prefix}.{k}" if prefix else str(k)
        out |= flattened(v, name) if isinstance(v, dict) else {name: v}
    return out


def tracked(tracker: Tracker, evaluate: Callable[[Model], dict[str, float]] | None = None, frequency: int = 1, prefix: str = "validation") -> Callable:
    """A listener that logs each epoch's loss, and an evaluation every ``frequency`` epochs."""

    def listener(epoch: int, loss: float, model: Model) -> bool:
        tracker.log_metrics({"loss": loss}, epoch)
        if evaluate is not None and (epoch + 1) % frequency == 0:
            tracker.log_metrics({prefix: evaluate(model)}, epoch)
        return False

    return listener
