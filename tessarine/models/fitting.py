"""Training of any form by gradient steps, as joins, block products and sorted merges.

A step's gradients are rows (kind, id, g): sums over a task's triples by entity or relation, over all for shared weights
and the loss. Vectors and their gradients meet by id, sorted, and are updated as they stream past, so no table of
vectors is ever on the driver or held by a task. Each step's tables are written to the shared folder; a lost
executor costs a part of one step. Draws come from hashes of ids and seeds, so reruns agree on any cluster up to
the order of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splitting import unit_hash
from ..sources.staging import dropped, staged
from .engine import CELLS, Model, blocked, lists, matrix, with_vectors
from .objectives import LOSSES, PENALTIES, loss_of, smoothed
from .tape import Value, where

_GRADIENTS = "kind int, id long, g array<double>"
_ENTITY, _RELATION, _WEIGHT, _LOSS = range(4)


@dataclass
class Trainer:
    """How to train. ``batches``: gradient steps an epoch; ``negatives``: corrupted copies of each triple, drawn by ``sampler`` (basic, bernoulli, pseudo_typed).

    ``schedule``: factor of the rate by epoch; ``clip_value``, ``clip_norm``: bounds of a row's gradient, element-wise or of its length;
    ``constrain``: unit or ball, which entity vectors are brought to after each step; ``frozen``: the last so many numbers of entity vectors
    don't move (literals).
    """

    loss: str = "margin_ranking"
    loss_settings: dict = field(default_factory=dict)
    optimizer: str = "adam"
    rate: float = 0.01
    negatives: int = 1
    sampler: str = "basic"
    batches: int = 1
    smoothing: float = 0.0
    penalties: dict[str, float] = field(default_factory=dict)
    schedule: Callable[[int], float] | None = None
    clip_value: float | None = None
    clip_norm: float | None = None
    constrain: str | None = None
    frozen: int = 0
    seed: int = 0


def exponential(gamma: float) -> Callable[[int], float]:
    return lambda epoch: gamma**epoch


def stepped(every: int, gamma: float) -> Callable[[int], float]:
    return lambda epoch: gamma ** (epoch // every)


def cosine(epochs: int, least: float = 0.0) -> Callable[[int], float]:
    return lambda epoch: least + (1 - least) * 0.5 * (1 + float(np.cos(np.pi * min(epoch, epochs) / epochs)))


# samples: (h, r, t, j, on_head, other)


def sampled(triples: DataFrame, how: str, per_positive: int, num_entities: int, seed: int, statistics: DataFrame | None = None) -> DataFrame:
    """Corrupted entities of distinct triples over the ids below ``num_entities``: the j-th of each takes ``other`` for its head or its tail.

    ``statistics``: of all training triples, (r, head_probability) for bernoulli and (r, place, other, on_head, n) for pseudo_typed.
    """
    each = triples.select("h", "r", "t").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per_positive - 1))))
    u = lambda k: unit_hash("h", "r", "t", "j", seed=seed * 3 + k)
    if how == "pseudo_typed":
        sizes = statistics.groupBy("r").agg(F.max("n").alias("n"))
        asked = each.join(sizes, "r").withColumn("place", F.floor(u(0) * F.col("n")).cast("long"))
        return asked.join(statistics.select("r", "place", "other", "on_head"), ["r", "place"]).select("h", "r", "t", "j", "on_head", "other")
    odds = F.lit(0.5)
    if how == "bernoulli":
        each, odds = each.join(statistics, "r"), F.col("head_probability")
    each = each.withColumn("on_head", u(0) < odds)
    own = F.when(F.col("on_head"), F.col("h")).otherwise(F.col("t"))
    other = (own + 1 + F.floor(u(1) * max(1, num_entities - 1)).cast("long")) % max(1, num_entities)
    return each.select("h", "r", "t", "j", "on_head", other.alias("other"))


def sampler_statistics(triples: DataFrame, how: str) -> DataFrame | None:
    """What ``sampled`` needs to know of all triples, as a table."""
    from ..operators import analysis
    from ..operators.ranking import positions

    if how == "bernoulli":
        return staged(analysis.bernoulli(triples).select("r", "head_probability"))
    if how == "pseudo_typed":
        ends = F.explode(F.array(F.struct(F.lit(True).alias("on_head"), F.col("h").alias("other")), F.struct(F.lit(False).alias("on_head"), F.col("t").alias("other"))))
        pool = triples.select("r", ends.alias("x")).select("r", "x.on_head", "x.other").distinct()
        placed = positions(pool, ["r"], ["on_head", "other"])
        return staged(placed.join(pool.groupBy("r").agg(F.count("*").alias("n")), "r"))
    return None


# gradients


def _summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows."""
    by = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, ids[by][1:] != ids[by][:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids[by][first], np.add.reduceat(rows[by], first, axis=0) if len(first) else rows


def _rows(kind: int, ids: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(np.asarray(ids, np.int64)), lists(g)], names=["kind", "id", "g"])


def _out(parts: dict[int, list[tuple[np.ndarray, np.ndarray]]], weights: dict[str, Value], loss: float) -> Iterator[pa.RecordBatch]:
    """The rows of one piece of work."""
    for kind, held in parts.items():
        ids, g = _summed(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        if g.shape[1]:
            yield _rows(kind, ids, g)
    for k, w in enumerate(weights.values()):
        if w.grad is not None:
            yield _rows(_WEIGHT, np.array([k]), w.grad.reshape(1, -1))
    yield _rows(_LOSS, np.array([0]), np.array([[loss]]))


class _Sums:
    """Sums of gradients by id over a task's pieces of work, of bounded size: rows go out when three quarters of ``CELLS`` numbers of different ids are held, or at the end."""

    def __init__(self):
        self.held, self.numbers, self.weights, self.loss = {}, 0, {}, 0.0

    def add(self, parts: dict[int, list[tuple[np.ndarray, np.ndarray]]], weights: dict[str, Value], loss: float) -> Iterator[pa.RecordBatch]:
        self.loss += loss
        for k, w in enumerate(weights.values()):
            if w.grad is not None:
                self.weights[k] = self.weights.get(k, 0.0) + w.grad.reshape(1, -1)
        for kind, new in parts.items():
            self.held.setdefault(kind, []).extend(x for x in new if x[1].shape[1])
            self.numbers += sum(g.size for _, g in new)
        if self.numbers > CELLS:
            self.numbers = 0
            for kind, held in self.held.items():
                if held:
                    self.held[kind] = [_summed(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))]
                    self.numbers += self.held[kind][0][1].size
            if self.numbers > CELLS * 3 // 4:
                yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        for kind, held in self.held.items():
            if held:
                yield _rows(kind, *_summed(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])))
        for k, g in self.weights.items():
            yield _rows(_WEIGHT, np.array([k]), g)
        yield _rows(_LOSS, np.array([0]), np.array([[self.loss]]))
        self.__init__()


def pair_gradients(model: Model, positives: DataFrame, negatives: DataFrame, trainer: Trainer, scale: float, terms: int) -> DataFrame:
    """Gradients of ``scale`` times the loss's sum of ``terms`` a positive over positives and their negatives (h, r, t, j, on_head, other)."""
    gathered = negatives.join(model.entities.select(F.col("id").alias("other"), F.col("v").alias("ov")), "other")
    # a triple's negatives are as many as the trainer asks for
    gathered = gathered.groupBy("h", "r", "t").agg(F.sort_array(F.collect_list(F.struct("j", "on_head", "other", "ov"))).alias("x"))
    gathered = gathered.select("h", "r", "t", F.transform("x", lambda x: x["on_head"].cast("double")).alias("on_head"), F.transform("x", lambda x: x["other"]).alias("other"), F.flatten(F.transform("x", lambda x: x["ov"])).alias("ov"))
    batch = with_vectors(positives.select("h", "r", "t").join(gathered, ["h", "r", "t"]), model).select("h", "r", "t", "hv", "rv", "tv", "on_head", "other", "ov")
    form, dims, weights, k = model.form, model.dims, model.weights, trainer.negatives
    name, settings, smoothing, penalties = trainer.loss, trainer.loss_settings, trainer.smoothing, trainer.penalties

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost = max(1, sum(matrix(batch.column(c).slice(0, 1)).shape[1] for c in ("hv", "rv", "tv", "ov"))) if batch.num_rows else 1
            step = max(1, CELLS // (cost * (k + 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = {c: part.column(c).to_numpy() for c in "hrt"}
                h, r, t = (Value(matrix(part.column(f"{c}v")), True) for c in "hrt")
                n, wide = h.shape
                on_head = matrix(part.column("on_head"))[:, :, None] > 0.5
                o = Value(matrix(part.column("ov")).reshape(n, -1, wide), True)
                w = {name_: Value(x, True) for name_, x in weights.items()}
                lift = lambda v: v.reshape(n, 1, v.shape[-1])  # noqa: B023, E731
                positive = form(h, r, t, w, dims)
                negative = form(where(on_head, o, lift(h)), lift(r), where(on_head, lift(t), o), w, dims)
                loss = loss_of(name, positive, negative, smoothing=smoothing, reduction="sum", **settings) * scale
                total = loss
                for penalty, share in penalties.items():
                    for v in (h, r, t):
                        if v.shape[-1]:
                            total = total + PENALTIES[penalty](v) * (share * n * scale * terms)
                total.backward()
                zero = lambda v: v.grad if v.grad is not None else np.zeros(v.shape)
                others = np.concatenate(part.column("other").to_pylist()).astype(np.int64)
                parts = {_ENTITY: [(ids["h"], zero(h)), (ids["t"], zero(t)), (others, zero(o).reshape(-1, wide))], _RELATION: [(ids["r"], zero(r))]}
                yield from _out(parts, w, float(loss.x))

    return batch.mapInArrow(run, _GRADIENTS)


def _dense(model: Model, queries: DataFrame, side: str, seeds: Callable, columns: list[str], num_entities: int, scale: float = 1.0, query_rows: int = 256, entity_rows: int = 2048) -> DataFrame:
    """Gradients of scores of all entities for queries, whose losses and seeds ``seeds(scores, columns)`` gives, block by block.

    A task takes a part of the queries and as many entities as it can hold sums for, so rows are those of the entities once a part of
    queries (one a core) and those of the queries once a part of entities, not once a pair of blocks.
    """
    fixed = [s for s in "hrt" if s != side]
    form, dims, weights = model.form, model.dims, model.weights
    entity_parts = max(1, -(-num_entities * max(1, form.widths(dims)[0]) * 2 // CELLS))
    asked = blocked(queries.repartition(max(2, queries.sparkSession.sparkContext.defaultParallelism)), [f"{s}v" for s in fixed], [*fixed, *columns], query_rows)
    every = blocked(model.entities.select(F.col("id").alias("candidate"), F.col("v").alias("candidate_v")), ["candidate_v"], ["candidate"], entity_rows).repartition(entity_parts)
    product = form.product

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].values  # noqa: B023, E731
                candidates, ids = get("candidate").to_numpy(), {s: get(s).to_numpy() for s in fixed}
                n, m = len(ids[fixed[0]]), len(candidates)
                whole = get("candidate_v").to_numpy().reshape(m, -1)
                given = {c: get(c).to_numpy() for c in columns}
                own = {s: get(f"{s}v").to_numpy().reshape(n, -1) for s in fixed}
                wide = 8 if product else max(1, whole.shape[1] + sum(v.shape[1] for v in own.values()))
                step = max(1, CELLS // (wide * max(1, m)))
                for a in range(0, n, step):
                    few = {c: x[a : a + step][:, None] for c, x in given.items()}
                    if product:
                        x, y = (own[s][a : a + step] for s in fixed)
                        both = x * y
                        loss, seed = seeds(both @ whole.T, few)
                        g = seed @ whole * scale
                        grads = {fixed[0]: g * y, fixed[1]: g * x, side: seed.T @ both * scale}
                        w = {}
                    else:
                        values = {s: Value(v[a : a + step][:, None], True) for s, v in own.items()} | {side: Value(whole[None], True)}
                        w = {k: Value(x, True) for k, x in weights.items()}
                        scores = form(values["h"], values["r"], values["t"], w, dims)
                        loss, seed = seeds(scores.x, few)
                        scores.backward(seed * scale)
                        grads = {s: v.grad for s, v in values.items() if v.grad is not None}
                    parts = {}
                    for s, v in grads.items():
                        who = candidates if s == side else ids[s][a : a + step]
                        parts.setdefault(_RELATION if s == "r" else _ENTITY, []).append((who, v.reshape(len(who), -1)))
                    yield from sums.add(parts, w, float(loss) * scale)
        yield from sums.out()

    return asked.crossJoin(every).mapInArrow(run, _GRADIENTS)


def _pointwise_slopes(name: str, settings: dict) -> Callable[[np.ndarray, float], tuple[np.ndarray, np.ndarray]]:
    """Terms and derivatives of a pointwise loss at scores of one label."""
    loss = LOSSES[name]

    def run(x: np.ndarray, y: float) -> tuple[np.ndarray, np.ndarray]:
        v = Value(x, True)
        terms = loss.terms(v, np.full(x.shape, y), **(loss.settings | settings))
        terms.backward(np.ones(x.shape))
        return terms.x, v.grad if v.grad is not None else np.zeros(x.shape)

    return run


def all_gradients(model: Model, triples: DataFrame, side: str, trainer: Trainer, scale: float, num_entities: int) -> DataFrame:
    """Gradients of the loss of every entity's score for every pair of the other two sides in ``triples``, which are the true ones.

    A pointwise loss is that of all scores as if false, and for each triple what its label changes; cross entropy spreads a
    query's weight over its triples and needs the logarithm of the sum of all exponentials first, from a pass of its own. Neither lists a query's labels.
    """
    from .engine import against_all

    fixed = [s for s in "hrt" if s != side]
    distinct = triples.select("h", "r", "t").distinct()
    n = staged(distinct.groupBy(*fixed).agg(F.count("*").cast("double").alias("n")))
    queries = with_vectors(n, model, "".join(fixed))
    name, settings = trainer.loss, trainer.loss_settings
    if LOSSES[name].kind == "pointwise":
        slopes, labels = _pointwise_slopes(name, settings), smoothed(np.array([0.0, 1.0]), trainer.smoothing, max(2, num_entities) if trainer.smoothing else 2)

        def as_false(x, _):
            terms, slope = slopes(x, labels[0])
            return terms.sum(), slope

        def correction(x, _):
            (t1, s1), (t0, s0) = slopes(x, labels[1]), slopes(x, labels[0])
            return (t1 - t0).sum(), s1 - s0

        return _dense(model, queries, side, as_false, ["n"], num_entities, scale).unionByName(_given(model, distinct, correction, [], scale))
    if name != "cross_entropy":
        raise ValueError(f"{name} is no loss of all candidates")

    def partial(scores, ids, columns):
        top = scores.max(1)
        return pa.RecordBatch.from_arrays([*(pa.array(columns[c]) for c in fixed), pa.array(top), pa.array(np.exp(scores - top[:, None]).sum(1))], names=[*fixed, "top", "total"])

    sums = against_all(model, queries, side, partial, ", ".join(f"{c} long" for c in fixed) + ", top double, total double", fixed)
    most = sums.groupBy(*fixed).agg(F.collect_list(F.struct("top", "total")).alias("x"))
    # one pair a block of entities
    highest = F.array_max(F.transform("x", lambda p: p["top"]))
    lse = most.withColumn("high", highest).select(*fixed, (F.col("high") + F.log(F.aggregate("x", F.lit(0.0), lambda a, p: a + p["total"] * F.exp(p["top"] - F.col("high"))))).alias("lse"))
    lse = staged(lse)

    def spread(x, columns):
        return 0.0, np.exp(x - columns["lse"])

    def true(x, columns):
        return ((columns["lse"][:, 0] - x) / columns["n"][:, 0]).sum(), -1 / columns["n"][:, 0]

    every = _dense(model, queries.join(lse, fixed), side, spread, ["lse"], num_entities, scale)
    return every.unionByName(_given(model, distinct.join(n, fixed).join(lse, fixed), true, ["lse", "n"], scale))


def _given(model: Model, triples: DataFrame, seeds: Callable, columns: list[str], scale: float) -> DataFrame:
    """Gradients of the scores of given triples, with losses and seeds by ``seeds``."""
    form, dims, weights = model.form, model.dims, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, r, t = (Value(matrix(batch.column(f"{c}v")), True) for c in "hrt")
            w = {k: Value(x, True) for k, x in weights.items()}
            scores = form(h, r, t, w, dims)
            loss, seed = seeds(scores.x, {c: batch.column(c).to_numpy()[:, None] for c in columns})
            scores.backward(seed * scale)
            zero = lambda v: v.grad if v.grad is not None else np.zeros(v.shape)
            ids = {c: batch.column(c).to_numpy() for c in "hrt"}
            yield from _out({_ENTITY: [(ids["h"], zero(h)), (ids["t"], zero(t))], _RELATION: [(ids["r"], zero(r))]}, w, float(loss) * scale)

    rows = with_vectors(triples, model)
    return rows.select("h", "r", "t", "hv", "rv", "tv", *columns).mapInArrow(run, _GRADIENTS)


# updates


def _stepped_rows(v: np.ndarray, g: np.ndarray, a: np.ndarray, b: np.ndarray, optimizer: str, rate: float, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors and both states after one step; a row without a gradient stays as it is."""
    moved = np.any(g != 0, axis=1, keepdims=True)
    if optimizer == "sgd":
        return v - rate * g, a, b
    if optimizer == "adagrad":
        a = a + g * g
        return v - rate * g / (np.sqrt(a) + 1e-10), a, b
    if optimizer != "adam":
        raise ValueError(f"no optimizer {optimizer}")
    a, b = np.where(moved, 0.9 * a + 0.1 * g, a), np.where(moved, 0.999 * b + 0.001 * g * g, b)
    change = rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return np.where(moved, v - change, v), a, b


def _bounded(g: np.ndarray, trainer: Trainer) -> np.ndarray:
    if trainer.clip_value is not None:
        g = np.clip(g, -trainer.clip_value, trainer.clip_value)
    if trainer.clip_norm is not None:
        g = g * np.minimum(1, trainer.clip_norm / np.maximum(np.linalg.norm(g, axis=-1, keepdims=True), 1e-12))
    return g


def merged(table: DataFrame, gradients: DataFrame, width: int, trainer: Trainer, rate: float, step: int, constrain: str | None = None, frozen: int = 0) -> DataFrame:
    """The vectors (id, v, a, b) after a step along the sums of their gradients (id, g)."""
    rows = table.select("id", F.lit(0).alias("later"), "v", "a", "b").unionByName(gradients.select("id", F.lit(1).alias("later"), F.col("g").alias("v"), F.array().cast("array<double>").alias("a"), F.array().cast("array<double>").alias("b")))
    plain = replace(trainer, schedule=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # id, v, a, b and the gradient so far of the last id, which the next batch may go on with

        def out(ids, v, a, b, g):
            g = _bounded(g, plain)
            if frozen:
                g[:, width - frozen :] = 0
            v, a, b = _stepped_rows(v, g, a, b, plain.optimizer, rate, step)
            if constrain:
                size = np.linalg.norm(v[:, : width - frozen], axis=1, keepdims=True)
                v[:, : width - frozen] /= np.maximum(size, 1e-12) if constrain == "unit" else np.maximum(size, 1)
            return pa.RecordBatch.from_arrays([pa.array(ids), lists(v), lists(a), lists(b)], names=["id", "v", "a", "b"])

        for batch in batches:
            ids, later, v = batch.column("id").to_numpy(), batch.column("later").to_numpy() > 0, matrix(batch.column("v"))
            # gradients of ids without a vector have nothing to move
            a, b = (matrix(batch.column(c).filter(pa.array(~later))).reshape(-1, width) for c in "ab")
            if held is not None:
                ids, later, v = np.append(held[0], ids), np.append(False, later), np.concatenate([held[1], v])
                a, b = np.concatenate([held[2], a]), np.concatenate([held[3], b])
            at = np.flatnonzero(~later)
            if not len(at):
                continue
            group = np.cumsum(~later) - 1
            g = np.zeros((len(at), width))
            mine = later & (group >= 0)
            mine[mine] = ids[mine] == ids[at[group[mine]]]
            np.add.at(g, group[mine], v[mine])
            if held is not None:
                g[0] += held[4][0]
            if len(at) > 1:
                yield out(ids[at[:-1]], v[at[:-1]].copy(), a[:-1], b[:-1], g[:-1])
            held = ids[at[-1:]], v[at[-1:]].copy(), a[-1:], b[-1:], g[-1:]
        if held is not None:
            yield out(*held)

    kind = "id long, v array<double>, a array<double>, b array<double>"
    return rows.repartition("id").sortWithinPartitions("id", "later").mapInArrow(run, kind)


def _with_states(table: DataFrame) -> DataFrame:
    zeros = F.transform("v", lambda x: F.lit(0.0))
    return table.select("id", "v", zeros.alias("a"), zeros.alias("b"))


def to_tokens(gradients: DataFrame, tokens: DataFrame) -> DataFrame:
    """Gradients of entities (id, g) as those of their tokens (id, token), of whose vectors an entity's is the mean."""
    n = tokens.groupBy("id").agg(F.count("*").alias("n"))
    shared = gradients.select("id", "g").join(n, "id").join(tokens, "id")
    return shared.select(F.col("token").alias("id"), F.transform("g", lambda x: x / F.col("n")).alias("g"))


def train(
    model: Model, triples: DataFrame, trainer: Trainer, epochs: int, assumption: str = "sampled", sides: tuple[str, ...] = ("t",), listeners: tuple = (), first_epoch: int = 0, tokens: DataFrame | None = None, vocabulary: DataFrame | None = None
) -> tuple[Model, list[float]]:
    """The model after some epochs and the mean loss of each.

    ``assumption``: "sampled" takes each triple against corrupted copies, "all" scores all entities for the given ``sides`` of every pair.
    Listeners are called as ``listener(epoch, loss, model)`` after each epoch; one that returns True ends the training. Repeated
    triples count once; an empty table trains nothing and has the loss 0.

    With ``tokens`` (id, token) an entity's vector is the mean of those of its tokens in ``vocabulary`` (id, v), which is trained in place of
    the entities; the model returned has the entities that tokens make, and the vocabulary's vectors as its attribute ``vocabulary``.
    """
    wide, narrow = model.form.widths(model.dims)
    triples = staged(triples.select("h", "r", "t").distinct())
    n, num_entities = triples.count(), model.entities.count()
    statistics = sampler_statistics(triples, trainer.sampler) if assumption == "sampled" else None
    entities, relations = staged(_with_states(model.entities)), staged(_with_states(model.relations))
    made = None
    if tokens is not None:
        from ..operators.messages import token_vectors

        tokens, made = staged(tokens.select("id", "token").distinct()), staged(_with_states(vocabulary))
        entities = staged(_with_states(token_vectors(tokens, made, wide)))
    states = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in model.weights.items()}
    terms = {"pointwise": 1 + trainer.negatives, "pairwise": trainer.negatives, "setwise": 1}[LOSSES[trainer.loss].kind] if assumption == "sampled" else 1
    if assumption != "sampled":
        pairs = {s: triples.select(*(c for c in "hrt" if c != s)).distinct().count() for s in sides}
        terms = num_entities if LOSSES[trainer.loss].kind == "pointwise" else 1
    current, losses, step, names = replace(model, entities=entities, relations=relations), [], 0, list(model.weights)
    for epoch in range(first_epoch, first_epoch + epochs):
        rate = trainer.rate * (trainer.schedule(epoch) if trainer.schedule else 1.0)
        total = 0.0
        for b in range(trainer.batches):
            step += 1
            seed = trainer.seed + 1000 * epoch + b
            batch = triples if trainer.batches == 1 else triples.where(F.pmod(F.xxhash64(F.lit(trainer.seed + epoch), "h", "r", "t"), F.lit(trainer.batches)) == b)
            if assumption == "sampled":
                found = pair_gradients(current, batch, sampled(batch, trainer.sampler, trainer.negatives, num_entities, seed, statistics), trainer, trainer.batches / max(1, n * terms), terms)
            else:
                found = None
                for s in sides:
                    part = all_gradients(current, batch, s, trainer, trainer.batches / max(1, pairs[s] * terms * len(sides)), num_entities)
                    found = part if found is None else found.unionByName(part)
            found = staged(found)
            for r in _weight_rows(found):
                g = np.array(r.g)
                if r.kind == _LOSS:
                    total += float(g[0])
                else:
                    name = names[r.id]
                    w = current.weights[name].reshape(1, -1)
                    a, c = (x.reshape(1, -1) for x in states[name])
                    w, a, c = _stepped_rows(w, _bounded(g.reshape(1, -1), trainer), a, c, trainer.optimizer, rate, step)
                    shape = current.weights[name].shape
                    current.weights = current.weights | {name: w.reshape(shape)}
                    states[name] = a.reshape(shape), c.reshape(shape)
            before = entities, relations, found
            own = found.where(F.col("kind") == _ENTITY)
            if tokens is None:
                entities = staged(merged(entities, own, wide, trainer, rate, step, trainer.constrain, trainer.frozen))
            else:
                old, made = made, staged(merged(made, to_tokens(own, tokens), wide, trainer, rate, step, trainer.constrain, trainer.frozen))
                entities = staged(_with_states(token_vectors(tokens, made, wide)))
                dropped(old)
            if narrow:
                relations = staged(merged(relations, found.where(F.col("kind") == _RELATION), narrow, trainer, rate, step))
            current = replace(current, entities=entities, relations=relations)
            for table in before:
                if table is not relations:
                    dropped(table)
        losses.append(total / trainer.batches)
        if any([listener(epoch, losses[-1], current) for listener in listeners]):
            break
    plain = lambda t: t.select("id", "v")
    out = replace(current, entities=plain(entities), relations=plain(relations))
    out.vocabulary = plain(made) if made is not None else None
    return out, losses


def _weight_rows(found: DataFrame) -> list:
    """Sums of the gradients of shared weights and of the loss: element by element, so that the driver gets one row a weight."""
    rows = found.where(F.col("kind") >= _WEIGHT).select("kind", "id", F.posexplode("g").alias("at", "x")).groupBy("kind", "id", "at").agg(F.sum("x").alias("x"))
    return rows.groupBy("kind", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("g")).collect()


def loss_on(model: Model, triples: DataFrame, trainer: Trainer, seed: int = 0) -> float:
    """The mean loss of triples that aren't trained on, against sampled copies."""
    triples = triples.select("h", "r", "t").distinct()
    statistics = sampler_statistics(triples, trainer.sampler)
    terms = {"pointwise": 1 + trainer.negatives, "pairwise": trainer.negatives, "setwise": 1}[LOSSES[trainer.loss].kind]
    found = pair_gradients(model, triples, sampled(triples, trainer.sampler, trainer.negatives, model.entities.count(), seed, statistics), replace(trainer, penalties={}), 1 / max(1, triples.count() * terms), terms)
    return float(found.where(F.col("kind") == _LOSS).agg(F.coalesce(F.sum(F.col("g")[0]), F.lit(0.0))).first()[0])
