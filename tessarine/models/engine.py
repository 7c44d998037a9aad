"""Models as tables of vectors, and scores of triples and of all candidates in blocks.

A model's entities and relations are tables (id, v) of whole vectors; weights that all triples share are small arrays
on the driver, sent with the tasks. Scores of given triples come from three joins; those of all candidates for a set of
queries from pairs of blocks, a block of queries and a block of entities a row, each block of bounded size, so no task
holds more than two of them and no single query is ever a row for each candidate unless its scores are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splitting import unit_hash
from ..sources.staging import staged
from .forms import FORMS, Form, dimensions
from .tape import Value

#: Numbers that a broadcast product of two blocks may take at once in a task.
CELLS = 4_000_000


@dataclass
class Model:
    """``entities``, ``relations``: (id, v); ``weights``: by name; ``settings`` override those of the form."""

    name: str
    dims: dict[str, int]
    entities: DataFrame
    relations: DataFrame
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    settings: dict[str, object] = field(default_factory=dict)
    #: Vectors of tokens, where entities are made of them.
    vocabulary: DataFrame | None = None

    @property
    def form(self) -> Form:
        base = FORMS[self.name]
        return replace(base, settings=base.settings | self.settings)

    def scorer(self) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """A function of whole vectors (leading axes broadcast) that doesn't refer to any table."""
        form, dims, weights = self.form, self.dims, self.weights

        def score(h, r, t):
            return form(Value(h), Value(r), Value(t), {k: Value(x) for k, x in weights.items()}, dims).x

        return score


def _uniform(*key: object) -> Column:
    return unit_hash(*(F.lit(k) for k in key[1:]), seed=key[0])


def initial(ids: DataFrame, width: int, seed: int, how: str = "xavier_uniform") -> DataFrame:
    """(id, v): vectors of ``width`` numbers drawn by hashes of id and place, so that any cluster draws the same.

    ``how``: uniform (-1 to 1), normal, xavier_uniform, xavier_normal, unit (normal, scaled to length 1), phases (0 to 2 pi), zeros, ones.
    """
    places = F.sequence(F.lit(0), F.lit(width - 1)) if width else F.array().cast("array<int>")
    u = lambda i, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id", i), F.lit(1 << 52)) / F.lit(float(1 << 52))
    gauss = lambda i: F.sqrt(-2 * F.log(u(i, 0) + F.lit(2.0**-53))) * F.cos(2 * np.pi * u(i, 1))
    draws = {
        "uniform": lambda i: 2 * u(i, 0) - 1,
        "normal": gauss,
        "unit": gauss,
        "xavier_uniform": lambda i: (2 * u(i, 0) - 1) * float(np.sqrt(3 / max(1, width))),
        "xavier_normal": lambda i: gauss(i) * float(np.sqrt(1 / max(1, width))),
        "phases": lambda i: 2 * np.pi * u(i, 0),
        "zeros": lambda i: F.lit(0.0),
        "ones": lambda i: F.lit(1.0),
    }
    out = ids.select("id", F.transform(places, draws[how]).alias("v"))
    if how == "unit":
        out = out.select("id", F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(1e-300), lambda a, y: a + y * y))).alias("v"))
    return out


def created(name: str, entities: DataFrame, relations: DataFrame, d: int, seed: int = 0, initializer: str = "xavier_uniform", relation_initializer: str | None = None, settings: dict | None = None, **dims: int) -> Model:
    """A new model over ``entities`` and ``relations`` (id)."""
    model = Model(name, dimensions(FORMS[name], d, **dims), entities, relations, settings=settings or {})
    wide, narrow = model.form.widths(model.dims)
    rng, (_, _, shapes) = np.random.default_rng(seed), model.form.sizes(model.dims)
    # a weight's last axis is what it is summed over
    model.weights = {k: rng.normal(size=s) * (1 / max(1, s[-1] if s else 1)) ** 0.5 for k, s in shapes.items()}
    start = relation_initializer or ("phases" if name == "rotate" else initializer)
    model.entities, model.relations = staged(initial(entities, wide, seed, initializer)), staged(initial(relations, narrow, seed + 1, start))
    return model


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def lists(rows: np.ndarray) -> pa.Array:
    """Rows as a column of lists."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim > 1 else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def with_vectors(triples: DataFrame, model: Model, sides: str = "hrt") -> DataFrame:
    """Triples of ids with the vectors hv, rv and tv; triples of unknown ids go."""
    for s in sides:
        table = model.relations if s == "r" else model.entities
        triples = triples.join(table.select(F.col("id").alias(s), F.col("v").alias(f"{s}v")), s)
    return triples


def score_triples(model: Model, triples: DataFrame, column: str = "score") -> DataFrame:
    """``triples`` (h, r, t as ids, and any other columns) with a column of scores. Triples of unknown ids go; repeated ones are each scored."""
    score, kept = model.scorer(), triples.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in triples.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, r, t = (matrix(batch.column(c)) for c in ("hv", "rv", "tv"))
            step = max(1, CELLS // max(1, h.shape[1] + r.shape[1] + t.shape[1]))
            found = [score(h[a : a + step], r[a : a + step], t[a : a + step]) for a in range(0, len(h), step)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.concatenate(found) if found else np.zeros(0))], names=[*kept, column])

    return with_vectors(triples, model).select(*kept, "hv", "rv", "tv").mapInArrow(run, f"{types}, `{column}` double")


def blocked(rows: DataFrame, vectors: list[str], others: list[str], size: int) -> DataFrame:
    """Rows gathered into blocks of at most ``size`` as they come: the columns as arrays, vectors end to end. A block's bytes are bounded by its size."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` array<double>" for c in vectors] + [f"`{c}` array<{kinds[c]}>" for c in others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ends = pa.array([0, part.num_rows], pa.int32())
                wide = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column(c).flatten() for c in vectors)]
                plain = [pa.ListArray.from_arrays(ends, pa.concat_arrays([part.column(c)])) for c in others]
                yield pa.RecordBatch.from_arrays([*wide, *plain], names=[*vectors, *others])

    return rows.select(*vectors, *others).mapInArrow(run, schema)


def against_all(model: Model, queries: DataFrame, side: str, consume: Callable, schema: str, keep: list[str], candidates: DataFrame | None = None, query_rows: int = 128, entity_rows: int = 2048) -> DataFrame:
    """Scores of all candidates in place of ``side`` ("h", "r" or "t") of every query, block by block.

    ``queries`` have the vectors of the other two sides and the columns ``keep``; ``candidates`` (id, v) are all entities or
    relations unless given. ``consume(scores, ids, columns)`` makes a record batch of ``schema`` from each pair of blocks: scores of (query,
    candidate), the candidates' ids, and the queries' columns as NumPy arrays.
    """
    score, fixed = model.scorer(), [s for s in "hrt" if s != side]
    table = candidates if candidates is not None else model.relations if side == "r" else model.entities
    asked = blocked(queries, [f"{s}v" for s in fixed], keep, query_rows)
    every = blocked(table.select(F.col("id").alias("candidate"), F.col("v").alias("candidate_v")), ["candidate_v"], ["candidate"], entity_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].values  # noqa: B023, E731
                ids = get("candidate").to_numpy()
                columns = {c: get(c).to_numpy(zero_copy_only=False) for c in keep}
                n = len(next(iter(columns.values())))
                wide = get("candidate_v").to_numpy().reshape(len(ids), -1)[None]
                own = {s: get(f"{s}v").to_numpy().reshape(n, -1)[:, None] for s in fixed}
                cost = max(1, sum(v.shape[-1] for v in own.values()) + wide.shape[-1])
                step = max(1, CELLS // (cost * max(1, len(ids))))
                found = []
                for a in range(0, n, step):
                    v = {s: x[a : a + step] for s, x in own.items()} | {side: wide}
                    found.append(np.broadcast_to(score(v["h"], v["r"], v["t"]), (min(step, n - a), len(ids))))
                yield consume(np.concatenate(found), ids, columns)

    return asked.crossJoin(every).mapInArrow(run, schema)


def top_candidates(model: Model, queries: DataFrame, side: str, k: int, keep: list[str], candidates: DataFrame | None = None) -> DataFrame:
    """The k best candidates of every query, ties by id: the queries' columns ``keep``, candidate and score. Each block sends k a query at most."""
    from ..operators.graph import top_per_group

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["candidate long", "score double"])

    def consume(scores, ids, columns):
        best = min(k, len(ids))
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=-1)[:, :best]
        who = np.repeat(np.arange(len(scores)), best)
        return pa.RecordBatch.from_arrays([*(pa.array(columns[c][who]) for c in keep), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(scores, order, 1).ravel())], names=[*keep, "candidate", "score"])

    found = against_all(model, queries, side, consume, schema, keep, candidates)
    return top_per_group(found, keep, [F.desc("score"), "candidate"], k).drop("nth")


def save(model: Model, path: str) -> None:
    """The model's tables and weights below ``path``, in any file system that Spark knows."""
    spark = model.entities.sparkSession
    model.entities.write.mode("overwrite").parquet(f"{path}/entities")
    model.relations.write.mode("overwrite").parquet(f"{path}/relations")
    rows = [("weight", k, list(map(int, w.shape)), w.ravel().tolist()) for k, w in model.weights.items()]
    rows += [("dimension", k, [], [float(n)]) for k, n in model.dims.items()] + [("name", model.name, [], [])]
    spark.createDataFrame(rows, "kind string, name string, shape array<int>, x array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")


def load(spark: SparkSession, path: str, settings: dict | None = None) -> Model:
    """A model from ``save``; settings of the form aren't saved."""
    rows = spark.read.parquet(f"{path}/weights").collect()
    weights = {r.name: np.array(r.x).reshape(r["shape"]) for r in rows if r.kind == "weight"}
    dims = {r.name: int(r.x[0]) for r in rows if r.kind == "dimension"}
    name = next(r.name for r in rows if r.kind == "name")
    return Model(name, dims, spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations"), weights, settings or {})
