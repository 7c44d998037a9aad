"""Message passing over triples: what entities become of their neighbours' vectors.

Messages are summed by tail and relation before any weight is applied to them, so a relation's matrix meets each pair of them once
and a hub's messages are combined on their way. Vectors are columns (id, v) of one width, small enough for a sum
column an element; entities without messages keep what their own part gives them. Repeated triples send repeated messages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.engine import lists, matrix


def _sums(rows: DataFrame, keys: list[str], width: int, mean: bool = False) -> DataFrame:
    """(keys, v): element-wise sums, or means, of vectors."""
    total = F.avg if mean else F.sum
    return rows.groupBy(*keys).agg(F.array(*(total(F.col("v")[i]) for i in range(width))).alias("v"))


def neighbour_means(triples: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(id, v): the mean of the vectors of all heads that a tail has."""
    sent = triples.join(vectors.select(F.col("id").alias("h"), "v"), "h")
    return _sums(sent, ["t"], width, mean=True).withColumnRenamed("t", "id")


def weighted_messages(triples: DataFrame, vectors: DataFrame, width: int, weight: str) -> DataFrame:
    """(id, v): the sum of heads' vectors times a column ``weight`` of the triples."""
    sent = triples.join(vectors.select(F.col("id").alias("h"), "v"), "h")
    return _sums(sent.select("t", F.transform("v", lambda x: x * F.col(weight)).alias("v")), ["t"], width).withColumnRenamed("t", "id")


def basis_weights(coefficients: np.ndarray, bases: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Matrices of relations as mixtures of shared ones: coefficients (relations, bases), bases (bases, out, in)."""
    return lambda r: np.einsum("nb,boi->noi", coefficients[r], bases)


def block_weights(blocks: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Block-diagonal matrices of relations: blocks (relations, blocks, out, in)."""

    def run(r: np.ndarray) -> np.ndarray:
        n, high, wide = blocks.shape[1:]
        out = np.zeros((len(r), n * high, n * wide))
        for b in range(n):
            out[:, b * high : (b + 1) * high, b * wide : (b + 1) * wide] = blocks[r, b]
        return out

    return run


def _applied(rows: DataFrame, id_: str, weights: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, v): each row's matrix, by its column r, times its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                w = weights(part.column("r").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(id_), lists((w * matrix(part.column("v"))[:, None, :]).sum(-1))], names=["id", "v"])

    return rows.select(id_, "r", "v").mapInArrow(run, "id long, v array<double>")


def relational_layer(triples: DataFrame, vectors: DataFrame, width: int, weights: Callable[[np.ndarray], np.ndarray], own: np.ndarray, activate: bool = True) -> DataFrame:
    """A relational graph convolution: own matrix times own vector, and for each relation its matrix times the mean of the heads' vectors."""
    sent = triples.join(vectors.select(F.col("id").alias("h"), "v"), "h")
    means = _sums(sent, ["t", "r"], width, mean=True)
    mine = _applied(vectors.withColumn("r", F.lit(0).cast("long")), "id", lambda r: np.broadcast_to(own, (len(r), *own.shape)))
    out = _sums(_applied(means, "t", weights).unionByName(mine), ["id"], own.shape[0])
    return out.select("id", F.transform("v", lambda x: F.greatest(x, F.lit(0.0))).alias("v")) if activate else out


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a - b


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * b


def correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Circular correlation of rows."""
    d = a.shape[1]
    return (a[:, None, :] * b[:, (np.arange(d)[:, None] + np.arange(d)) % d]).sum(-1)


def composed_layer(triples: DataFrame, vectors: DataFrame, relations: DataFrame, width: int, compose: Callable, forward: np.ndarray, backward: np.ndarray, loop: np.ndarray, loop_vector: np.ndarray, relation_weight: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Vectors of entities and relations after a layer whose messages are compositions of an entity's and a relation's vector.

    Each way along a triple has its own matrix, and so has an entity's message to itself, with ``loop_vector`` for a relation; the sum
    is the mean of the three. Messages are divided by the square root of both ends' degrees.
    """
    def directed(head: str, tail: str) -> DataFrame:
        out, into = triples.groupBy(head).agg(F.count("*").alias("a")), triples.groupBy(tail).agg(F.count("*").alias("b"))
        rows = triples.join(out, head).join(into, tail).select(F.col(head).alias("h"), "r", F.col(tail).alias("t"), (1 / F.sqrt(F.col("a") * F.col("b"))).alias("scale"))
        return rows.join(vectors.select(F.col("id").alias("h"), "v"), "h").join(relations.select(F.col("id").alias("r"), F.col("v").alias("rv")), "r").select("t", "v", "rv", "scale")

    def messages(rows: DataFrame, weight: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = compose(matrix(batch.column("v")), matrix(batch.column("rv"))) * batch.column("scale").to_numpy()[:, None]
                yield pa.RecordBatch.from_arrays([batch.column("t"), lists(found)], names=["t", "v"])

        summed = _sums(rows.mapInArrow(run, "t long, v array<double>"), ["t"], width)
        return _applied(summed.withColumn("r", F.lit(0).cast("long")), "t", lambda r: np.broadcast_to(weight, (len(r), *weight.shape)))

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists((loop[None] * compose(v, np.broadcast_to(loop_vector, v.shape))[:, None, :]).sum(-1))], names=["id", "v"])

    every = messages(directed("h", "t"), forward).unionByName(messages(directed("t", "h"), backward)).unionByName(vectors.select("id", "v").mapInArrow(itself, "id long, v array<double>"))
    entities = _sums(every, ["id"], forward.shape[0]).select("id", F.transform("v", lambda x: F.tanh(x / 3)).alias("v"))
    turned = _applied(relations.select("id", "v").withColumn("r", F.lit(0).cast("long")), "id", lambda r: np.broadcast_to(relation_weight, (len(r), *relation_weight.shape)))
    return entities, turned


def token_vectors(tokens: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(id, v): entities as the mean of the vectors of their tokens (id, token); ids without a known token are left out."""
    return _sums(tokens.join(vectors.select(F.col("id").alias("token"), "v"), "token"), ["id"], width, mean=True)
