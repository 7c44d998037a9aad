"""Training of bilinear embeddings by full-batch gradient steps, as sums over blocks of entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import dropped, staged
from .splitting import basic_negatives

#: Numbers in a block of vectors, messages that are held before they are summed or sent, and messages of one round of an epoch.
_NUMBERS, _HELD, _ROUND = 1 << 18, 1 << 19, 16_000_000
_MESSAGES = "block long, kind int, part binary, code binary, other binary"
_BLOCKS = "kind int, id long, sums binary, n long, loss double"


def initial_vectors(ids: DataFrame, dim: int, seed: int) -> DataFrame:
    """(id, v) with elements drawn evenly from [-1, 1) / sqrt(dim) by hashes."""
    draw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(1 << 52)) / F.lit(float(1 << 51)) - 1) / F.lit(dim**0.5))
    return ids.select("id", draw.alias("v"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def _hashed_int(value: int, seed: np.ndarray) -> np.ndarray:
    """XXH64 of an int as Spark has it."""
    return _final(_turned(seed + _P5 + np.uint64(4) ^ np.array([value & 0xFFFFFFFF], np.uint64) * _P1, 23) * _P2 + _P3)


def drawn(ids: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """The vectors that ``initial_vectors`` gives these ids."""
    with np.errstate(over="ignore"):
        first = _hashed_int(seed, np.array([42], np.uint64)) + _P5 + np.uint64(8)
        base = _final(_turned(first ^ _turned(ids.astype(np.uint64) * _P2, 31) * _P1, 27) * _P1 + _P4)
        out = np.empty((len(ids), dim))
        for i in range(dim):
            # the low 52 bits are those of pmod, negative numbers included
            out[:, i] = ((_hashed_int(i, base) & np.uint64((1 << 52) - 1)) / float(1 << 51) - 1) / dim**0.5
    return out


def scored(ids: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Triples with their vectors and the score sum h r t."""
    found = ids.join(entities.select(F.col("id").alias("h"), F.col("v").alias("hv")), "h").join(entities.select(F.col("id").alias("t"), F.col("v").alias("tv")), "t")
    found = found.join(relations.select(F.col("id").alias("r"), F.col("v").alias("rv")), "r")
    score = F.expr("aggregate(sequence(0, size(hv) - 1), 0D, (a, i) -> a + hv[i] * rv[i] * tv[i])")
    return found.withColumn("score", score)


def _dealt(block: np.ndarray, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Messages as one row for each block."""
    by = np.argsort(block.astype(np.uint16) if len(block) and block.max() < 1 << 16 else block, kind="stable")
    block, columns = block[by], [c[by] for c in columns]
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(block))
    cells = [pa.array([c[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(block[cuts], pa.int64()), pa.array(np.full(len(cuts), kind, np.int32)), *cells], names=["block", "kind", "part", "code", "other"])


def _sent(samples: DataFrame, known: np.ndarray, blocks: int, rounds: int, k: int, by_source: bool) -> DataFrame:
    """The messages of round ``k``: of every sample both ways, what one end gets from the other, by the block of the end that is asked.

    An entity's block is its id modulo ``blocks`` and its part what that leaves. code: place of the relation, label, whether the receiver is the head.
    ``by_source``: messages stand in the source's block and name the receiver; else the other way round.
    """

    def packed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        to, source, code = (np.concatenate(c) for c in zip(*held, strict=True))
        at, other = (source, to) if by_source else (to, source)
        yield _dealt(at % blocks, 1, (at // blocks).astype(np.int32), code, other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            h, r, t, h2, t2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            place = np.searchsorted(known, r).astype(np.int32) * 4
            there = np.flatnonzero(h2 >= 0)
            for head, tail, own, label in ((h, t, place, 2), (h2[there], t2[there], place[there], 0)):
                for to, source, side in ((head, tail, 1), (tail, head, 0)):
                    mine = np.flatnonzero(to % blocks % rounds == k)
                    held.append((to[mine], source[mine], own[mine] + np.int32(label + side)))
                    n += len(mine)
            if n >= _HELD:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    return samples.mapInArrow(run, _MESSAGES)


def _fetched(messages: DataFrame, vectors: DataFrame, blocks: int, dim: int) -> DataFrame:
    """Messages by the blocks of their receivers, with the vectors of their sources, which stream past sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, own = [], 0, None

        def packed() -> Iterator[pa.RecordBatch]:
            to, code, v = (np.concatenate(c) for c in zip(*held, strict=True))
            for some in np.array_split(np.arange(len(to)), -(-len(to) // _HELD)):
                yield _dealt(to[some] % blocks, 1, (to[some] // blocks).astype(np.int32), code[some], v[some])

        for batch in batches:
            kinds, parts, codes, others = (batch.column(c) for c in ("kind", "part", "code", "other"))
            for row in range(batch.num_rows):
                if kinds[row].as_py() == 0:
                    own = np.frombuffer(others[row].as_buffer()).reshape(-1, dim)
                    continue
                part, code, to = (np.frombuffer(c[row].as_buffer(), kind) for c, kind in ((parts, np.int32), (codes, np.int32), (others, np.int64)))
                held.append((to, code, own[part]))
                n += len(to)
                if n >= _HELD:
                    yield from packed()
                    held, n = [], 0
        if n:
            yield from packed()

    return _streamed(vectors.unionByName(messages)).mapInArrow(run, _MESSAGES)


def _streamed(rows: DataFrame) -> DataFrame:
    """Rows by block, each block's vectors before its messages."""
    return rows.repartition("block").sortWithinPartitions("block", "kind")


def _moved(rows: DataFrame, known: np.ndarray, relation: np.ndarray, num_entities: int, blocks: int, dim: int, rate: float, draw: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Blocks moved against the means of their messages' gradients (kind 0), and for each relation sums of gradients, samples and losses of a task (kind 1).

    A block without vectors has those that ``draw`` gives its ids, and so have its messages' sources.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, samples, losses = np.zeros((len(known), dim)), np.zeros(len(known), np.int64), np.zeros(len(known))
        block, own, total, count, fresh, held, n = -1, None, None, None, False, [], 0

        def settle() -> None:
            nonlocal held, n
            if not n:
                return
            part, code, other = (np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
            for a in range(0, len(part), 1 << 16):
                p, c = part[a : a + (1 << 16)], code[a : a + (1 << 16)]
                source = draw(other[a : a + (1 << 16)]) if fresh else other[a : a + (1 << 16)]
                r, label, heads = c >> 2, (c >> 1) & 1, np.flatnonzero(c & 1)
                mine = own[p]
                pull = source * relation[r]
                score = (mine * pull).sum(axis=1)
                with np.errstate(over="ignore"):
                    slope = 1 / (1 + np.exp(-score)) - label
                pull *= slope[:, None]
                both = (mine[heads] * source[heads]) * slope[heads, None]
                r = r[heads]
                loss = (np.maximum(score, 0) + np.log1p(np.exp(-np.abs(score))) - label * score)[heads]
                count[:] += np.bincount(p, minlength=len(own))
                seen, place = np.unique(r, return_inverse=True)
                samples[seen] += np.bincount(place, minlength=len(seen))
                losses[seen] += np.bincount(place, loss, len(seen))
                for i in range(dim):
                    total[:, i] += np.bincount(p, pull[:, i], len(own))
                    sums[seen, i] += np.bincount(place, both[:, i], len(seen))

        def done() -> Iterator[pa.RecordBatch]:
            settle()
            if block >= 0:
                moved = own - rate * total / np.maximum(count, 1)[:, None]
                yield pa.RecordBatch.from_pydict({"kind": pa.array([0], pa.int32()), "id": pa.array([block], pa.int64()), "sums": [moved.tobytes()], "n": pa.array([0], pa.int64()), "loss": [0.0]})

        for batch in batches:
            blocks_, kinds, parts, codes, others = (batch.column(c) for c in ("block", "kind", "part", "code", "other"))
            for row in range(batch.num_rows):
                if kinds[row].as_py() == 0:
                    yield from done()
                    block, fresh = blocks_[row].as_py(), not others[row].is_valid
                    own = draw(np.arange(block, num_entities, blocks)) if fresh else np.frombuffer(others[row].as_buffer()).reshape(-1, dim)
                    total, count = np.zeros(own.shape), np.zeros(len(own), np.int64)
                    continue
                other = np.frombuffer(others[row].as_buffer(), np.int64 if fresh else np.float64)
                held.append((np.frombuffer(parts[row].as_buffer(), np.int32), np.frombuffer(codes[row].as_buffer(), np.int32), other if fresh else other.reshape(-1, dim)))
                n += len(held[-1][0])
                if n >= _HELD // 2:
                    settle()
        yield from done()
        some = np.flatnonzero(samples)
        for a in range(0, len(some), 10_000):
            at = some[a : a + 10_000]
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(len(at), np.int32)), "id": pa.array(known[at]), "sums": pa.array([x.tobytes() for x in sums[at]], pa.binary()), "n": pa.array(samples[at]), "loss": pa.array(losses[at])})

    return _streamed(rows).mapInArrow(run, _BLOCKS)


def _rows(tables: DataFrame, num_entities: int, blocks: int, dim: int) -> DataFrame:
    """(id, v) of all entities in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.arange(batch.column(0)[row].as_py(), num_entities, blocks)
                v = np.frombuffer(batch.column(1)[row].as_buffer())
                for a in range(0, len(ids), 10_000):
                    some = ids[a : a + 10_000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), pa.array(v[a * dim : (a + len(some)) * dim]))
                    yield pa.RecordBatch.from_arrays([pa.array(some), lists], names=["id", "v"])

    return tables.where("kind = 0").select("id", "sums").mapInArrow(run, "id long, v array<double>")


def train(ids: DataFrame, num_entities: int, dim: int = 16, epochs: int = 5, rate: float = 1.0, seed: int = 0, round_size: int = _ROUND) -> tuple[DataFrame, DataFrame, list[float]]:
    """Entity and relation vectors (id, v) of a DistMult model after some epochs, and the mean logistic loss of each.

    An epoch is one pass over all triples and as many corrupted ones, in rounds by receiving entity of about ``round_size``
    messages: each end of a sample gets its gradient from the other's vector, which is fetched block by block, so
    disk holds the messages of one round, however many triples there are. In the first epoch vectors are drawn where they
    are needed. The blocks are tables in the shared folder, so a lost executor costs part of one round; no table of entity
    vectors is ever on the driver or in one task. Those of relations are: every worker holds them.
    """
    spark = ids.sparkSession
    ids = staged(ids.select(*(F.col(c).cast("long").alias(c) for c in "hrt")))
    found = initial_vectors(ids.select(F.col("r").alias("id")).distinct(), dim, seed + 1).orderBy("id").toPandas()
    known, relation = found["id"].to_numpy(np.int64), np.array(found["v"].tolist(), float).reshape(-1, dim)
    messages = 4 * ids.count()
    most = max(1, -(-messages // round_size))
    blocks = max(1, min(num_entities, max(-(-num_entities * dim // _NUMBERS), 12 * most)))
    draw = lambda x: drawn(x, dim, seed)
    empty, losses, tables = spark.range(blocks).select(F.col("id").alias("block"), F.lit(0).alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in ("part", "code", "other"))), [], []
    for epoch in range(epochs):
        if num_entities > 1:
            samples = basic_negatives(ids, num_entities, 1, seed=seed + 2 * epoch + 2).select("positive_h", "r", "positive_t", "h", "t")
        else:
            samples = ids.select("h", "r", "t", F.lit(-1).cast("long").alias("h2"), F.lit(-1).cast("long").alias("t2"))
        vectors = empty if not tables else reduce(DataFrame.unionByName, tables).where("kind = 0").select(F.col("id").alias("block"), F.lit(0).alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in ("part", "code")), F.col("sums").alias("other"))
        # a message of a drawn vector is its id alone
        rounds = min(blocks, most if tables else max(1, -(-most // 8)))
        after = []
        for k in range(rounds):
            sent = _sent(samples, known, blocks, rounds, k, bool(tables))
            if tables:
                sent = _fetched(sent, vectors, blocks, dim)
            own = vectors.where(F.col("block") % rounds == k)
            after.append(staged(_moved(own.unionByName(sent), known, relation, num_entities, blocks, dim, rate, draw)))
        sums, samples_, loss = np.zeros(relation.shape), np.zeros(len(known)), 0.0
        for table in after:
            for row in table.where("kind = 1").toLocalIterator():
                at = np.searchsorted(known, row.id)
                sums[at] += np.frombuffer(row.sums)
                samples_[at] += row.n
                loss += row.loss
        relation = relation - rate * sums / np.maximum(samples_, 1)[:, None]
        losses.append(loss / samples_.sum() if samples_.sum() else None)
        for table in tables:
            dropped(table)
        tables = after
    dropped(ids)
    relations = spark.createDataFrame(list(zip(known.tolist(), relation.tolist(), strict=True)), "id long, v array<double>")
    if not tables:
        return initial_vectors(spark.range(num_entities), dim, seed), relations, losses
    return _rows(reduce(DataFrame.unionByName, tables), num_entities, blocks, dim), relations, losses


def predictions(asked: DataFrame, entities: DataFrame, relations: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The k best unknown tails of every asked (h, r), with score; known (h, r, t) are left out. Scored block by block, so no query is a row for each entity."""
    from ..models.engine import Model
    from ..models.forms import FORMS, dimensions
    from .prediction import predict_target

    size = entities.select(F.size("v").alias("n")).first()
    model = Model("distmult", dimensions(FORMS["distmult"], size.n if size else 1), entities, relations)
    return predict_target(model, asked, "tail", k, known=known, drop_known=True)
