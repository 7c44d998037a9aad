"""Queries of a model: the missing side of triples, the best triples of all, and scores of given ones.

Ties go to the smaller ids. Ids without a vector have no prediction; repeated queries are one. Known triples can be left out
or marked: ``known`` scores are looked up after as many more candidates were kept as a query has known ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.engine import CELLS, Model, against_all, blocked, matrix, score_triples, top_candidates, with_vectors
from ..sources.staging import staged
from .graph import top_per_group

_FIXED = {"h": ["r", "t"], "t": ["h", "r"], "r": ["h", "t"]}
SIDES = {"head": "h", "relation": "r", "tail": "t"}


def predict_target(model: Model, asked: DataFrame, side: str, k: int | None = None, targets: DataFrame | None = None, known: DataFrame | None = None, drop_known: bool = False) -> DataFrame:
    """Candidates for ``side`` ('head', 'relation', 'tail') of every query in ``asked`` (the other two columns of h, r, t), with score and, if ``known`` is given, in_known.

    The best ``k`` of each query, or all. ``targets`` (id) are the only candidates. With ``drop_known`` known triples are no candidates.
    """
    s = SIDES[side]
    fixed = _FIXED[s]
    queries = with_vectors(asked.select(*fixed).distinct(), model, "".join(fixed))
    table = model.relations if s == "r" else model.entities
    candidates = table if targets is None else table.join(targets.select("id").distinct(), "id", "left_semi")
    if drop_known and known is not None:
        # a query is asked for as many more as it has known ones, by size of that number, so that none is asked for far more than it needs
        n = known.groupBy(*fixed).agg(F.count_distinct(s).alias("known"))
        queries = queries.join(n, fixed, "left").withColumn("more", F.coalesce(F.ceil(F.log2(F.col("known") + 1)), F.lit(0)).cast("int"))
        found = None
        for more in sorted(r.more for r in queries.select("more").distinct().collect()):
            part = _best(model, queries.where(F.col("more") == more), s, None if k is None else k + 2**more - 1, fixed, candidates)
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = _best(model, queries, s, k, fixed, candidates)
    else:
        found = _best(model, queries, s, k, fixed, candidates)
    if known is None:
        return found
    seen = known.select("h", "r", "t").distinct()
    if drop_known:
        free = found.join(seen, ["h", "r", "t"], "left_anti")
        return free if k is None else top_per_group(free, fixed, [F.desc("score"), s], k).drop("nth").select("h", "r", "t", "score")
    marked = found.join(seen.withColumn("in_known", F.lit(True)), ["h", "r", "t"], "left")
    return marked.select("h", "r", "t", "score", F.coalesce("in_known", F.lit(False)).alias("in_known"))


def _best(model: Model, queries: DataFrame, s: str, k: int | None, fixed: list[str], candidates: DataFrame) -> DataFrame:
    if k is None:
        found = all_scores(model, queries, s, fixed, candidates)
    else:
        found = top_candidates(model, queries, s, k, fixed, candidates).withColumnRenamed("candidate", s)
    return found.select("h", "r", "t", "score")


def all_scores(model: Model, queries: DataFrame, s: str, fixed: list[str], candidates: DataFrame | None = None) -> DataFrame:
    """Every candidate of every query with its score."""

    def spread(scores, ids, columns):
        n, m = scores.shape
        return pa.RecordBatch.from_arrays([*(pa.array(np.repeat(columns[c], m)) for c in fixed), pa.array(np.tile(ids, n)), pa.array(scores.ravel())], names=[*fixed, s, "score"])

    return against_all(model, queries, s, spread, ", ".join(f"{c} long" for c in [*fixed, s]) + ", score double", fixed, candidates)


def predict_all(model: Model, k: int, relations: DataFrame | None = None) -> DataFrame:
    """The ``k`` best of all triples (h, r, t, score). Each pair of blocks sends its k best, whatever the number of entities.

    Where scores are sums of h r t, those that cannot be among the best are told by the lengths of their vectors, which loses nothing, and the rest are matrix products.
    """
    wanted = model.relations if relations is None else model.relations.join(relations.select("id").distinct(), "id", "left_semi")
    schema = "h long, r long, t long, score double"
    if model.form.product:
        return _best_products(model, k, wanted, schema).orderBy(F.desc("score"), "h", "r", "t").limit(k)
    # the queries are each block of heads with each relation, made where they are scored
    heads = model.entities.select(F.col("id").alias("h"), F.col("v").alias("hv"))
    queries = heads.crossJoin(wanted.select(F.col("id").alias("r"), F.col("v").alias("rv")))

    def consume(scores, ids, columns):
        flat = scores.ravel()
        some = np.argpartition(-flat, min(k, len(flat)) - 1)[: min(k, len(flat))]
        # all that tie with the last one take part in the choice by ids
        some = np.flatnonzero(flat >= flat[some].min())
        i, j = some // scores.shape[1], some % scores.shape[1]
        return _best_rows(k, columns["h"][i], columns["r"][i], ids[j], flat[some])

    found = against_all(model, queries, "t", consume, schema, ["h", "r"])
    return found.orderBy(F.desc("score"), "h", "r", "t").limit(k)


def _best_rows(k: int, h: np.ndarray, r: np.ndarray, t: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((t, r, h, -score))[:k]
    return pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (h, r, t, score)], names=["h", "r", "t", "score"])


def _best_products(model: Model, k: int, wanted: DataFrame, schema: str, rows: int = 32768, some: int = 2048) -> DataFrame:
    """The k best triples of each task under a score that is the sum of h r t.

    Triples of the entities with the largest numbers give a k-th best score. By Cauchy and Schwarz a score is at most the length of h r (element by
    element) times that of t, and that of r t times that of h: for a relation, only entities whose product with it is long enough are heads or tails of
    others. It is also at most the product of the lengths of h and t with their numbers weighed by the root of |r|, which leaves out pairs of these.
    As h and t may change places, each pair is multiplied once. Scores are the form's own: matrix products only choose, with a margin for their rounding.
    """
    score, width = model.scorer(), model.form.widths(model.dims)[1]
    spread = 4 * max(1, model.entities.sparkSession.sparkContext.defaultParallelism)
    step = max(1, CELLS // max(1, width))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, v = (pa.concat_arrays(x) for x in ([p.column(0) for p in parts], [p.column(1).flatten() for p in parts]))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, v)], names=["id", "v"])

    entities = staged(model.entities.select("id", "v"))
    # partitions are filled to seven eighths, so that each is one block though they aren't of quite one size
    parts = -(-entities.count() * 8 // (7 * rows)) or 1
    table = staged(entities.repartition(parts).mapInArrow(gathered, "id array<long>, v array<double>").withColumn("block", F.monotonically_increasing_id()))
    asked = staged(blocked(wanted.select(F.col("id").alias("r"), F.col("v").alias("rv")).repartition(spread), ["rv"], ["r"], 2048))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x * x * x))
    strong = blocked(entities.orderBy(size.desc(), "id").limit(some).coalesce(1), ["v"], ["id"], some)

    def lengths(v: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.sqrt(v * v @ weight)

    def blocks(batches: Iterator[pa.RecordBatch], *columns: str | tuple[str, str]) -> Iterator[list]:
        """Ids and rows of vectors of each pair of columns, and the values of single ones, a row's blocks at a time."""
        for batch in batches:
            for row in range(batch.num_rows):
                out = []
                for c in columns:
                    if isinstance(c, str):
                        out.append(batch.column(c)[row].as_py())
                    else:
                        ids = batch.column(c[0])[row].values.to_numpy()
                        out += ids, batch.column(c[1])[row].values.to_numpy().reshape(len(ids), width)
                yield out

    def scores(hv: np.ndarray, rv: np.ndarray, tv: np.ndarray, h: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.concatenate([score(hv[h[x : x + step]], rv[r[x : x + step]], tv[t[x : x + step]]) for x in range(0, len(h), step)])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best scores of triples of strong entities, those that are longest under each relation."""
        best = np.zeros(0)
        for _, v, _, rv in blocks(batches, ("id", "v"), ("r", "rv")):
            n = min(12, len(v))
            for at in range(0, len(rv), 256):
                w = rv[at : at + 256]
                long_ = np.argpartition(-(np.abs(w) @ (v * v).T), n - 1, axis=1)[:, :n]
                x = v[long_]
                products = ((x * w[:, None]) @ x.transpose(0, 2, 1)).ravel()
                top = np.argpartition(-products, min(k, len(products)) - 1)[:k]
                i, a, b = top // (n * n), top // n % n, top % n
                best = np.sort(np.concatenate([best, scores(v, w, v, long_[i, a], i, long_[i, b])]))[-k:]
        yield pa.RecordBatch.from_arrays([pa.array(best[~np.isnan(best)])], names=["score"])

    # only a bound is found from these, so how many they are changes no result
    least = [x.score for x in asked.crossJoin(F.broadcast(strong)).mapInArrow(reached, "score double").orderBy(F.desc("score")).limit(k).collect()]
    least = least[-1] if len(least) == k else -np.inf

    def scaled(v: np.ndarray) -> tuple[np.ndarray, float]:
        """Squares of the numbers by the longest row's length, which small floats can hold, and that length."""
        longest = float(np.sqrt((v * v).sum(1).max()))
        return np.square(v / (longest or 1.0)).astype(np.float32), longest

    def partners(v2: np.ndarray, r2: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of entities whose product with a relation is at least ``share`` of the longest there could be, by relation, and where each relation's end."""
        with np.errstate(invalid="ignore"):
            # not "at least", so that what is no number stays
            at = np.flatnonzero(~(r2 @ v2.T < np.float32(max(0.0, share) ** 2 * (1 - 4e-7 * (width + 8)) - 1e-30)))
        return at % len(v2), np.searchsorted(at, len(v2) * np.arange(1, len(r2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bound = None, least

        def keep(i: int, r: int, hs, ts, hv, rv, tv, a: np.ndarray, b: np.ndarray) -> None:
            nonlocal held, bound
            exact = scores(hv, rv, tv, a, np.full(len(a), i), b)
            some_ = np.flatnonzero(exact >= bound)
            if len(some_) > k:
                # all that tie with the last one take part in the choice by ids
                some_ = some_[exact[some_] >= np.partition(exact[some_], len(some_) - k)[len(some_) - k]]
            new = [hs[a[some_]], np.full(len(some_), r), ts[b[some_]], exact[some_]]
            held = _best_rows(k, *(new if held is None else [np.concatenate([held.column(c).to_numpy(), x]) for c, x in enumerate(new)]))
            if held.num_rows == k:
                bound = max(bound, held.column(3)[k - 1].as_py())

        for hb, hs, hv, tb, ts, tv, r, rv in blocks(batches, "hb", ("h", "hv"), "tb", ("t", "tv"), ("r", "rv")):
            same = hb == tb
            if same:
                ts, tv = hs, hv
            (h2, h_long), (r2, r_long) = scaled(hv), scaled(rv)
            t2, t_long = (h2, h_long) if same else scaled(tv)
            most = h_long * r_long * t_long
            some_r = max(1, CELLS // max(1, len(hs), len(ts)))
            for first in range(0, len(r), some_r):
                share = bound / most - 1e-15 * (width + 8) if 0 < most < np.inf else 0.0
                h_in, h_ends = partners(h2, r2[first : first + some_r], share)
                t_in, t_ends = (h_in, h_ends) if same else partners(t2, r2[first : first + some_r], share)
                for i, (h_some, t_some) in enumerate(zip(np.split(h_in, h_ends), np.split(t_in, t_ends), strict=True), first):
                    if not len(h_some) or not len(t_some):
                        continue
                    weight = np.abs(rv[i])
                    hx = hv[h_some]
                    hn = lengths(hx, weight)
                    by = np.argsort(-hn)
                    h_some, hx, hn = h_some[by], hx[by], hn[by]
                    if same:
                        t_some, tx, tn = h_some, hx, hn
                    else:
                        tx = tv[t_some]
                        tn = lengths(tx, weight)
                        by = np.argsort(-tn)
                        t_some, tx, tn = t_some[by], tx[by], tn[by]
                    # rounding of a sum of width products, generously
                    margin = 1e-15 * (width + 8) * float(hn[0] * tn[0])
                    for at in range(0, len(hn), 64):
                        # the tails that reach the bound with the longest of these heads; of the same block, those before were heads
                        start = at if same else 0
                        m = int(np.searchsorted(-(tn * hn[at]), -(bound - margin), side="right"))
                        if m <= start:
                            break
                        products = (hx[at : at + 64] * rv[i]) @ tx[start:m].T
                        a, b = np.nonzero(products >= bound - margin)
                        if not len(a):
                            continue
                        if len(a) > k:
                            # k scores of these are all at least the k-th of their products
                            bound = max(bound, float(np.partition(products[a, b], len(a) - k)[len(a) - k]) - margin)
                            chosen = products[a, b] >= bound - margin
                            a, b = a[chosen], b[chosen]
                        a, b = a + at, b + start
                        keep(i, r[i], hs, ts, hv, rv, tv, h_some[a], t_some[b])
                        # the other way round, rounded as the form does it
                        if len(turned := np.flatnonzero(b >= at + 64) if same else np.arange(len(b))):
                            keep(i, r[i], ts, hs, tv, rv, hv, t_some[b[turned]], h_some[a[turned]])
        if held is not None:
            yield held

    heads = table.select(F.col("block").alias("hb"), F.col("id").alias("h"), F.col("v").alias("hv"))
    tails = table.select(F.col("block").alias("tb"), F.col("id").alias("t"), F.col("v").alias("tv"))
    none = lambda c, kind: F.when(F.col("hb") != F.col("tb"), F.col(c)).otherwise(F.array().cast(kind)).alias(c)
    pairs = heads.coalesce(parts).crossJoin(tails.coalesce(parts)).where("hb <= tb").select("hb", "h", "hv", "tb", none("t", "array<long>"), none("tv", "array<double>"))
    # neither side is sent whole to all: a task has some of the relations and of the pairs, as many tasks as keep all cores busy, since each reads its pairs anew
    return asked.coalesce(-(-2 * spread // (parts * (parts + 1)))).hint("shuffle_replicate_nl").crossJoin(pairs).mapInArrow(run, schema)


def predict_triples(model: Model, triples: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Scores of given triples and, if ``known`` is given, in_known."""
    found = score_triples(model, triples)
    if known is None:
        return found
    marks = known.select("h", "r", "t").distinct().withColumn("in_known", F.lit(True))
    return found.join(marks, ["h", "r", "t"], "left").withColumn("in_known", F.coalesce("in_known", F.lit(False)))


def count_scores(model: Model, asked: DataFrame, side: str) -> DataFrame:
    """How many queries and scores a prediction would have, without making it: queries, scores."""
    s = SIDES[side]
    queries = with_vectors(asked.select(*_FIXED[s]).distinct(), model, "".join(_FIXED[s]))
    n = (model.relations if s == "r" else model.entities).count()
    return queries.agg(F.count("*").alias("queries")).select("queries", (F.col("queries") * n).alias("scores"))


def predict_uncertain(model: Model, triples: DataFrame, rounds: int = 5, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """Mean and standard deviation (score, uncertainty) of the scores of ``triples`` under random dropout of a share ``rate`` of the numbers of the three vectors.

    A round's mask is drawn from its seed, for all triples alike, so reruns agree on any cluster.
    """
    score, kept = model.scorer(), triples.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in triples.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [matrix(batch.column(c)) for c in ("hv", "rv", "tv")]
            step = max(1, CELLS // max(1, sum(v.shape[1] for v in vectors)))
            means, spreads = [], []
            for a in range(0, batch.num_rows, step):
                found = []
                for k in range(rounds):
                    rng = np.random.default_rng([seed, k])
                    found.append(score(*(v[a : a + step] * ((rng.random(v.shape[1]) >= rate) / (1 - rate)) for v in vectors)))
                means.append(np.mean(found, axis=0))
                spreads.append(np.std(found, axis=0))
            columns = [np.concatenate(x) if x else np.zeros(0) for x in (means, spreads)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, columns)], names=[*kept, "score", "uncertainty"])

    return with_vectors(triples, model).select(*kept, "hv", "rv", "tv").mapInArrow(run, f"{types}, score double, uncertainty double")
