"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are lower-cased words. Their evidence is counted in labelled documents: in how many toxic and how
many clean ones a word stands, and likewise each of its beginnings of three, four and five letters. The
rate of toxic documents of such a node has a Dirichlet prior of weight ``alpha`` whose mean is the rate of
the next shorter beginning, up to the rate of the whole sample; a word that was seen in fewer than
``min_docs`` documents takes its longest known beginning's rate. A token's score is the node's log-odds
less the sample's, less ``drift``, which makes text without evidence score below zero.

One linear scan (Ruzzo and Tompa, 1999) yields all maximal-scoring segments of a text. The best segment of
clean texts follows an extreme-value law, P(M >= x) = 1 - exp(-K n exp(-lambda x)) over n words (Karlin and
Altschul, 1990); lambda and K are fitted to labelled clean documents that the counts have not seen, and a
passage is significant if its p-value is at most ``significance``. A logistic fit on the same documents
turns the p-value of the best passage and the number of significant passages into the document's score.

A model learns from a bounded number of labelled rows (``max_labelled``); every document is scored whole.
Null and empty texts have no passages and score as such. Labels of one id are averaged, null labels and
null ids ignored, and so are labels without a document; of repeated rows one is learned from. Documents are scored
one by one, however often repeated; a word of any length and number counts, in memory that grows with one text. Without labelled
rows of both classes there is no evidence and every score is the sample's rate (0 without any rows).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .common import fold, in_parts, trimmed
from .decontaminate import words

#: Lengths of the beginnings of a word that have evidence of their own, in UTF-8 characters.
BEGINNINGS = (3, 4, 5)
_EULER = 0.5772156649015329


def nodes(word: str) -> list[str]:
    """The beginnings of a word from short to long, marked with a star, then the word."""
    return [word[:n] + "*" for n in BEGINNINGS if len(word) > n] + [word]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) of a sequence, by the algorithm of Ruzzo and Tompa."""
    total, stack = 0.0, []  # of [first, end, sum before, sum after, index below with a smaller sum before]
    for at, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, left = at, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append([first, at + 1, left, total, j])
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, after - before) for a, b, before, after, _ in stack]


class _Scores(dict):
    """Word to score; a word that is asked for the first time takes its longest known node's."""

    def __init__(self, by_node: dict[str, float], base: float, keep: int = 300_000):
        super().__init__()
        self.by_node, self.base, self.keep = by_node, base, keep

    def __missing__(self, word: bytes) -> float:
        if len(self) > self.keep:
            self.clear()
        for node in reversed(nodes(word.decode())):
            if (found := self.by_node.get(node)) is not None:
                break
        else:
            found = self.base
        self[word] = found
        return found


@dataclass
class Model:
    """Node scores (drift taken off), the extreme-value law and the logistic weights."""

    by_node: dict[str, float]
    base: float
    rate: float
    lam: float = 1.0
    k: float = 1.0
    significance: float = 0.01
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])

    def scorer(self) -> _Scores:
        return _Scores(self.by_node, self.base)

    def token_scores(self, text: str | None, known: _Scores) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(known.__getitem__, found), np.float64, len(found))

    def log_p(self, x: float, n: int) -> float:
        """Log of the p-value of a segment that scores ``x`` in ``n`` words."""
        expected = self.k * n * np.exp(-min(self.lam * x, 700.0))
        return float(np.log(-np.expm1(-max(expected, 1e-300))))

    def passages(self, text: str | None, known: _Scores) -> list[tuple[int, int, float, float]]:
        """(first word, end word, score, log p-value) of every significant passage."""
        s = self.token_scores(text, known)
        if not len(s) or self.log_p(best_segment(s), len(s)) > np.log(self.significance):
            return []
        found = ((a, b, x, self.log_p(x, len(s))) for a, b, x in maximal_segments(s.tolist()))
        return [f for f in found if f[3] <= np.log(self.significance)]

    def features(self, text: str | None, known: _Scores) -> tuple[float, float]:
        s = self.token_scores(text, known)
        if not len(s):
            return 0.0, 0.0
        best = -self.log_p(best_segment(s), len(s))
        if best < -np.log(self.significance):
            return best, 0.0
        n = sum(self.log_p(x, len(s)) <= np.log(self.significance) for _, _, x in maximal_segments(s.tolist()))
        return min(best, 60.0), float(np.log1p(n))

    def probability(self, x: tuple[float, float]) -> float:
        a, b, c = self.weights
        return float(1 / (1 + np.exp(-np.clip(a + b * x[0] + c * x[1], -500, 500))))


def best_segment(s: np.ndarray) -> float:
    """Score of the best segment, 0 for the empty one."""
    sums = np.concatenate([[0.0], np.cumsum(s)])
    return float(np.max(sums - np.minimum.accumulate(sums)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Weights of a logistic regression, by Newton's method."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _counts(texts: DataFrame) -> DataFrame:
    """(node, clean, toxic): in how many documents of ``texts`` (text, toxic) each node stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update({n for w in set(words(text)) for n in nodes(w.decode())})
            every = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[n] for n in every], pa.int64()) for c in seen)], names=["node", "clean", "toxic"])

    return texts.mapInArrow(trimmed(run), "node string, clean long, toxic long").groupBy("node").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, max_labelled: int = 100_000, alpha: float = 10.0, min_docs: int = 5, drift: float = 0.5, significance: float = 0.01) -> Model:
    """A model from ``labels`` (doc_id, toxic) of ``docs``, without the ids for which ``held_out`` holds.

    Of the ids, a quarter chosen by hash calibrates, and the rest gives the counts. ``max_labelled`` bounds
    the expected number of labelled rows, which are broadcast; a larger table is sampled by hash.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where("doc_id is not null and toxic is not null")
    if held_out is not None:
        rows = rows.where(~held_out)
    rows = rows.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    share = min(1.0, max_labelled / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = rows.withColumn("calibrates", F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(4)) == 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # one row of an id and text, so that the number of labels bounds what follows; read once
    labelled = texts.join(F.broadcast(rows), "doc_id").withColumn("key", F.xxhash64("text")).dropDuplicates(["doc_id", "key"]).select("text", "toxic", "calibrates")
    labelled = staged(labelled)
    size = {(r.toxic, r.calibrates): r.n for r in labelled.groupBy("toxic", "calibrates").agg(F.count("*").alias("n")).collect()}
    y0, y1 = size.get((0, False), 0), size.get((1, False), 0)
    if not y0 or not y1:
        every = sum(size.values())
        rate = (y1 + size.get((1, True), 0)) / max(1, every)
        return Model({}, -drift, rate, weights=[float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))), 0.0, 0.0])
    rate = y1 / (y0 + y1)
    counted = {r.node: (r.toxic, r.clean + r.toxic) for r in _counts(labelled.where("not calibrates")).where(F.col("clean") + F.col("toxic") >= min_docs).toLocalIterator()}
    rates: dict[str, float] = {}

    def rate_of(node: str) -> float:
        if node not in rates:
            word = node.removesuffix("*") if len(node) > 1 else node
            above = [n for n in nodes(word)[:-1] if n != node and n in counted]
            parent = rate_of(above[-1]) if above else rate
            toxic, seen = counted[node]
            rates[node] = (toxic + alpha * parent) / (seen + alpha)
        return rates[node]

    log_odds = lambda p: float(np.log(p / (1 - p)))
    by_node = {n: log_odds(rate_of(n)) - log_odds(rate) - drift for n in counted}
    model = Model(by_node, -drift, rate, significance=significance)

    grid = np.linspace(0.05, 3, 60)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.scorer()
        for batch in batches:
            best, size, moments = [], [], []
            for text in batch.column("text").to_pylist():
                s = model.token_scores(text, known)
                best.append(best_segment(s) if len(s) else 0.0)
                size.append(len(s))
                moments.append(sum((np.exp(np.outer(s[a : a + 10_000], grid)).sum(axis=0) for a in range(0, len(s), 10_000)), np.zeros(len(grid))).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(best), pa.array(size, pa.int64()), pa.array(moments, pa.list_(pa.float64()))], names=["toxic", "best", "size", "moments"])

    clean = labelled.where("calibrates and toxic = 0").mapInArrow(trimmed(measured), "toxic int, best double, size long, moments array<double>").where("size > 0")
    sums = clean.agg(F.sum("size").alias("n"), *(F.sum(F.col("moments")[i]).alias(f"m{i}") for i in range(60))).first()
    if sums.n:
        # lambda solves E exp(lambda s) = 1; the moments are convex in it, so the last one below 1 brackets it
        means = np.array([sums[f"m{i}"] for i in range(60)]) / sums.n
        below = np.flatnonzero(means < 1)
        at = int(below[-1]) if len(below) else 0
        model.lam = float(grid[at] if at + 1 == len(grid) else np.interp(0.0, [means[at] - 1, means[at + 1] - 1], [grid[at], grid[at + 1]])) if len(below) else 0.05
        mean = clean.where("best > 0").agg(F.avg(F.lit(model.lam) * F.col("best") - F.log("size")).alias("x")).first().x
        model.k = float(np.exp(min((mean or 0.0) - _EULER, 50.0)))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.scorer()
        for batch in batches:
            x = [model.features(t, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column("toxic")], names=["best", "passages", "toxic"])

    seen = np.array([tuple(r) for r in labelled.where("calibrates").select("text", "toxic").mapInArrow(trimmed(featured), "best double, passages double, toxic int").collect()] or [(0.0, 0.0, 0)])
    model.weights = logistic(np.column_stack([np.ones(len(seen)), seen[:, :2]]), seen[:, 2])
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and n_passages of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.scorer()
        for batch in chain.from_iterable(map(in_parts, batches)):
            x = [model.features(t, known) for t in batch.column("text").to_pylist()]
            p = [model.probability(f) for f in x]
            columns = [batch.column("doc_id"), pa.array(p, pa.float64()), pa.array([int(v >= 0.5) for v in p], pa.int32()), pa.array([round(np.expm1(b)) for _, b in x], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "n_passages"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(trimmed(run), "doc_id long, score double, predicted int, n_passages long")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: doc_id, first_word, last_word (included), score, log_p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.scorer()
        for batch in batches:
            rows = [(i, a, b - 1, x, p) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for a, b, x, p in model.passages(t, known)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "first_word", "last_word", "score", "log_p"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(trimmed(run), "doc_id long, first_word long, last_word long, score double, log_p double")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the model predicts to be toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.scorer()
        for batch in chain.from_iterable(map(in_parts, batches)):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.probability(model.features(t, known)) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def held_out_fold(doc_id: Column) -> Column:
    return fold(doc_id) == 0
