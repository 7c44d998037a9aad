"""Benchmark items inside documents, by CGK embedding, bit-sampling LSH and exact edit distance.

Texts are compared as sequences of lower-cased words (runs of letters, digits and underscores). An item of
n words leaks into a document if a passage of it is within floor(max_rate * n) word edits (Levenshtein) of
the whole item.

The search runs over windows of a document as long as the item. The CGK embedding walks over a window with
one pointer: in step j it emits the word under the pointer and moves on by the random bit that step j gives
to that word, which maps edit distance to Hamming distance. Each of ``repeats`` independent repetitions
samples ``sampled`` coordinates of the embedding; a window whose sample equals an item's becomes a candidate,
and the exact edit distance of the region decides. Windows that cannot be within the allowed edits of any
item are not embedded: k edits cut an item of n words into at most k + 1 untouched runs, so one of at least
ceil((n - k) / (k + 1)) words must stand in the window as it is, and windows are laid around such runs only.
That test loses nothing. A pair within the limit shares many windows (one for each shift up to k), and each
has ``repeats`` chances; the tests measure the recall against brute force.

Items of fewer than ``min_words`` words are searched for as they are (no edits), null ones and those without words not at all; null and empty documents
contain nothing. Repeated rows of either table give repeated rows of the result, null ids stay null. The
benchmark is taken in blocks of at most about ``block_bytes``, each of which is searched for in one pass.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text_key long, item_id long, edits int, item_words int, first_word int, last_word int"
_WORDS = re.compile(r"\w+").findall
#: What is neither ASCII nor a Latin letter of two UTF-8 bytes.
_OTHER = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]").search
#: ASCII characters that are no part of a word become spaces; all other bytes stay.
_CUT = bytes(c if c >= 0x80 or chr(c).isalnum() or c == 0x5F else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The words as UTF-8. Plain Latin texts are cut as bytes, which gives the same words faster."""
    lowered = (text or "").lower()
    if _OTHER(lowered):
        return [w.encode() for w in _WORDS(lowered)]
    return lowered.encode().translate(_CUT).split()


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (constants of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cgk_embedding(windows: np.ndarray, steps: int, repeats: int) -> np.ndarray:
    """The first ``steps`` coordinates of ``repeats`` independent CGK embeddings of each row of word numbers,
    as [repeat, row, step]. Beyond its window's end a pointer emits the padding 0."""
    n, length = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), windows.dtype)], axis=1)
    at, rows, out = np.zeros((repeats, n), np.int64), np.arange(n), np.empty((repeats, n, steps), np.int32)
    seeds = np.arange(repeats, dtype=np.uint64)[:, None] * np.uint64(1_000_003)
    for step in range(steps):
        word = padded[rows, at]
        out[:, :, step] = word
        with np.errstate(over="ignore"):
            bit = _mix(word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (seeds + np.uint64(step))) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), length)
    return out


@lru_cache(maxsize=20_000)
def best_passage(item: tuple[int, ...], region: tuple[int, ...]) -> tuple[int, int, int]:
    """Least edits between the item and any passage of the region, and that passage's first and end word (leftmost end)."""
    cost, start = list(range(len(item) + 1)), [0] * (len(item) + 1)
    best = (cost[-1], 0, 0)
    for j, word in enumerate(region, 1):
        last, last_start = cost[0], start[0]
        cost[0], start[0] = 0, j
        for i, mine in enumerate(item, 1):
            options = (last + (mine != word), last_start), (cost[i] + 1, start[i]), (cost[i - 1] + 1, start[i - 1])
            last, last_start = cost[i], start[i]
            cost[i], start[i] = min(options, key=lambda o: (o[0], -o[1]))
        if cost[-1] < best[0]:
            best = (cost[-1], start[-1], j)
    return best


class Index:
    """The LSH tables of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], max_rate: float, min_words: int, repeats: int, sampled: int):
        self.repeats, self.vocabulary, self.ids, self.items, self.most = repeats, {}, [], [], []
        for item_id, text in items:
            found = words(text)
            if found:
                self.ids.append(item_id)
                self.items.append(tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found))
                self.most.append(int(max_rate * len(found)) if len(found) >= min_words else 0)
        #: For each length of a run: the run's words to the items and offsets where they stand.
        self.runs: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = {}
        for i, (item, k) in enumerate(zip(self.items, self.most, strict=True)):
            q = ceil((len(item) - k) / (k + 1))
            for at in range(len(item) - q + 1):
                self.runs.setdefault(q, {}).setdefault(item[at : at + q], []).append((i, at))
        self.longest = max(map(len, self.items), default=1)
        rng = np.random.default_rng(20240607)
        #: By length: the coordinates that each repetition samples, and each repetition's samples to items.
        self.coordinates, self.tables = {}, {}
        for n in sorted({len(x) for x in self.items}):
            mine = [i for i, x in enumerate(self.items) if len(x) == n]
            self.coordinates[n] = rng.integers(0, 2 * n, (repeats, sampled))
            tables = self.tables[n] = [{} for _ in range(repeats)]
            block = np.zeros((len(mine), self.longest), np.int64)
            block[:, :n] = [self.items[i] for i in mine]
            for table, keys in zip(tables, self.samples(block, n), strict=True):
                for i, key in zip(mine, keys, strict=True):
                    table.setdefault(key, []).append(i)
        #: Words that start a run of each length, as flags by word number.
        self.firsts = {q: np.isin(np.arange(len(self.vocabulary) + 1), [run[0] for run in runs]) for q, runs in self.runs.items()}

    def windows(self, doc: np.ndarray) -> set[tuple[int, int]]:
        """(start, length) of every window that holds an untouched run of an item of that length."""
        out = set()
        known = np.concatenate([[0], np.cumsum(doc > 0)])
        for q, runs in self.runs.items():
            if len(doc) < q:
                continue
            starts = np.flatnonzero((known[q:] - known[:-q] == q) & self.firsts[q][doc[: len(doc) - q + 1]])
            for s in starts.tolist():
                for i, at in runs.get(tuple(doc[s : s + q].tolist()), ()):
                    out.update((s - at + d, len(self.items[i])) for d in range(-self.most[i], self.most[i] + 1))
        return out

    def samples(self, windows: np.ndarray, n: int, embedded: np.ndarray | None = None) -> list[list[bytes]]:
        """Each repetition's sample of each window of length ``n``."""
        embedded = cgk_embedding(windows, 2 * n, self.repeats) if embedded is None else embedded
        return [[row.tobytes() for row in np.ascontiguousarray(e[:, c])] for e, c in zip(embedded, self.coordinates[n], strict=True)]

    def search(self, texts: list[str | None], at_once: int = 2048) -> list[list[tuple[int, int, int, int]]]:
        """For each text, (item, edits, first word, end word) of the best passage for each item that leaks into it.

        ``at_once``: windows that are embedded together.
        """
        get, docs, windows = self.vocabulary.get, [], []
        for k, text in enumerate(texts):
            found = words(text)
            docs.append(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
            windows += [(n, k, start) for start, n in self.windows(docs[-1])]
        windows.sort()
        pairs: list[dict[int, set[int]]] = [{} for _ in texts]
        for low in range(0, len(windows), at_once):
            some = windows[low : low + at_once]
            grid = np.zeros((len(some), self.longest), np.int64)
            for row, (n, k, start) in enumerate(some):
                piece = docs[k][max(0, start) : max(0, start + n)]
                grid[row, max(0, -start) : max(0, -start) + len(piece)] = piece
            lengths = np.array([n for n, _, _ in some])
            embedded = cgk_embedding(grid, 2 * int(lengths[-1]), self.repeats)
            for n in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == n)
                for table, keys in zip(self.tables[n], self.samples(grid, n, embedded[:, rows]), strict=True):
                    for row, key in zip(rows.tolist(), keys, strict=True):
                        for i in table.get(key, ()):
                            pairs[some[row][1]].setdefault(i, set()).add(some[row][2])
        return [self.verified(doc, found) if found else [] for doc, found in zip(docs, pairs, strict=True)]

    def verified(self, doc: np.ndarray, found: dict[int, set[int]]) -> list[tuple[int, int, int, int]]:
        """The candidates of a document that are within their item's edits."""
        out, row = [], doc.tolist()
        for i, starts in sorted(found.items()):
            item, best, k, n = self.items[i], None, self.most[i], len(self.items[i])
            if same := [s for s in sorted(starts) if s >= 0 and tuple(row[s : s + n]) == item]:
                out.append((i, 0, same[0], same[0] + n))
                continue
            spans: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - k), min(len(row), s + n + k)
                if spans and a < spans[-1][1] and b - spans[-1][0] <= 4 * (n + 2 * k):
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            for a, b in spans:
                edits, first, end = best_passage(item, tuple(row[a:b]))
                if edits <= k and (best is None or edits < best[0]):
                    best = (edits, a + first, a + end)
            if best is not None:
                out.append((i, *best))
        return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[int | None, str]]]:
    """The items, in blocks dealt by a hash; the driver holds one block at a time while it builds its index."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, ceil(total / block_bytes))
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


#: The index that this worker built last, by the name of its block: the tasks after the first find it there.
_BUILT: dict[str, Index] = {}


def built(name: str, shared: Broadcast, setting: tuple) -> Index:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(shared.value, *setting)
    return _BUILT[name]


def leaks(docs: DataFrame, benchmark: DataFrame, max_rate: float = 0.2, min_words: int = 8, repeats: int = 16, sampled: int = 2, block_bytes: int = 8_000_000) -> DataFrame:
    """One row for each document and item that leaks into it: the best passage's edits and words (last_word included).

    ``text_key`` is the xxhash64 of the document's text, which tells apart rows of one doc_id.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    found = []
    for block in benchmark_blocks(benchmark, block_bytes):
        shared, name, setting = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex, (max_rate, min_words, repeats, sampled)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name, setting=setting) -> Iterator[pa.RecordBatch]:
            index = built(name, shared, setting)
            for batch in batches:
                rows = []
                for at in range(0, batch.num_rows, 1024):
                    ids, keys, texts = (batch.column(k).slice(at, 1024).to_pylist() for k in ("doc_id", "text_key", "text"))
                    for doc_id, key, found in zip(ids, keys, index.search(texts), strict=True):
                        rows += [(doc_id, key, index.ids[i], edits, len(index.items[i]), a, b - 1) for i, edits, a, b in found]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.int64()] * 3 + [pa.int32()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "text_key", "item_id", "edits", "item_words", "first_word", "last_word"])

        found.append(texts.mapInArrow(run, SCHEMA))
    return reduce(DataFrame.unionByName, found)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows into which an item leaks."""
    bad = leaks(docs, benchmark, **settings).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_key"))
    return marked.join(bad, marked.own_id.eqNullSafe(bad.bad_id) & (marked.own_key == bad.bad_key), "left_anti").select("row.*")
