"""Passages that repeat across documents, by compact windows of min-hashes.

A text is the sequence of the hashes of its five-word shingles (words by ASCII white space, A-Z lower-cased).
For each of ``hashes`` functions, the subsequences of ``length`` shingles (50 words at 46) that have their
minimum at the same place form a compact window (pivot, first and last start): the nodes of the sequence's
Cartesian tree that are the root of some subsequence of that length. They are read off a sliding minimum in
linear time; there are about 2 n / length of them. Two windows of different texts with the same minimum hold
subsequences that share a signature if their ranges of starts, relative to the pivot, overlap.

Windows are joined by their minimum and, so that a frequent line or phrase doesn't join what has nothing else
in common, by the 15 words that begin or the 15 that end with the pivot's shingle. Two texts that share 50 words
around a pivot share one of these. In each group every window is joined with the first text's; then all windows that
aren't in their group's largest class by then are compared with those of other classes, in blocks, by the shingles
around their pivots, so no class depends on which text comes first. Candidates are verified exactly: a passage counts if a window of ``length`` shingles of one text has a Jaccard
similarity of at least ``similarity`` with the aligned one of the other. Links between texts make classes.

Exact copies are one text here, whose documents form one class if it is long enough to hold a passage. Null,
empty and shorter texts repeat nothing; repeated rows are copies; null ids are counted in n_links but name
no class. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.staging import staged

WIDTH, LENGTH = 5, 46
#: Distance of the shingles that stand for the 15 words on one side of a pivot.
_SIDE = np.array([0, 5, 10])
#: Shingles that a window may hold besides a repeated word's and still be of that word alone.
SHORT = 8


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (constants of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the shingles of a text; none for a text of fewer words."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)), repeat(42)), np.uint64, n)


def sliding_minimum(values: np.ndarray, length: int) -> np.ndarray:
    """The minimum of every subsequence of ``length``, from running minima of blocks in both directions."""
    n = len(values)
    blocks = -(-n // length)
    padded = np.full(blocks * length, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, length)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - length + 1], ahead[length - 1 : n])


def compact_windows(values: np.ndarray, length: int = LENGTH, sizes: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivot, first start, last start) of every run of subsequences with their minimum at one place (the leftmost of equals).

    ``sizes``: ``values`` are several sequences of these sizes one after another, which no subsequence crosses.
    """
    n = len(values)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    owner = np.repeat(np.arange(len(sizes)), sizes) if sizes is not None else np.zeros(n, np.int64)
    least = sliding_minimum(values, length)
    whole = owner[: n - length + 1] == owner[length - 1 :]
    change = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1]) | (whole[1:] != whole[:-1])])
    first = np.flatnonzero(change)
    last = np.append(first[1:] - 1, len(least) - 1)
    first, last = first[whole[first]], last[whole[first]]
    pivot = np.empty(len(first), np.int64)
    for at in range(0, len(first), 50_000):
        a = first[at : at + 50_000]
        pivot[at : at + 50_000] = a + np.argmax(values[a[:, None] + np.arange(length)] == least[a][:, None], axis=1)
    again = np.flatnonzero(last > pivot)  # the minimum repeats: the run goes on with its next place
    more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k, at, b in zip(again.tolist(), pivot[again].tolist(), last[again].tolist(), strict=True):
        # all places of the minimum after the first; each stands for the starts from the place before on
        p = at + 1 + np.flatnonzero(values[at + 1 : b + length] == least[first[k]])
        a = np.concatenate([[at], p[:-1]]) + 1
        p, a = p[a <= b], a[a <= b]
        more.append((p, a, np.minimum(p, b)))
    last = np.minimum(last, pivot)
    if more:
        pivot, first, last = (np.concatenate([x, *y]) for x, y in zip((pivot, first, last), zip(*more, strict=True), strict=True))
    return pivot, first, last


def run_lengths(base: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """At each place how many equal shingles stand in a row there."""
    change = np.flatnonzero(np.append(True, (base[1:] != base[:-1]) | (owner[1:] != owner[:-1]))) if len(base) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(change, len(base)))
    return np.repeat(sizes, sizes)


def ends_of_repeats(base: np.ndarray, owner: np.ndarray, runs: np.ndarray, pivot: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows without those between the first and the last of a chain whose pivots are one shingle over and over, each within ``length`` of the next.

    A word repeated a hundred times is one shingle at a hundred places, each of them a pivot. What lies between the ends holds the same shingles
    as they do, so a text that shares it shares an end: the first's window holds the repeats from their beginning, the last's what follows them.
    A run of one word that is too short to fill a window (``SHORT`` shingles less) is one shingle of its window's set among many, and stands
    in texts without number: its windows go too, as each of the other shingles is as likely to be a pivot.
    """
    by = np.argsort(pivot, kind="stable")
    pivot, first, last = pivot[by], first[by], last[by]
    chained = (base[pivot[1:]] == base[pivot[:-1]]) & (owner[pivot[1:]] == owner[pivot[:-1]]) & (np.diff(pivot) <= length)
    out = np.append(False, chained) & np.append(chained, False)
    out |= (runs[pivot] >= 3) & (runs[pivot] < length - SHORT)
    return pivot[~out], first[~out], last[~out]


def window_keys(texts: list[bytes | None], hashes: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(row of the text, key, pivot, first, last) of the texts' windows; each has a key for either side that the text has 15 words on."""
    parts = [shingles(t) for t in texts]
    sizes = [len(x) for x in parts]
    base, begins = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
    owner, out = np.repeat(np.arange(len(sizes)), sizes), []
    repeats = run_lengths(base, owner)
    for j in range(hashes):
        seed = np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        pivot, first, last = compact_windows(_mix(base + seed), length, sizes)
        pivot, first, last = ends_of_repeats(base, owner, repeats, pivot, first, last, length)
        row = owner[pivot]
        for side, step in ((0, _SIDE), (1, -_SIDE)):
            far = pivot + step[-1]
            inside = (far >= begins[row]) & (far < begins[row + 1])
            p, r = pivot[inside], row[inside]
            key = np.full(len(p), 2 * j + side + 1, np.uint64)
            for k in step:
                key = _mix(key + base[p + k])
            out.append((r, key, p - begins[r], first[inside] - begins[r], last[inside] - begins[r]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def windows(docs: DataFrame, hashes: int, length: int = LENGTH) -> DataFrame:
    """(key, text_key, place): all windows; place holds the pivot and how far before it the first and last start lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, key, pivot, first, last = window_keys(part.column("text").cast(pa.binary()).to_pylist(), hashes, length)
                owner = part.column("text_key").to_numpy()[row]
                place = (pivot * length + (pivot - first)) * length + (pivot - last)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key.view(np.int64), owner, place.astype(np.int64))], names=["key", "text_key", "place"])

    return docs.select(F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, text_key long, place long")


def grouped(docs: DataFrame, hashes: int, length: int = LENGTH) -> DataFrame:
    """(key, text_key, place, leader): the windows that share their key with another text's, but the first one's; leader is that (text_key, place)."""
    # the frame only grows, so a group is streamed and never held, however large
    leader = F.first(F.struct("text_key", "place")).over(Window.partitionBy("key").orderBy("text_key", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return windows(docs, hashes, length).withColumn("leader", leader).where(F.col("text_key") != F.col("leader.text_key"))


def candidates(joined: DataFrame, length: int = LENGTH) -> DataFrame:
    """(text_key, other, anchors): the pairs of texts in (text_key, place, other, other_place) whose windows overlap, with the places of their pivots in both."""
    low, high = (lambda p: -(F.floor(p / length) % length)), (lambda p: -(p % length))
    mine, other = F.col("place"), F.col("other_place")
    joined = joined.where(F.greatest(low(mine), low(other)) <= F.least(high(mine), high(other)))
    pivot = lambda p: F.floor(p / (length * length)).cast("int")
    anchor = F.struct(pivot(mine).alias("pivot"), pivot(other).alias("other_pivot"))
    return joined.groupBy("text_key", "other").agg(F.collect_set(anchor).alias("anchors"))


def led(groups: DataFrame) -> DataFrame:
    """Every window with its leader."""
    return groups.select("text_key", "place", F.col("leader.text_key").alias("other"), F.col("leader.place").alias("other_place"))


#: How far apart two places of a shingle may be, relative to the pivots, in windows that are similar enough: words put in shift what follows.
_SHIFT = 5


def divided(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(text_key, class, wanted): of each text the windows (key, place, minor) in groups that hold several classes, as ``found`` links texts by then.

    ``minor``: the text isn't in its group's largest class. Of two classes of a group one is minor.
    """
    classes = connected_components(found, "text_key", "other").select(F.col("node").alias("text_key"), "component")
    leaders = groups.select("key", F.col("leader.text_key").alias("text_key"), F.col("leader.place").alias("place"))
    marked = groups.select("key", "text_key", "place").unionByName(leaders).distinct().join(classes, "text_key", "left")
    marked = staged(marked.select("key", "text_key", "place", F.coalesce("component", "text_key").alias("class")))
    sizes = marked.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("classes"), F.max(F.struct("n", "class"))["class"].alias("largest")).where("classes > 1")
    window = F.struct("key", "place", (F.col("class") != F.col("largest")).alias("minor"))
    return marked.join(sizes.select("key", "largest"), "key").groupBy("text_key", "class").agg(F.collect_list(window).alias("wanted"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """(text_key, doc_id): the smallest id of every text, null if it has no other."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"))).alias("least")
    return docs.groupBy(F.xxhash64("text").alias("text_key")).agg(least).select("text_key", F.col("least.doc_id").alias("doc_id"))


def texts_of(docs: DataFrame, wanted: DataFrame, chosen: DataFrame) -> DataFrame:
    """``wanted`` (text_key and more) with each text, by the row that ``chosen`` names: copies of a text are dealt by their ids and never meet in one task."""
    named = wanted.join(chosen, "text_key")
    rows = docs.select(F.xxhash64("text").alias("key"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = rows.join(named, (F.col("key") == F.col("text_key")) & F.col("id").eqNullSafe(F.col("doc_id")))
    # repeated rows of one id and text
    return found.dropDuplicates(["text_key", "doc_id"]).select(*wanted.columns, "text")


def surroundings(docs: DataFrame, wanted: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """(key, text_key, place, class, minor, around): for each wanted window the shingles within ``length`` of its pivot as numbers of 32 bits, 0 beyond the text."""
    texts = texts_of(docs, wanted, chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bases = [np.pad((shingles(t) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), length) for t in part.column("text").cast(pa.binary()).to_pylist()]
                windows_ = part.column("wanted")
                sizes = np.array([len(x) for x in windows_])
                key, place, minor = windows_.flatten().flatten()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                begins = np.concatenate([[0], np.cumsum([len(x) for x in bases])])
                pivots = place.to_numpy() // (length * length)
                every = np.concatenate(bases).view(np.int32)
                around = every[(begins[owner] + pivots)[:, None] + np.arange(2 * length + 1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1, dtype=np.int32) * (2 * length + 1)), pa.array(around.ravel()))
                of = lambda c: pa.array(part.column(c).to_numpy()[owner])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([key, of("text_key"), place, of("class"), minor, lists], names=["key", "text_key", "place", "class", "minor", "around"])

    return texts.select("text_key", "class", "wanted", "text").mapInArrow(run, "key long, text_key long, place long, class long, minor boolean, around array<int>")


def alike(x: np.ndarray, ys: np.ndarray, length: int, need: int) -> np.ndarray:
    """Which rows of ``ys`` can hold a window similar enough to the aligned one of ``x``: one with ``need`` shingles of x at no more than a shift from their places."""
    n = len(x)
    padded = np.zeros((len(ys), n + 2 * _SHIFT), ys.dtype)
    padded[:, _SHIFT : _SHIFT + n] = ys
    same = np.zeros(ys.shape, bool)
    for shift in range(2 * _SHIFT + 1):
        same |= padded[:, shift : shift + n] == x
    same &= x != 0
    sums = np.zeros((len(ys), n + 1), np.int16)
    np.cumsum(same, axis=1, out=sums[:, 1:])
    return (sums[:, length:] - sums[:, :-length]).max(axis=1) >= need


def across(docs: DataFrame, groups: DataFrame, found: DataFrame, chosen: DataFrame, length: int, similarity: float, rows: int = 1024) -> DataFrame:
    """(text_key, place, other, other_place): windows of one group but different classes whose surroundings can be similar enough.

    Every window that isn't in its group's largest class is compared with all of the group that are in other classes: a block of
    ``rows`` / 4 of these with a block of ``rows`` of all in one piece of work, so no pair is a row before it is found, and a hot group is many pieces.
    """
    held = staged(surroundings(docs, divided(groups, found), chosen, length))
    sizes = held.groupBy("key").agg(F.ceil(F.count("*") / rows).alias("parts"), F.ceil(F.sum(F.col("minor").cast("int")) * 4 / rows).alias("minor_parts"))
    dealt = held.join(sizes, "key")
    window = F.struct("text_key", "place", "class", "minor", "around")
    block = lambda rows_, parts, seed: rows_.groupBy("key", F.pmod(F.xxhash64(F.lit(seed), "text_key"), F.col(parts)).alias("block")).agg(F.collect_list(window).alias("x"))
    asked = block(dealt.where("minor"), "minor_parts", 1).select("key", F.col("x").alias("mine"))
    every = block(dealt, "parts", 2).select("key", F.col("x").alias("theirs"))
    need = int(np.ceil(2 * length * similarity / (1 + similarity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (text, place, own, _, around), (text2, place2, own2, minor2, around2) = ([c if k < 4 else c.flatten() for k, c in enumerate(batch.column(c)[row].values.flatten())] for c in ("mine", "theirs"))
                text, place, own, text2, place2, own2 = (c.to_numpy() for c in (text, place, own, text2, place2, own2))
                minor2 = minor2.to_numpy(zero_copy_only=False)
                xs, ys = (a.to_numpy().reshape(-1, 2 * length + 1) for a in (around, around2))
                out = []
                for i in range(len(text)):
                    # two minor windows meet twice; the greater text asks
                    some = np.flatnonzero((own2 != own[i]) & (~minor2 | (text2 < text[i])))
                    hit = some[alike(xs[i], ys[some], length, need)] if len(some) else some
                    out.append((np.full(len(hit), i), hit))
                i, j = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (text[i], place[i], text2[j], place2[j])], names=["text_key", "place", "other", "other_place"])

    return asked.join(every, "key").select("mine", "theirs").mapInArrow(run, "text_key long, place long, other long, other_place long")


def contexts(docs: DataFrame, wanted: DataFrame, chosen: DataFrame, length: int = LENGTH) -> DataFrame:
    """(owner, starts, values): the shingles within ``length`` of any of a text's wanted pivots, as runs: each run's start, length and hashes."""
    texts = texts_of(docs, wanted.withColumnRenamed("owner", "text_key"), chosen).withColumnRenamed("text_key", "owner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, starts, values = batch.slice(at, 256), [], []
                for text, pivots in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("pivots").to_pylist(), strict=True):
                    base, runs = shingles(text), []
                    for p in sorted(pivots):
                        a, b = max(0, p - length), min(len(base), p + length + 1)
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = b
                        else:
                            runs.append([a, b])
                    starts.append([x for a, b in runs for x in (a, b - a)])
                    values.append(np.concatenate([base[a:b] for a, b in runs]).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("owner"), pa.array(starts, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))], names=["owner", "starts", "values"])

    return texts.select("owner", "text", "pivots").mapInArrow(run, "owner long, starts array<int>, values array<bigint>")


class _Context:
    """Shingles of parts of a text, by their places in the whole."""

    def __init__(self, starts: list[int], values: np.ndarray):
        self.runs, at = [], 0
        for a, n in zip(starts[::2], starts[1::2], strict=True):
            self.runs.append((a, values[at : at + n]))
            at += n

    def around(self, pivot: int) -> tuple[int, np.ndarray]:
        return next((a, v) for a, v in self.runs if a <= pivot < a + len(v))


def verified(x: np.ndarray, y: np.ndarray, length: int, similarity: float) -> tuple[int, int, float] | None:
    """(first, end, similarity): the longest run of aligned windows of ``length`` of two parts that are similar enough, as places in x.

    Windows that are equal in enough places come first; where there are none, those that share enough shingles at
    whatever places (words put in or left out shift the rest). Sets decide in either case.
    """
    n = min(len(x), len(y))
    if n < length:
        return None
    x, y = x[:n], y[:n]
    need = int(np.ceil(2 * length * similarity / (1 + similarity)))

    def sliding(flags):
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[length:] - sums[:-length]

    def value(s):
        p, q = set(x[s : s + length].tolist()), set(y[s : s + length].tolist())
        return len(p & q) / len(p | q)

    same = sliding(x == y)
    good = np.flatnonzero(same >= need)
    if len(good):
        cuts = np.flatnonzero(np.diff(good) > 1)
        runs = sorted(zip(good[np.append(0, cuts + 1)].tolist(), good[np.append(cuts, len(good) - 1)].tolist(), strict=True), key=lambda r: r[0] - r[1])
        for a, b in runs:
            found = value(a + int(np.argmax(same[a : b + 1])))
            if found >= similarity:
                return a, b + length, found
    # a shingle of x at i that stands in y at j is shared by the windows that hold both places
    order = np.argsort(y, kind="stable")
    at = np.minimum(np.searchsorted(y[order], x), n - 1)
    i, j = np.arange(n), order[at]
    low, high = np.maximum(i, j) - length + 1, np.minimum(i, j)
    held = (y[j] == x) & (low <= high)
    steps = np.bincount(np.maximum(low[held], 0), minlength=n + 1) - np.bincount(high[held] + 1, minlength=n + 1)
    there = np.cumsum(steps)[: n - length + 1]
    for s in sorted(np.flatnonzero(there >= need).tolist(), key=lambda s: -there[s]):
        if (found := value(s)) >= similarity:
            return s, s + length, found
    return None


def links(docs: DataFrame, hashes: int = 5, length: int = LENGTH, similarity: float = 0.8) -> DataFrame:
    """(text_key, other, first_word, last_word, similarity): verified links between different texts, with the longest passage in the first."""
    groups = staged(grouped(docs, hashes, length))
    tried = staged(candidates(led(groups), length))
    chosen = staged(one_of_each(docs))
    found = staged(verified_links(docs, tried, chosen, length, similarity))
    known = found.select("text_key", "other").unionByName(found.select(F.col("other").alias("text_key"), F.col("text_key").alias("other")))
    rest = candidates(across(docs, groups, found, chosen, length, similarity), length).join(known, ["text_key", "other"], "left_anti")
    return found.unionByName(verified_links(docs, staged(rest), chosen, length, similarity))


def verified_links(docs: DataFrame, pairs: DataFrame, chosen: DataFrame, length: int, similarity: float) -> DataFrame:
    """The links of ``links`` among candidates ``pairs``."""
    ends = F.explode(F.array(F.struct(F.col("text_key").alias("owner"), F.transform("anchors", lambda a: a["pivot"]).alias("p")), F.struct(F.col("other").alias("owner"), F.transform("anchors", lambda a: a["other_pivot"]).alias("p"))))
    # each text's pivots once: at most as many as it has windows, however many texts it is paired with
    wanted = pairs.select(ends.alias("x")).select("x.owner", F.explode("x.p").alias("p")).distinct().groupBy("owner").agg(F.collect_list("p").alias("pivots"))
    held = staged(contexts(docs, wanted, chosen, length))
    side = lambda name, prefix: held.select(F.col("owner").alias(name), F.col("starts").alias(f"{prefix}_starts"), F.col("values").alias(f"{prefix}_values"))
    both = pairs.join(side("text_key", "my"), "text_key").join(side("other", "other"), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row]  # noqa: E731, B023
                mine, other = (_Context(get(f"{p}_starts").as_py(), get(f"{p}_values").values.to_numpy()) for p in ("my", "other"))
                best, seen = None, set()
                anchors = [(a["pivot"], a["other_pivot"]) for a in get("anchors").as_py()]
                common = Counter(q - p for p, q in anchors)
                for p, q in sorted(anchors, key=lambda a: (-common[a[1] - a[0]], a)):
                    (a, x), (b, y) = mine.around(p), other.around(q)
                    if (q - p, a, b) in seen:
                        continue
                    seen.add((q - p, a, b))
                    left, right = min(p - a, q - b), min(a + len(x) - p, b + len(y) - q)
                    if best and best[1] - best[0] >= left + right:
                        continue
                    found = verified(x[p - a - left :], y[q - b - left :], length, similarity)
                    if found and (best is None or found[1] - found[0] > best[1] - best[0]):
                        best = (p - left + found[0], p - left + found[1], found[2])
                if best:
                    out.append((get("text_key").as_py(), get("other").as_py(), best[0], best[1] - 1 + WIDTH - 1, best[2]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["text_key", "other", "first_word", "last_word", "similarity"])

    columns = ["text_key", "other", "anchors", "my_starts", "my_values", "other_starts", "other_values"]
    return both.select(*columns).mapInArrow(run, "text_key long, other long, first_word int, last_word int, similarity double")


def _least_words(n: int) -> str:
    """An expression that a text of ``n`` words or more matches, read no further than that."""
    return rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{n - 1}}}[^\x20\x09-\x0D]"


def repeated(docs: DataFrame, hashes: int = 5, length: int = LENGTH, similarity: float = 0.8) -> DataFrame:
    """One row for each document that shares a passage with another: doc_id, class_id (the smallest id of its class), n_links, first_word and last_word
    (the longest passage that a link of its text names; null if its text only leads others or has copies alone)."""
    found = staged(links(docs, hashes, length, similarity))
    parts = connected_components(found, "text_key", "other").withColumnRenamed("node", "text_key")
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").rlike(_least_words(length + WIDTH - 1)).alias("long")).where("long").drop("long"))
    ends = F.explode(F.array(F.struct(F.col("text_key").alias("k"), F.struct(F.col("last_word") - F.col("first_word"), "first_word", "last_word").alias("span")), F.struct(F.col("other").alias("k"), F.lit(None).cast("struct<col1:int,first_word:int,last_word:int>").alias("span"))))
    own = found.select(ends.alias("x")).groupBy(F.col("x.k").alias("text_key")).agg(F.count("*").alias("links"), F.max("x.span").alias("span"))
    copies = rows.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    texts = copies.join(own, "text_key", "left").join(parts, "text_key", "left").where("links is not null or copies > 1")
    texts = texts.select("text_key", "least", F.coalesce("component", "text_key").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "span")
    named = texts.groupBy("class").agg(F.min("least").alias("class_id"))
    texts = texts.join(named, "class").select("text_key", "class_id", "n_links", F.col("span.first_word").alias("first_word"), F.col("span.last_word").alias("last_word"))
    return rows.join(texts, "text_key").select("doc_id", "class_id", "n_links", "first_word", "last_word")
