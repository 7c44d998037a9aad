"""Language-model scores by a weighted backoff automaton.

Tokens are a text's words (A-Z lower-cased), then one end token. The lowest order spreads add-half counts of
all training tokens over the vocabulary and one unknown word. Above it stand n-grams (``order`` words at most)
of all words whose count is at least ``least_count``, at any size of the corpus; they are smoothed by absolute
discounting, interpolated: what an n-gram's context takes from its continuations goes to the next lower order,
so every context's probabilities sum to one. N-grams are states: an arc reads a continuation and adds its
log-probability, a failure arc drops the oldest word and adds the log of what the context left (``Automaton``).

The automaton grows with the corpus and is a distributed table. An n-gram that is kept has its context and its
suffix kept too, so the sum along a text's path is a sum over its n-grams: a word adds its lowest-order term and
the failure out of it, an n-gram what reading it gains over failing, and the failure out of it as a context.
Texts are joined with these terms by n-gram. The terms of the most frequent words and n-grams (at most
1 / ``word_share`` and 1 / ``least_share`` an order) are sent to all workers and added at once. What is left is
filtered by bit sets of fixed size that pass every kept n-gram (and some others, which then meet nothing), and
meets its terms in buckets of keys, each of a bounded number of tokens.
Words are known by 64-bit hashes, n-grams by hashes of their contexts' and suffixes', rows by those of id and text.

Null and empty texts are the end token alone. Repeated rows have one score each, which is the same; rows of null ids belong
to the fold of the empty id. Without training tokens every token has the probability of the unknown word.
An empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import dropped, staged
from .common import in_parts, release, trimmed

#: The end token; no word holds white space.
END = b"\n"
DISCOUNT = 0.75


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


#: Rows of numbers that a worker sends at once.
SENT_ROWS = 65_536
#: Bits of the sets that n-grams are filtered by.
FILTER_BITS = 1 << 27
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long, for any seed; that of several longs takes each one's hash as the next one's seed."""
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = seed + (_P5 + np.uint64(8))
        h = turn(h ^ (turn(x * _P2, 31) * _P1), 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts and each one's text."""
    from xxhash import xxh64_intdigest

    found = [tokens(t) for t in texts]
    sizes = [len(x) for x in found]
    return np.fromiter(map(xxh64_intdigest, chain.from_iterable(found), repeat(42)), np.uint64, sum(sizes)), np.repeat(np.arange(len(sizes)), sizes)


def pair_keys(contexts: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Keys of n-grams by those of their contexts and suffixes, as xxhash64 of both in Spark."""
    return hash_long(suffixes, hash_long(contexts, np.uint64(42)))


def gram_keys(words: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams of each order that start at each place (whatever text they end in): a word's own hash, ``pair_keys`` of longer ones."""
    out = [words]
    for _ in range(2, order + 1):
        out.append(pair_keys(out[-1][:-1], out[-1][1:]))
    return out


def key_filter(kept: DataFrame) -> np.ndarray:
    """A bit set of fixed size that holds the last bits of every key of ``kept``."""
    at = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    found = kept.select(F.shiftright(at, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(FILTER_BITS - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


@dataclass
class Automaton:
    """States and arcs. State 0 is the empty context, state i the i-th word, and those beyond longer contexts.

    ``words``: the words that take part; ``arcs``: state * (words + 1) + word to (log10 probability, next state);
    ``fails``: each state's failure state and log10 weight.
    """

    words: list[bytes]
    counts: list[int]
    total: int
    vocabulary: int
    grams: list[np.ndarray]

    def build(self) -> None:
        width = len(self.words) + 1
        self.width = width
        self.ids = {w: i + 1 for i, w in enumerate(self.words)}
        floor = self.total + 0.5 * (self.vocabulary + 1)
        base = (np.array([0, *self.counts], np.float64) + 0.5) / floor
        self.base = np.log10(base)
        end = self.ids.get(END, -1)
        #: (state, word) of every n-gram that is a context itself, to its state
        state_of: dict[int, int] = {i: i for i in range(1, width) if i != end}
        self.arcs: dict[int, tuple[float, int]] = {i: (float(self.base[i]), state_of.get(i, 0)) for i in range(1, width)}
        self.fail_state, self.fail_weight = array("q", [0] * width), array("d", [0.0] * width)
        prob: dict[int, float] = {i: float(base[i]) for i in range(1, width)}
        context_count = dict(enumerate([0, *self.counts]))
        path = {i: (i,) for i in range(1, width)}
        for gram in self.grams:
            # rows: words of the n-gram, then its count; contexts are states of the order before
            by_context: dict[int, list[tuple[int, int]]] = {}
            for *context, word, n in gram.tolist():
                s = self.state(context)
                if s is not None:
                    by_context.setdefault(s, []).append((word, n))
            new = []
            for s, seen in by_context.items():
                count, fail = context_count[s], self.fail_state[s]
                left = 1.0 - sum(n - DISCOUNT for _, n in seen) / count
                self.fail_weight[s] = float(np.log10(max(left, 1e-12)))
                for word, n in seen:
                    lower = self.probability(fail, word, prob)
                    p = (n - DISCOUNT) / count + left * lower
                    prob[s * width + word] = p
                    new.append((s, word, n, p))
            for s, word, n, p in new:
                to = self.arcs[self.deepest(self.fail_state[s], word)][1]
                if word != end and len(path[s]) + 1 <= len(self.grams):
                    state = len(self.fail_state)
                    self.fail_state.append(to)
                    self.fail_weight.append(0.0)
                    context_count[state], path[state] = n, (*path[s], word)
                    to = state
                self.arcs[s * width + word] = (float(np.log10(p)), to)

    def state(self, context: list[int]) -> int | None:
        """The state of exactly this context."""
        s = context[0]
        for depth, word in enumerate(context[1:], 1):
            hit = self.arcs.get(s * self.width + word)
            if hit is None or hit[1] < self.width and depth:
                return None
            s = hit[1]
        return s

    def deepest(self, s: int, word: int) -> int:
        """The key of the arc that reads ``word`` after failures from state ``s``."""
        while s and s * self.width + word not in self.arcs:
            s = self.fail_state[s]
        return s * self.width + word

    def probability(self, s: int, word: int, prob: dict[int, float]) -> float:
        """Interpolated probability of ``word`` in state ``s``."""
        weight = 0.0
        while s and s * self.width + word not in self.arcs:
            weight += self.fail_weight[s]
            s = self.fail_state[s]
        return prob[s * self.width + word] * 10**weight

    def traverse(self, ids: list[int]) -> float:
        """Sum of log10 weights and probabilities over a text; a word that takes no part (0) adds its failures only."""
        total, s, arcs, fail_state, fail_weight, width = 0.0, 0, self.arcs, self.fail_state, self.fail_weight, self.width
        for w in ids:
            if w:
                hit = arcs.get(s * width + w)
                while hit is None:
                    total += fail_weight[s]
                    s = fail_state[s]
                    hit = arcs.get(s * width + w)
                total += hit[0]
                s = hit[1]
            else:
                while s:
                    total += fail_weight[s]
                    s = fail_state[s]
        return total


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def gram_counts(texts: DataFrame, n: int, allowed: np.ndarray | None = None, flush: int = 2_000_000) -> DataFrame:
    """Counts of the n-grams of ``texts``: (key, n) of words, (context, suffix, n) of longer ones.

    ``allowed``: bits of (n - 1)-grams; both ends of an n-gram must be among them. ``flush``: n-grams that a task holds before it sends them.
    """
    shared, names = texts.sparkSession.sparkContext.broadcast(allowed), ["key"] if n == 1 else ["context", "suffix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, held, size = shared.value, [], 0

        def out():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            key = columns[0] if n == 1 else pair_keys(*columns)
            by = np.argsort(key)
            first = runs(key[by])
            del key
            counts = np.diff(np.append(first, len(by)))
            by = by[first]
            # in parts, or the JVM holds all of them outside its heap
            yield from in_parts(pa.RecordBatch.from_arrays([*(pa.array(c[by].view(np.int64)) for c in columns), pa.array(counts.astype(np.int64))], names=[*names, "n"]), SENT_ROWS)

        for part in slices(batches):
            words, owner = hashed(part.column("text").cast(pa.binary()).to_pylist())
            if n == 1:
                held.append((words,))
            else:
                keys = gram_keys(words, n - 1)[-1]
                count = max(0, len(words) - n + 1)
                ends = among(allowed, keys)
                start = np.flatnonzero((owner[:count] == owner[len(owner) - count :]) & ends[:count] & ends[len(ends) - count :])
                held.append((keys[start], keys[start + 1]))
            size += len(held[-1][0])
            if size >= flush:
                yield from out()
                size = 0
        if size:
            yield from out()

    rows = texts.mapInArrow(trimmed(run), ", ".join(f"{w} long" for w in names) + ", n long")
    # tasks have counted what they hold, so the rows are dealt out as they are
    return rows.repartition(*names).groupBy(*names).agg(F.sum("n").alias("n"))


def model(training: DataFrame, order: int, least_count: int) -> tuple[DataFrame, list[np.ndarray], int, int]:
    """(level, key, n, base, score) of every word and kept n-gram, the filters of the n-grams of 2 words and more, and the numbers of tokens and words."""
    counts = staged(gram_counts(training, 1))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    floor = max(sums.n + 0.5 * (sums.v + 1), 1.0)
    levels = [counts.withColumn("p", (F.col("n") + 0.5) / F.lit(floor)).withColumn("gain", F.log10("p"))]
    weights, filters, bits, used = [], [], key_filter(counts.where(F.col("n") >= least_count)), [counts]
    for n in range(2, order + 1):
        kept = gram_counts(training, n, bits).where(F.col("n") >= least_count)
        kept = staged(kept.select(F.xxhash64("context", "suffix").alias("key"), "context", "suffix", "n"))
        bits = key_filter(kept)
        filters.append(bits)
        # what an n-gram needs of its context and suffix is as frequent as itself at least
        lower = levels[-1].where(F.col("n") >= least_count)
        taken = kept.groupBy("context").agg(F.sum(F.col("n") - DISCOUNT).alias("taken"))
        left = taken.join(lower.select(F.col("key").alias("context"), F.col("n").alias("count")), "context")
        left = staged(left.select("context", "count", F.greatest(1 - F.col("taken") / F.col("count"), F.lit(1e-12)).alias("left")))
        found = kept.join(left, "context").join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("lower")), "suffix")
        found = found.withColumn("p", (F.col("n") - DISCOUNT) / F.col("count") + F.col("left") * F.col("lower"))
        levels.append(staged(found.select("key", "n", "p", (F.log10("p") - F.log10("left") - F.log10("lower")).alias("gain"))))
        weights.append(left.select(F.col("context").alias("key"), F.log10("left").alias("weight")))
        dropped(kept)
        used += [left, levels[-1]]
    terms = []
    for n, level in enumerate(levels, 1):
        score = F.col("gain")
        if n < order:
            level, score = level.join(weights[n - 1], "key", "left"), score + F.coalesce("weight", F.lit(0.0))
        terms.append(level.select(F.lit(n).alias("level"), "key", "n", F.when(F.lit(n == 1), F.col("gain")).otherwise(0.0).alias("base"), score.alias("score")))
    terms = staged(reduce(DataFrame.unionByName, terms))
    for table in used:
        dropped(table)
    return terms, filters, sums.n, sums.v


def most_frequent(terms: DataFrame, most: list[int]) -> Column:
    """Whether a term's count reaches the least power of two that at most ``most`` terms of its level reach."""
    power = F.floor(F.log2("n")).cast("int")
    found = terms.groupBy("level", power.alias("power")).count().collect()
    least = []
    for level, bound in enumerate(most, 1):
        sizes = {r.power: r["count"] for r in found if r.level == level}
        least.append(next(k for k in range(65) if sum(c for p, c in sizes.items() if p >= k) <= bound))
    return F.element_at(F.array(*(F.lit(2.0**k) for k in least)), F.col("level")) <= F.col("n")


class Shared:
    """Terms of an order by their keys, found by the first bits of these. Made once on the driver."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.values = keys[by], [v[by] for v in values]
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        bucket = (keys >> self.shift).astype(np.int64)
        at, end, out = self.starts[bucket], self.starts[bucket + 1], np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == keys[left]
            out[left[hit]] = here[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key: buckets are ranges of keys, of one width."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Numbers of eight bytes, byte by byte of all, so that bytes that are alike compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def flat(held: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(8, -1).T).view(kind).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as the planes of their differences, whose high bytes are zero."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(held: bytes) -> np.ndarray:
    return np.cumsum(flat(held, np.uint64), dtype=np.uint64)


def indexed(places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the numbers below ``n`` are among ``places``, ascending, and each place's position among these, in few bytes."""
    among_ = np.zeros(n, bool)
    among_[places] = True
    mine = np.flatnonzero(among_)
    return mine, (np.cumsum(among_) - 1)[places].astype(np.min_scalar_type(max(0, len(mine) - 1)))


def matched(piece: dict, known: np.ndarray, values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The sums by document of a piece's places whose keys are among ``known``, which ascend; documents without any are left out."""
    key, rows = unpacked(piece["keys"]), unpacked(piece["rows"])
    at = np.frombuffer(piece["at"], f"u{len(piece['at']) // len(key)}")
    place = np.searchsorted(known, key)
    hit = np.flatnonzero(place < len(known))
    hit = hit[known[place[hit]] == key[hit]]
    place, at = place[hit], at[hit]
    some = np.flatnonzero(np.bincount(at, minlength=len(rows)))
    sums = {c: np.bincount(at, x[place], len(rows))[some].astype(x.dtype) for c, x in values.items()}
    return {"rows": rows[some], "sizes": np.zeros(len(some), np.int64), **sums}


def scored(docs: DataFrame, held_out: Column, order: int = 3, word_share: float = 2e-6, least_share: float = 2e-6, least_count: int = 3, flush: int = 1_500_000, bucket_tokens: int = 1_000_000) -> DataFrame:
    """Every row's doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, by a model of the rows that aren't held out.

    The shares only tell how many terms of an order are sent to all workers, 1 / share at most; the scores don't depend on them.
    ``flush``: places of other terms that a task holds before it sends them, packed by buckets of keys; ``bucket_tokens``: training
    tokens a bucket, whose terms and places one task holds at a time.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    terms, filters, total, vocabulary = model(texts.where("not held_out").select("text"), order, least_count)
    # every token counts as the unknown word at first; a word's term makes up the difference
    unknown = float(np.log10(0.5 / max(total + 0.5 * (vocabulary + 1), 1.0)))
    word = F.col("level") == 1
    terms = terms.select("level", "key", "n", *(F.when(word, F.col(c) - unknown).otherwise(F.col(c)).alias(c) for c in ("base", "score")))
    frequent = most_frequent(terms, [int(1 / word_share)] + [int(1 / least_share)] * (order - 1))
    tables = []
    for n in range(1, order + 1):
        hot = terms.where(frequent & (F.col("level") == n)).select("key", *(["base", "score"] if n == 1 else ["score"])).toArrow()
        key, *values = (hot.column(c).to_numpy() for c in hot.column_names)
        tables.append(Shared(key.view(np.uint64), *values))
    shared = spark.sparkContext.broadcast((tables, filters))

    buckets = max(1, -(-total // bucket_tokens))
    parts = -(-buckets // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tables, filters), held, seen, size, n_seen = shared.value, [], [], 0, 0

        def out():
            key, at = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            rows, place = np.unique(np.concatenate(seen), return_inverse=True)
            seen.clear()
            by = np.argsort(key)
            key, at = key[by], place.astype(np.int32)[at[by]]
            del by
            bucket = bucket_of(key, buckets)
            first = runs(bucket)
            bucket, pieces, n = bucket[first], [], 0
            for b, a, z in zip(bucket.tolist(), first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
                mine, index = indexed(at[a:z], len(rows))
                pieces.append([b, packed(key[a:z]), packed(rows[mine]), index.tobytes(), *[b""] * 4])
                n += z - a
                if n >= SENT_ROWS or z == len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces, strict=True), _SENT, strict=True)], schema=_SENT)
                    pieces, n = [], 0

        for part in slices(batches):
            words, owner = hashed(part.column("text").cast(pa.binary()).to_pylist())
            m, rows = part.num_rows, part.column("row").to_numpy()
            sizes = np.bincount(owner, minlength=m)
            known, base, score = np.zeros(m, np.int64), sizes * unknown, sizes * unknown
            for n, (key, table) in enumerate(zip(gram_keys(words, order), tables, strict=True), 1):
                mine = owner[: len(key)]
                if n > 1:
                    start = np.flatnonzero((mine == owner[len(owner) - len(key) :]) & among(filters[n - 2], key))
                    mine, key = mine[start], key[start]
                place = table.places(key)
                hit = place >= 0
                score += np.bincount(mine[hit], table.values[-1][place[hit]], m)
                if n == 1:
                    base += np.bincount(mine[hit], table.values[0][place[hit]], m)
                    known += np.bincount(mine[hit], minlength=m)
                held.append((key[~hit], (n_seen + mine[~hit]).astype(np.int32)))
                size += len(held[-1][0])
            seen.append(rows.view(np.uint64))
            n_seen += m
            # the documents' own sums go to a bucket of their first one's
            at = int(bucket_of(rows[:1].view(np.uint64), buckets)[0])
            columns = [at, b"", rows.tobytes(), b"", sizes.astype(np.int64).tobytes(), known.tobytes(), base.tobytes(), score.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _SENT, strict=True)], schema=_SENT)
            if size >= flush:
                yield from out()
                size, n_seen = 0, 0
        if size:
            yield from out()

    def met(sent: pa.Table, terms: pa.Table) -> pa.Table:
        """The sums by document of a bucket's terms, and the documents' own."""
        known = terms.column("key").to_numpy().view(np.uint64)
        by = np.argsort(known)
        known = known[by]
        values = {c: terms.column(c).to_numpy()[by] for c in ("known", "base", "score")}
        kinds = {"rows": np.uint64, "sizes": np.int64, "known": np.int64, "base": np.float64, "score": np.float64}
        found: dict[str, list[np.ndarray]] = {c: [np.zeros(0, kind)] for c, kind in kinds.items()}
        # piece by piece, so that only sums by document are held for all of them
        for at in range(sent.num_rows):
            piece = {c: sent.column(c)[at].as_buffer() for c in sent.column_names[1:]}
            if len(piece["sizes"]):
                sums = {c: np.frombuffer(piece[c], kind) for c, kind in kinds.items()}
            else:
                sums = matched(piece, known, values)
            for c, x in sums.items():
                found[c].append(x)
        both = {c: np.concatenate(x) for c, x in found.items()}
        del found
        # packed by ranges of documents, so that a bucket is no row for each of its documents
        by = np.argsort(both["rows"])
        both = {c: x[by] for c, x in both.items()}
        part = bucket_of(both["rows"], parts)
        first = runs(part)
        pieces = list(zip(first.tolist(), np.append(first[1:], len(part)).tolist(), strict=True))
        columns = [pa.array(part[first])] + [pa.array([(packed if c == "rows" else planes)(x[a:z]) for a, z in pieces], pa.binary()) for c, x in both.items()]
        del both, by
        release()
        return pa.table(columns, names=["part", *kinds])

    def summed(pieces: pa.Table) -> pa.Table:
        """Every document of a range with the sums of all buckets; rows of one id and text have one sum, over all of them."""
        ids = [unpacked(x.as_buffer()) for x in pieces.column("rows")]
        sizes = [flat(x.as_buffer(), np.int64) for x in pieces.column("sizes")]
        # every document's own sums are among them
        rows = np.unique(np.concatenate([x[n > 0] for x, n in zip(ids, sizes, strict=True)]))
        copies, sums = np.zeros(len(rows)), {c: np.zeros(len(rows)) for c in ("sizes", "known", "base", "score")}
        for k, (mine, size) in enumerate(zip(ids, sizes, strict=True)):
            at = np.searchsorted(rows, mine)
            copies += np.bincount(at, size > 0, len(rows))
            for c, kind in (("sizes", None), ("known", np.int64), ("base", np.float64), ("score", np.float64)):
                sums[c] += np.bincount(at, size if kind is None else flat(pieces.column(c)[k].as_buffer(), kind), len(rows))
            ids[k] = sizes[k] = None
        out = [x / copies for x in sums.values()]
        release()
        return pa.table([pa.array(rows.view(np.int64)), *(pa.array(np.rint(x).astype(np.int64)) for x in out[:2]), *map(pa.array, out[2:])], names=["row", "n_tokens", "n_known", "base_score", "score"])

    sent = texts.select("row", "text").mapInArrow(trimmed(run), "bucket long, keys binary, rows binary, at binary, sizes binary, known binary, base binary, score binary")
    bucket = F.shiftright(F.call_function("shiftrightunsigned", "key", F.lit(32)) * F.lit(buckets), 32)
    rest = terms.where(~frequent).select(bucket.alias("bucket"), "key", F.when(word, 1).otherwise(0).cast("long").alias("known"), "base", "score")
    met_ = sent.groupBy("bucket").cogroup(rest.groupBy("bucket")).applyInArrow(met, "part long, rows binary, sizes binary, known binary, base binary, score binary")
    found = met_.groupBy("part").applyInArrow(summed, "row long, n_tokens long, n_known long, base_score double, score double")
    named = texts.select("doc_id", "held_out", "row").join(found, "row")
    return named.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


_SENT = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("keys", "rows", "at", "sizes", "known", "base", "score"))])
