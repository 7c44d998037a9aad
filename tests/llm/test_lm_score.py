import zlib
from collections import Counter
from math import log10

import numpy as np
from pyspark.sql import functions as F

from tessarine.llm import lm_score
from tessarine.llm.common import fold


def corpus():
    rng = np.random.default_rng(12)
    rows = []
    for i in range(400):
        words, last = [], 0
        for _ in range(rng.integers(0, 60)):
            last = (last * 7 + int(rng.integers(3))) % 30 if rng.random() < 0.8 else int(rng.integers(400))
            words.append(f"W{last}é")
        rows.append((i, " ".join(words)))
    return rows + [(None, None), (None, "w1é w2é"), (7, "again again"), (7, "again again"), (900, ""), (901, "w3é " * 20_000), (902, "never-seen \xa0 words")]


def test_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(5)
    got = lm_score.scored(docs, fold(F.col("doc_id")) == 1, word_share=1e-3, least_share=1e-4).collect()
    token = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in token(t))
    total = sum(counts.values())
    base = lambda t: sum(log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in token(t))
    want = sorted((str(i), held(i), len(token(t)), sum(counts[w] > 0 for w in token(t)), total, round(base(t), 5)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)
    assert lm_score.scored(docs.where("false"), F.lit(False)).count() == 0
    assert all(np.isfinite(r.score) and r.n_known == 0 for r in lm_score.scored(docs, F.lit(True)).collect())


def slow_probability(model, grams, counts, total, vocabulary, context, word):
    """Interpolated absolute discounting by its definition."""
    p = (counts.get((word,), 0) + 0.5) / (total + 0.5 * (vocabulary + 1))
    for n in range(1, len(context) + 1):
        h = tuple(context[-n:])
        seen = {g[-1]: c for g, c in grams.get(n + 1, {}).items() if g[:-1] == h}
        if not seen:
            continue
        c = counts[h]
        left = 1 - sum(x - lm_score.DISCOUNT for x in seen.values()) / c
        p = (seen[word] - lm_score.DISCOUNT if word in seen else 0) / c + left * p
    return p


def test_automaton_is_the_smoothed_model_and_sums_to_one():
    rng = np.random.default_rng(1)
    words = [lm_score.END] + [f"w{i}".encode() for i in range(6)]
    texts = [[*rng.integers(2, 8, rng.integers(0, 12)).tolist(), 1] for _ in range(80)]
    counts = Counter(tuple(t[i : i + n]) for t in texts for n in (1, 2, 3) for i in range(len(t) - n + 1))
    grams = {n: {g: c for g, c in counts.items() if len(g) == n and c >= 3} for n in (2, 3)}
    grams[3] = {g: c for g, c in grams[3].items() if g[:2] in grams[2] and g[1:] in grams[2]}
    total, vocabulary = sum(map(len, texts)), 7
    model = lm_score.Automaton(words, [counts[i,] for i in range(1, 8)], total, vocabulary, [np.array([[*g, c] for g, c in sorted(grams[n].items())]) for n in (2, 3)])
    model.build()
    for t in texts[:30]:
        want = sum(log10(slow_probability(model, grams, counts, total, vocabulary, [*t[max(0, i - 2) : i]] if i < 2 or tuple(t[i - 2 : i]) in grams[2] else t[i - 1 : i], w)) for i, w in enumerate(t))
        assert np.isclose(model.traverse(t), want)
    unknown = 0.5 / (total + 0.5 * (vocabulary + 1))
    for context in ([], [3], [4, 5], [2, 2]):
        before = model.traverse(context)
        mass = sum(10 ** (model.traverse([*context, w]) - before) for w in range(1, 8)) + unknown * 10 ** (model.traverse([*context, 0]) - before)
        assert np.isclose(mass, 1)


def test_every_ngram_of_the_least_count_counts_at_any_size(spark):
    rng = np.random.default_rng(5)
    rare = [f"rare{i}" for i in range(6)]
    texts = [" ".join(["the"] * int(rng.integers(3000, 4000))) for _ in range(100)]
    texts += [" ".join(rng.choice(rare, rng.integers(0, 12))) for _ in range(40)] + ["x" * 90 + " the rare0"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    token = lambda t: [*t.encode().split(), b"\n"]
    tokens = [token(t) for t in texts]
    words = sorted({w for t in tokens for w in t})
    ids = {w: i + 1 for i, w in enumerate(words)}
    counts = Counter(tuple(ids[w] for w in t[i : i + n]) for t in tokens for n in (1, 2, 3) for i in range(len(t) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    assert 3 < 1e-5 * total
    model = lm_score.Automaton(words, [counts[i + 1,] for i in range(len(words))], total, len(words), [np.array([[*g, c] for g, c in sorted(counts.items()) if len(g) == n and c >= 3]) for n in (2, 3)])
    model.build()
    want = [model.traverse([ids[w] for w in t]) for t in tokens]
    for shares in ({}, {"word_share": 1.0, "least_share": 1.0}):
        got = {r.doc_id: r.score for r in lm_score.scored(docs, F.lit(False), **shares).collect()}
        assert np.allclose([got[i] for i in range(len(texts))], want)
