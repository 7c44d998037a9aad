import re
from collections import Counter
from math import comb

import numpy as np
from pyspark.sql import functions as F

from tessarine.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def corpus():
    rng = np.random.default_rng(6)
    rows = []
    for i in range(120):
        words = [f"w{x}é" for x in rng.integers(0, 30, rng.integers(0, 90))]
        if i % 4 == 0 and words:
            words = words[:12] * int(rng.integers(1, 6)) + words
        text = "".join(w + [" ", "\n", "\t", "  ", " | ", "!!\n"][rng.integers(6)] for w in words)
        rows.append((i, text, ["en", "de", None][i % 3]))
    return rows + [(None, None, None), (None, "", "en"), (500, " \n\t", "en"), (501, "a\xa0b c\x1cd", "de"), (3, "again", "en"), (3, "again", "en"), (502, "long word " * 30_000, "en"), (503, "1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8", "en")]


def test_counts_and_base_rules(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.judged(docs, labels).collect()
    want = [(i, *slow_counts(t)) for i, t, _ in rows]
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judged(docs.where("false"), labels).count() == 0
    assert quality.judged(docs, labels.where("false")).where("kept = base_failed").count() == 0


def test_binomial_tail(spark):
    cases = [(n, k) for n in (0, 1, 7, 500, 20_000) for k in (0, 1, 4, n // 100, n // 2) if k <= n]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", quality.binomial_tail("n", "k", 0.01))
    for r in df.collect():
        if r.k > r.n * 0.01:
            assert r.p == 1
        elif r.n <= 500:
            assert np.isclose(r.p, sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)))


def test_cutoffs_limit_false_rejections(spark):
    n = 3000
    features = spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("stratum"), F.lit(100).cast("long").alias("n_words"), F.lit(1000).cast("long").alias("word_chars"),
        F.when(F.col("id") % 200 == 0, 60).otherwise(5).cast("long").alias("n_symbols"), F.lit(0).cast("long").alias("n_marks"), F.lit(10).cast("long").alias("n_lines"),
        F.when(F.col("id") % 20 == 0, 6).otherwise(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_repeat_words"),
    )
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = {r.rule: r.cutoff for r in quality.thresholds(features, labels).collect()}
    # one in 200 lies above 50, which is safely under one in 100; one in 20 has six of ten lines repeated, which isn't
    assert got == {"symbols": 10, "marks": 50, "dup_lines": 800, "repeats": 20, "long_words": 10000}
    assert set({r.rule: r.cutoff for r in quality.thresholds(features, labels.limit(100)).collect()}.values()) == {None}
