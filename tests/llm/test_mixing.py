import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessarine.llm import mixing


def slow_targets(sizes):
    """Shares by weight; what exceeds three times a size is shared again until none does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over


def corpus(seed=3, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = ["é", "a", None, "B", "b", "hot", "hot", "hot", "tiny"][rng.integers(9)] if i else "single"
        size = rng.integers(0, 8 if source == "tiny" else 900)
        rows.append((int(rng.integers(0, 5 * n)) if i % 17 else None, "\t".join(f"w{x}" for x in rng.integers(0, 99, size)), source))
    return rows + [(7, None, "a"), (8, "", "b"), (9, " \n", None), (10, "same words here", "a"), (10, "same words here", "a")]


def test_targets_and_takings(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = mixing.mix(docs, block=16).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    targets = slow_targets(sizes)
    assert sorted(Counter((r.source_size, round(r.target, 6)) for r in got)) == sorted({(sizes[s], round(targets[s], 6)) for s in sizes})
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source_size] += r.taken
    for s, t in targets.items():
        assert abs(taken[sizes[s]] - t) <= 16 + 0.01 * t
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), block=16).collect()))


def test_slots_are_permutations_dealt_to_shards(spark):
    targets = spark.createDataFrame([(0, 1000, 2500.0), (1, 37, 20.0), (2, 0, 0.0), (3, 160, 480.0)], "source_no long, source_size long, target double")
    got = mixing.slots(targets, block=10, shard_slots=64, per_row=50).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source_no, r.pass_no].append(r.block_no)
    assert {k: len(v) for k, v in by.items()} == {(0, 0): 100, (0, 1): 100, (0, 2): 50, (1, 0): 2, (3, 0): 16, (3, 1): 16, (3, 2): 16}
    assert all(len(set(v)) == len(v) for v in by.values()) and sorted(by[0, 0]) == sorted(by[0, 1]) == list(range(100))
    assert by[0, 0] != by[0, 1]
    assert sorted(r.shard * 64 + r.place for r in got) == list(range(len(got)))
    share = [r.slots / 64 for r in mixing.shard_counts(mixing.slots(targets, 10, 64)).where("source_no = 0 and shard < 4").collect()]
    assert len(share) == 4 and all(abs(x - 250 / 300) < 0.2 for x in share)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 256])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).withColumn("c", mixing.rounds_of(str(n), "5L")).select(mixing.permuted("id", str(n), "c")).collect()]
    assert sorted(got) == list(range(n)) and (n < 10 or got != sorted(got))


def test_mixed_documents_hold_what_is_taken(spark):
    rows = corpus(5, 120)
    docs = spark.createDataFrame([(*r, "en", len(r[1] or "")) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    out = mixing.mixed_documents(docs, block=16)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got, want, texts = Counter(), Counter(), defaultdict(set)
    for r in mixing.mix(docs, block=16).collect():
        want[r.doc_id] += r.taken
    for i, t, _ in rows:
        texts[i].update((t or "").split())
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and set(r.text.split()) <= texts[r.doc_id]
    assert got == +want
    whole = {t for _, t, _ in rows}
    assert any(r.text in whole for r in out.collect())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "", "a")], docs.schema)).first().taken == 0
