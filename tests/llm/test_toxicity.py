import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessarine.llm import queries, toxicity


def slow_segments(scores):
    """Maximal segments by their definition: recursively the best segment, then what lies left and right of it."""

    def best(lo, hi):
        found = None
        for a in range(lo, hi):
            total = 0
            for b in range(a, hi):
                total += scores[b]
                if total > 0 and (found is None or total > found[2]):
                    found = (a, b + 1, total)
        return [] if found is None else best(lo, found[0]) + [found] + best(found[1], hi)

    return best(0, len(scores))


def test_maximal_segments():
    rng = np.random.default_rng(4)
    for _ in range(60):
        s = rng.normal(-0.2, 1, rng.integers(0, 25)).tolist()
        got = toxicity.maximal_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow_segments(s)]
        assert np.allclose([x for *_, x in got], [x for *_, x in slow_segments(s)])
        assert np.isclose(toxicity.best_segment(np.array(s)), max([x for *_, x in got], default=0))


def corpus(n=600):
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(n):
        text = [f"w{x}" for x in rng.zipf(1.3, 40) if x < 10**6]
        toxic = int(rng.random() < 0.2)
        if toxic:
            text[5:5] = [f"vile{rng.integers(50)}" for _ in range(4)]
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_documents_and_passages(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(None, None), (9000, ""), (9001, None), (9002, "word " * 50_000), (9003, "vile1 vile2 vile999")], "doc_id long, text string").withColumn("toxic", F.lit("x"))
    table = spark.createDataFrame(labels + [(None, 1), (3, None), (0, labels[0][1])], "doc_id long, toxic int")
    model = toxicity.fit(docs, table, held_out=toxicity.held_out_fold(F.col("doc_id")))
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert len(got) == len(rows) + 5
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[9003].predicted == 1 and got[9002].predicted == 0 and got[9000].score == got[9001].score == got[None].score
    for r in toxicity.passages(docs.where("doc_id < 600"), model).collect():
        assert "vile" in " ".join(rows[r.doc_id][1].split()[r.first_word : r.last_word + 1]) or labels[r.doc_id][1] == 0
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, r in got.items() if not r.predicted)


def test_no_evidence(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for labels, want in (([], 0), ([(1, 1)], 1), ([(1, 0)], 0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert round(toxicity.scored(docs, model).first().score) == want
        assert toxicity.scored(docs.where("false"), model).count() == 0


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_held_out_accuracy_on_the_tables(spark, sf):
    d = f"/root/testdata/{sf}"
    got = queries.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    ranks, n1 = got.score.rank(), got.toxic.sum()
    auc = (ranks[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(got) - n1))
    assert auc > 0.93 and (got.predicted == got.toxic).mean() > 0.95
