import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessarine.llm import lm_score


class _Texts:
    """A table that keeps the function of its mapInArrow."""

    def __init__(self, spark):
        self.sparkSession, self.run = spark, None

    def mapInArrow(self, run, _):
        self.run = run
        return self

    def __getattr__(self, _):
        return lambda *a: self


def test_a_task_sends_what_it_holds_in_parts(spark):
    """All n-grams of a flush, two million, went to the JVM as one batch, which it holds outside its heap."""
    texts = _Texts(spark)
    lm_score.gram_counts(texts, 1)
    batch = pa.record_batch({"text": [" ".join(f"w{i}" for i in range(at, at + 1000)) + " again" for at in range(0, 200_000, 1000)]})
    got = list(texts.run(iter([batch])))
    assert max(b.num_rows for b in got) <= lm_score.SENT_ROWS
    assert sum(b.num_rows for b in got) == 200_002
    assert sum(sum(b.column("n").to_pylist()) for b in got) == 200_400


def test_every_python_task_gives_memory_back(spark, monkeypatch):
    """Idle workers stay beside those of the next stage, so each function wraps or ends in what releases memory."""
    asked = []
    monkeypatch.setattr(lm_score, "trimmed", lambda run: asked.append(run) or run, raising=False)
    docs = spark.createDataFrame([(i, "the same words here " * 3) for i in range(20)], "doc_id long, text string")
    assert lm_score.scored(docs, F.lit(False)).count() == 20
    # three orders are counted, then texts are scored
    assert len(asked) == 4


def test_a_piece_meets_its_terms():
    rng = np.random.default_rng(3)
    known = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    values = {"known": rng.integers(0, 2, len(known)), "base": rng.random(len(known)), "score": rng.random(len(known))}
    for docs, dtype in ((200, "u1"), (300, "u2"), (70_000, "u4")):
        rows = np.unique(rng.integers(0, 2**63, docs).astype(np.uint64))
        key = np.sort(np.concatenate([rng.choice(known, docs), rng.integers(0, 2**63, docs).astype(np.uint64)]))
        places = np.concatenate([np.arange(len(rows)), rng.integers(0, len(rows), len(key))])[: len(key)]
        mine, at = lm_score.indexed(places, len(rows))
        assert at.dtype == dtype and (rows[mine][at] == rows[places]).all()
        piece = {"keys": lm_score.packed(key), "rows": lm_score.packed(rows[mine]), "at": at.tobytes()}
        got = lm_score.matched(piece, known, values)
        term, want = {k: i for i, k in enumerate(known.tolist())}, {}
        for k, row in zip(key.tolist(), rows[places].tolist(), strict=True):
            if k in term:
                want[row] = want.get(row, 0) + np.array([values[c][term[k]] for c in values])
        assert got["rows"].tolist() == sorted(want)
        for j, c in enumerate(values):
            assert np.allclose(got[c], [want[r][j] for r in sorted(want)])
