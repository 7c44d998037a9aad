import tracemalloc

import pyarrow as pa

from tessarine.llm import common, simhash, toxicity


class _Docs:
    """A table whose mapInArrow gives its function."""

    schema = None

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def _peak(run, batch):
    """Python's bytes at most, and the rows that came back."""
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, rows


def test_a_batch_becomes_python_objects_in_parts(spark, monkeypatch):
    """Both stages held the texts of a whole batch as Python objects beside it: some 64 MB a worker."""
    n, text = 8000, "seven words of a text are here " * 100
    batch = pa.record_batch({"doc_id": pa.array(range(n), pa.int64()), "text_key": pa.array(range(n), pa.int64()), "text": [text] * n})
    monkeypatch.setattr(simhash, "fingerprints", lambda texts, width: __import__("numpy").zeros(len(texts), "u8"))
    monkeypatch.setattr(toxicity.Model, "features", lambda self, t, known: (0.0, 0.0))
    model = toxicity.Model({}, 0.0, 0.5, weights=[-1.0, 0.0, 0.0])
    for run in (simhash.with_fingerprints(_Docs()), toxicity.without_toxic(_Docs(), model), toxicity.scored(_Docs(), model)):
        peak, rows = _peak(run, batch)
        assert rows == n and peak < 6_000_000


def test_parts_hold_every_row_once():
    batch = pa.record_batch({"x": list(range(1300))})
    assert [x for part in common.in_parts(batch) for x in part.column("x").to_pylist()] == list(range(1300))
    assert not list(common.in_parts(batch.slice(0, 0)))
