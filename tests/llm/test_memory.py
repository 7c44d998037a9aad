import pyarrow as pa

from tessarine.llm import common, simhash, toxicity


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_a_worker_gives_back_what_a_task_has_freed(spark):
    """A task leaves small pieces in use between large freed ones; without giving them back an idle worker keeps its largest size."""
    held = []

    def leaving(batches):
        rows = [b"x" * 1000 for _ in range(120_000)]
        held.extend(rows[::1000])
        yield from batches

    def run(of):
        before = _resident()
        assert len(list(of(iter([pa.record_batch({"x": [1]})])))) == 1
        return _resident() - before

    run(leaving)
    assert run(common.trimmed(leaving)) < 40_000_000


def test_stages_of_the_pipeline_give_memory_back(spark, monkeypatch):
    """Every Python task of both stages is one that gives back."""
    asked = []
    for module in (simhash, toxicity):
        monkeypatch.setattr(module, "trimmed", lambda run: asked.append(run) or run, raising=False)
    docs = spark.createDataFrame([(i, f"word{i} and more words here") for i in range(20)], "doc_id long, text string")
    simhash.with_fingerprints(docs)
    toxicity.without_toxic(docs, toxicity.Model({}, 0.0, 0.5))
    assert len(asked) == 2
