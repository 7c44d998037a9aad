import numpy as np

from tessarine.llm import decontaminate


def edit_distance_to_passage(item, doc):
    previous = [0] * (len(doc) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(doc, 1):
            row.append(min(previous[j - 1] + (a != b), previous[j] + 1, row[-1] + 1))
        previous = row
    return min(previous)


def planted(seed=7, n_items=25, n_docs=160):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{min(rng.zipf(1.4), 4000)}"
    items = [(i, [word() for _ in range(rng.integers(8, 60))]) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        text = [word() for _ in range(rng.integers(0, 120))]
        if d % 2:
            copy = list(items[rng.integers(n_items)][1])
            for _ in range(rng.integers(0, int(0.25 * len(copy)) + 1)):
                at = rng.integers(len(copy))
                kind = rng.integers(3)
                copy[at : at + (kind != 1)] = [word()] if kind else []
            at = rng.integers(len(text) + 1)
            text[at:at] = copy
        docs.append((d, text))
    return items, docs


def test_recall_and_exactness(spark):
    items, docs = planted()
    benchmark = spark.createDataFrame([(i, " ".join(w).upper() + ".") for i, w in items] + [(99, None), (98, ""), (97, "too short")], "item_id long, text string")
    table = spark.createDataFrame([(d, ", ".join(w)) for d, w in docs] + [(None, " ".join(items[0][1])), (500, None), (501, "")], "doc_id long, text string")
    want = {(d, i): e for d, w in docs for i, x in items if (e := edit_distance_to_passage(x, w)) <= int(0.2 * len(x))}
    want[None, 0] = 0
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(table, benchmark).collect()}
    assert got.keys() <= want.keys() and all(got[k].edits == want[k] for k in got)
    assert all((d, i) in got for (d, i), e in want.items() if e == 0)
    assert len(got) >= 0.95 * len(want) and len(want) > 60
    for (d, i), r in got.items():
        if d is not None:
            assert edit_distance_to_passage(dict(items)[i], dict(docs)[d][r.first_word : r.last_word + 1]) == r.edits
    blocks = decontaminate.leaks(table, benchmark, block_bytes=1500)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == got.keys()
    clean = decontaminate.decontaminated(table.withColumn("bad_id", table.doc_id), benchmark)
    assert clean.columns == ["doc_id", "text", "bad_id"]
    assert sorted(r.doc_id for r in clean.collect()) == sorted({500, 501, *(d for d, _ in docs)} - {d for d, _ in got})


def test_embedding_has_the_bits_of_its_definition():
    rng = np.random.default_rng(2)
    block = rng.integers(1, 9, (5, 12))
    every = decontaminate.cgk_embedding(block, 30, 6)
    for row, out in zip(block, every[4], strict=True):
        at, word, want = 0, [*row.tolist(), 0], []
        for step in range(30):
            want.append(word[min(at, 12)])
            with np.errstate(over="ignore"):
                x = np.array([want[-1]], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(4 * 1_000_003 + step)
            at += int(decontaminate._mix(x)[0] >> np.uint64(63))
        assert out.tolist() == want


def test_words_are_the_same_by_either_path():
    import re

    for text in ("The thing, re-done_x 3rd!", "ÉQUE eaux×x ÷ ñ", "“Quoted” — text", "", None, "日本 語", "İx"):
        assert decontaminate.words(text) == [w.encode() for w in re.findall(r"\w+", (text or "").lower())]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(some, items).count() == 0
    assert decontaminate.decontaminated(some, items).count() == 1


def test_short_items_leak_as_they_are(spark):
    items = [(1, "Capital of France?"), (2, "日本語"), (3, "..."), (4, "one two three four five six seven")]
    texts = ["say, capital of france; then", "capital of Spain", "x 日本語 y", "one two three four five six changed", "", "0 one two three four five six seven 8"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.edits, r.first_word, r.last_word) for r in got) == [(0, 1, 0, 1, 3), (2, 2, 0, 1, 1), (5, 4, 0, 1, 7)]
