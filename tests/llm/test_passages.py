import numpy as np

from tessarine.llm import passages


def slow_windows(values, length):
    """Places of the minimum of every subsequence, and the runs of starts that share one."""
    at = [s + int(np.argmin(values[s : s + length])) for s in range(len(values) - length + 1)]
    return [(c, at.index(c), len(at) - 1 - at[::-1].index(c)) for c in dict.fromkeys(at)]


def test_compact_windows():
    rng = np.random.default_rng(9)
    for n in (0, 3, 7, 8, 40, 333):
        values = rng.permutation(np.arange(n, dtype=np.uint64) * 3 + 1)
        got = list(zip(*(x.tolist() for x in passages.compact_windows(values, 7)), strict=True))
        assert sorted(got) == sorted(slow_windows(values, 7))
        tied = values % 5
        assert sorted(zip(*(x.tolist() for x in passages.compact_windows(tied, 7)), strict=True)) == sorted(slow_windows(tied, 7))
    parts = [rng.integers(0, 99, k).astype(np.uint64) for k in (3, 20, 0, 7, 15)]
    got = list(zip(*(x.tolist() for x in passages.compact_windows(np.concatenate(parts), 7, [len(x) for x in parts])), strict=True))
    begins = np.cumsum([0, *(len(x) for x in parts)])
    assert sorted(got) == sorted(tuple(int(v + b) for v in w) for x, b in zip(parts, begins, strict=False) for w in slow_windows(x, 7))


def corpus(seed=21, n=150):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(20_000)}"
    shared = [[word() for _ in range(rng.integers(55, 90))] for _ in range(8)]
    line = [word() for _ in range(14)]
    docs, truth = [], {}
    for i in range(n):
        text = [word() for _ in range(rng.integers(0, 150))]
        if i % 2:
            text[len(text) // 2 : len(text) // 2] = line
        if i % 3 == 0:
            k = int(rng.integers(8))
            copy = list(shared[k])
            if i % 6 == 0:
                copy[int(rng.integers(len(copy)))] = word()
            at = int(rng.integers(len(text) + 1))
            text[at:at] = copy
            truth.setdefault(k, set()).add(i)
        docs.append((i, "  ".join(text).upper() if i % 5 == 0 else " ".join(text)))
    return docs, truth, [" ".join(s) for s in shared]


def similar(a, b, length=passages.LENGTH):
    """Whether some windows of both texts have the similarity (brute force over all pairs of windows)."""
    x, y = (passages.shingles(t.encode()).tolist() for t in (a, b))
    p, q = ([frozenset(v[s : s + length]) for s in range(len(v) - length + 1)] for v in (x, y))
    return any(len(u & v) / len(u | v) >= 0.8 for u in p for v in q if u & v)


def test_repeats_are_found_and_nothing_else(spark):
    docs, truth, _ = corpus()
    copy = docs[1][1] + " " + " ".join(f"u{i}" for i in range(60))
    extra = [(1000, copy), (1001, copy), (None, copy), (1002, None), (1003, ""), (1004, "short text twice"), (1005, "short text twice"), (1006, "again and " * 40_000)]
    table = spark.createDataFrame([(*d, "x") for d in docs + extra], "doc_id long, text string, span string").repartition(6)
    got = {r.doc_id: r for r in passages.repeated(table).collect()}
    wanted = {i for ids in truth.values() if len(ids) > 1 for i in ids} | {1000, 1001, None}
    if similar(docs[1][1], copy):
        wanted.add(1)
    assert got.keys() <= wanted and len(got) >= 0.95 * len(wanted)
    exact = {k: {i for i in ids if i % 6} for k, ids in truth.items()}
    for ids in exact.values():
        if len(ids) > 1:
            assert ids <= got.keys() and len({got[i].class_id for i in ids}) == 1
    assert got[1000].class_id == got[1001].class_id == got[None].class_id
    linked = {(r.text_key, r.other) for r in passages.links(table).collect()}
    assert all(a != b for a, b in linked)
    assert passages.repeated(table.where("false")).count() == 0


def test_near_copies(spark):
    rng = np.random.default_rng(2)
    rows, pairs = [], 0
    for i in range(80):
        text = [f"v{rng.integers(10**6)}" for _ in range(120)]
        near = list(text)
        near[int(rng.integers(120))] = "changed"
        near[int(rng.integers(120))] = "another"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(near))]
        pairs += similar(rows[-1][1], rows[-2][1])
    got = {r.doc_id: r.class_id for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c in (i, i - 1) for i, c in got.items()) and len(got) >= 2 * 0.95 * pairs


def test_changed_passages_of_fifty_words(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"z{rng.integers(10**6)}" for _ in range(n)]
    rows = []
    for i in range(400):
        part, near = words(50), None
        near = list(part)
        near[25 if i % 2 else int(rng.integers(50))] = "changed"
        rows += [(2 * i, " ".join(words(60) + part + words(60))), (2 * i + 1, " ".join(words(60) + near + words(60)))]
    alike = {k for k in range(400) if similar(rows[2 * k][1], rows[2 * k + 1][1])}
    got = {r.doc_id // 2 for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(alike) > 300 and got <= alike and len(got) >= 0.98 * len(alike)


def test_links_do_not_depend_on_the_first_text_of_a_group(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [f"y{rng.integers(10**6)}" for _ in range(n)]
    rows = []
    for i in range(20):
        part = words(50)
        rows += [(100 * i + k, " ".join(words(40) + part + words(40))) for k in range(2)]
        rows += [(100 * i + k, " ".join(words(40) + (part[:36] if k % 2 else part[14:]) + words(40))) for k in range(2, 32)]
    got = {r.doc_id for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string"), hashes=1).collect()}
    assert {100 * i + k for i in range(20) for k in range(2)} <= got
