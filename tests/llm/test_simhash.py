import numpy as np
import xxhash

from tessarine.llm import simhash


def slow_fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts():
    rng = np.random.default_rng(1)
    vocabulary = [f"W{i}é" for i in range(40)] + ["\xa0", "ÀB", "x\x1cy"]
    base = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(40)]
    near = [t + " tail" for t in base] + [t.replace("W1é", "W2é") for t in base]
    return base + near + base[:10] * 3 + ["", None, " \t\n", "one", "one two", "ONE two"] + ["long " * 30000]


def test_fingerprints():
    t = texts()
    got = simhash.fingerprints([None if x is None else x.encode() for x in t], block=500)
    assert [int(x) for x in got] == [slow_fingerprint(x) for x in t]


def slow_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)] = min(doc_id, ids.get(root(i), doc_id))
    return [(d, f"{f:016x}", ids.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))]


KEY = lambda r: tuple((x is not None, x) for x in r)


def test_components_and_dedup(spark):
    rows = [(997 - 3 * i, t) for i, t in enumerate(texts())] + [(None, "null id only words here"), (None, None), (5, "tie one two three"), (5, "tie one two three"), (5, "another text of five")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(6)
    got = [tuple(r) for r in simhash.simhash_components(docs).collect()]
    want = slow_components(rows)
    assert sorted(got, key=KEY) == sorted(want, key=KEY)
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(c, f) for _, f, c in want if (c, f) in {(d, g) for d, g, _ in want}})
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}


def test_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63, 30)]
    fps += [f ^ (1 << int(b)) for f in fps for b in rng.integers(0, 62, 3)] + [0, -1, 1 << 62, -(2**63)]
    fps = sorted({f ^ ((1 << int(rng.integers(0, 62))) if rng.random() < 0.5 else 0) for f in fps} | set(fps))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {frozenset(r) for r in simhash.ball_links(df).collect()}
    near = {frozenset((a, b)) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got <= near

    def groups(links):
        label = {f: f for f in fps}
        for _ in fps:
            for a, b in map(tuple, links):
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert groups(got) == groups(near)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).count() == 0 and simhash.simhash_dedup(docs).count() == 0
