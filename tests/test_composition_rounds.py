from collections import Counter, defaultdict

import numpy as np

from tessarine.operators import analysis


def test_paths_in_rounds_and_tasks(spark):
    rng = np.random.default_rng(5)
    rows = [(f"e{a}", f"r{r}", f"e{b}") for a, r, b in rng.integers(0, (30, 4, 30), (200, 3))] + [("hub", "r0", f"e{k}") for k in range(30)] + [(f"e{k}", "r1", "hub") for k in range(30)] + [(None, "r0", "e1"), ("e1", "r0", None)]
    triples = {x for x in rows if None not in x}
    out = defaultdict(list)
    for h, r, t in triples:
        out[h].append((r, t))
    paths = {(r1, r2, h, z) for h, r1, y in triples for r2, z in out[y]}
    support, hits = Counter(p[:2] for p in paths), Counter((r1, r2, r) for r1, r2, x, z in paths for r, t in out[x] if t == z)
    want = {k: (support[k[:2]], n / support[k[:2]]) for k, n in hits.items()}
    df = spark.createDataFrame(rows + rows[:50], "h string, r string, t string")
    for at_once, in_task in ((150_000_000, 3_000_000), (700, 50)):
        found = analysis.composition(df, at_once, in_task)
        got = {(x.r1, x.r2, x.r): (x.support, x.confidence) for x in found.collect()}
        assert got == want
