from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessarine.llm import line_dedup

WS = " \t\n\x0b\x0c\r"


def corpus(sites=40):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        lines = [f"line {rng.integers(0, 400)}" for _ in range(rng.integers(0, 9))]
        if i % 2:
            lines.insert(0, "\t cookie notice \r")
        if i % 3 == 0:
            lines += ["", "all rights reserved", "  "]
        rows.append((i, "\n".join(lines), f"site{rng.integers(sites)}" if i % 11 else None))
    return rows + [(None, None, "a"), (None, "cookie notice", None), (900, "", "b"), (3, "cookie notice\nown", "c"), (3, "cookie notice\nown", "c"), (901, "x " * 100_000 + "\ncookie notice", "d")]


def test_lines_of_many_sites_go(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 0) for r in rows], "doc_id long, text string, source string, n_chars long, bad int")
    seen = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(WS):
                seen[line.strip(WS)].add(s)
    for sites in (1, 4, 5, 30):
        bad = {x for x, s in seen.items() if len(s) >= sites}
        want = sorted((str(i), "None" if t is None else "\n".join(x for x in t.split("\n") if x.strip(WS) not in bad), sum(x.strip(WS) in bad for x in (t or "").split("\n"))) for i, t, _ in rows)
        out = line_dedup.without_boilerplate(docs, sites)
        assert out.columns == [*docs.columns, "n_lines", "n_removed"]
        got = out.collect()
        assert sorted((str(r.doc_id), str(r.text), r.n_removed) for r in got) == want
        assert all(r.text is None or r.n_chars == len(r.text) for r in got)
    assert line_dedup.without_boilerplate(docs.where("false")).count() == 0


def test_sketches_and_exact_counts_agree_far_beyond_coupons(spark):
    lines = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "often").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 4)).otherwise("rare").alias("text"), F.when(F.col("id") % 3 == 2, "one").otherwise(F.col("id").cast("string")).alias("source"))
    got = line_dedup.boilerplate(lines, sites=5000, lg_k=10)
    keys = {r[0]: r[1] for r in lines.select("text", line_dedup.line_key(F.col("text"))).distinct().collect()}
    assert {r.key for r in got.collect()} == {keys[x] for x in ("often", "k0", "k1", "k2", "k3")}
