from collections import Counter

import corpus_pipeline
from tessarine.llm import decontaminate, queries, simhash

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontaminate", "mix", "token_store"]
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "token_store":
            assert docs.dtypes == before.dtypes
        rows[name] = docs.collect()
        docs = spark.createDataFrame(rows[name], docs.schema)
    texts = {r.doc_id: r.text for r in before.collect()}
    ids = {n: {r.doc_id for r in x} for n, x in rows.items()}
    assert ids["mix"] <= ids["decontaminate"] <= ids["simhash_dedup"] <= ids["toxicity"] <= texts.keys()
    # near duplicates: one document of each group of the stage's own input
    fps = {i: int(simhash.fingerprints([texts[i].encode()], 3)[0]) for i in ids["toxicity"]}
    group = {i: i for i in fps}
    while True:
        step = {i: min(group[j] for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 2) for i in fps}
        if step == group:
            break
        group = step
    assert ids["simhash_dedup"] == set(group.values()) and len(rows["simhash_dedup"]) == len(set(group.values()))
    # leaks: no item stands in a kept document word for word
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i: b" ".join([b"", *decontaminate.words(texts[i]), b""]) for i in ids["simhash_dedup"]}
    leaky = {i for i, t in held.items() if any(b" ".join([b"", *x, b""]) in t for x in items)}
    assert leaky and not leaky & ids["decontaminate"]
    # the store holds the mix row by row
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_file())
    want = Counter((r.doc_id, len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in rows["mix"])
    assert Counter((r.doc_id, r.n_tokens) for r in rows["token_store"]) == want
    ordered = sorted(rows["token_store"], key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:k]) for k in range(len(ordered))]
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in ordered)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
