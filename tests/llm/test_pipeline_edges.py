import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edges(spark):
    texts = {
        1: "Plain words of a first document, which nobody else has written in quite this way.", 2: None, 3: "", 4: " \n\t", 5: "long text without end " * 30_000, 7: "né à Paris œuvre 中文 текст",
    }
    rows = [(i, t, "en", "a", len(t or "")) for i, t in texts.items()]
    rows += [(None, "a document without an id that is written here", None, None, 5), (None, None, None, None, None), (-(2**63), "the least id of all stands in this text", "de", "b", 1)]
    rows += [(1, texts[1], "en", "a", len(texts[1]))] * 2 + [(9, texts[1], "xx", "b", 3), (10, texts[1], "en", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, docs):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        out[name] = rows
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_nulls_empties_repeats_and_long_texts(spark):
    docs = edges(spark)
    out = run(spark, docs)
    # nothing is labelled here, so nothing is toxic
    assert len(out["toxicity"]) == docs.count()
    kept = out["simhash_dedup"]
    assert sum(r.text is not None and r.text.startswith("Plain") for r in kept) == 1
    # texts without words are one group, whose smallest id stays
    assert [r.doc_id for r in kept if not (r.text or "").strip()] == [2]
    assert {r.doc_id for r in kept} == {1, 2, 5, 7, None, -(2**63)} and len(out["decontaminate"]) == len(kept)
    mixed = out["mix"]
    assert all(r.text and r.n_chars == len(r.text) for r in mixed) and {r.doc_id for r in mixed} <= {1, 5, 7, None, -(2**63)}
    store = out["token_store"]
    assert len(store) == len(mixed) and sum(r.n_tokens for r in store) == max(r.start + r.n_tokens for r in store)
    again = run(spark, docs.repartition(7))
    assert sorted(map(str, again["mix"])) == sorted(map(str, mixed)) and sorted(map(str, again["token_store"])) == sorted(map(str, store))


def test_empty_tables(spark):
    docs = edges(spark).where("false")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        assert found.count() == 0
        if name != "token_store":
            assert found.dtypes == docs.dtypes
            docs = found


def test_further_columns_stay(spark):
    docs = edges(spark).selectExpr("*", "doc_id as fp", "text as low", "1 as score", "source as row")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [*edges(spark).columns, "fp", "low", "score", "row"], name
        assert docs.count() > 0
