import zlib

import numpy as np
import pytest

from tessarine.llm import queries, token_store

pytest.importorskip("tokenizers")


def test_levels_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    for ids in (np.zeros(0), np.array([0]), np.array([255, 256, 65535, 65536, 2**32 - 1]), rng.integers(0, 70_000, 5000), rng.integers(0, 200, 513)):
        ids = ids.astype("<u4")
        s = token_store.Segment(token_store.pack_segment([None, 7], [ids.tobytes(), b""]))
        assert (s.ids() == ids).all() and s.n_tokens == len(ids)
        for i in range(0, len(ids), 37):
            assert s.token(i) == ids[i]
    assert s.doc_null.tolist() == [True, False]


ODD = ["", "a", "It's we'll 'S 're’s 3rd x2y", "a\x1cb c\x85d e f", "İstanbul ΣΑΣ ﬁne é ́x", "a<|endoftext|>b <|startoftext|> </w> x</w>y", "word, word. !!! $$$ ''' '' 's", "日本語 テスト　空白", "Éque\néaux\t\tÀ\x0b\x0cz\r\n", "\x00 ﻿​ zero"]


def test_words_encode_as_whole_texts():
    encoder = token_store.WordEncoder(queries.tokenizer_file(), keep=40)
    latin = "".join(map(chr, [*range(0xC0, 0x100)]))
    texts = ODD + ["x" * 5000, "The thing " * 3000] + [" ".join(ODD), latin, " ".join(latin), " ".join(f"{a}{b}," for a in latin[::5] for b in latin), latin + "x\xad\xa1"]
    whole = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [encoder.encode(t) for t in texts] == whole


def test_store_equals_encoding(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD * 30)] + [(None, "first"), (None, None), (5, "tie"), (5, "tie"), (-3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).repartition(5)
    path = token_store.write_store(docs, queries.tokenizer_file(), 1, segment_tokens=50)
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    t = token_store.WordEncoder(queries.tokenizer_file()).tokenizer
    at = 0
    for r, (i, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.read_store(spark, token_store.write_store(docs, queries.tokenizer_file(), 1)).count() == 0


def test_documents_encode_as_whole_texts():
    duckdb = pytest.importorskip("duckdb")
    encoder = token_store.WordEncoder(queries.tokenizer_file(), keep=5000)
    for (text,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall():
        assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
