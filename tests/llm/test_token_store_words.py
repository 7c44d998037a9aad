import numpy as np
import pyarrow as pa
import pytest

from tessarine.llm import queries, token_store

pytest.importorskip("tokenizers")

TEXTS = ["And and, AND. Été", None, "", "  été; and\tand!? \n x1 it's <|endoftext|>", "a\x1cb c\x85d　e", "İ ǅ ﬁ 日本 ÷× ×,", "!!! and.", "x,y and,,and"]


def whole(encoder, text):
    return np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_letters_are_encoded_once_whatever_their_case_and_marks():
    """Each of these words was split, looked up and encoded on its own."""
    encoder, asked = token_store.WordEncoder(queries.tokenizer_file()), []
    modelled = encoder.modelled
    encoder.modelled = lambda words: asked.extend(words) or modelled(words)
    for _ in range(2):
        assert encoder.encode_all(pa.array(TEXTS)) == [whole(encoder, t) for t in TEXTS]
    assert sorted(asked) == ["and", "été"]


def test_words_and_ranges_of_any_cut():
    encoder = token_store.WordEncoder(queries.tokenizer_file(), keep=3)
    texts = pa.array(["left out", *TEXTS * 5, "left out"]).slice(1, 5 * len(TEXTS))
    want = [whole(encoder, t) for t in texts.to_pylist()]
    for at_once in (1, 7, 1000):
        assert encoder.encode_all(texts, at_once) == want
    for most, rows in ((1, 1024), (30, 3), (1 << 24, 4)):
        ranges = list(token_store.in_bytes(texts, most, rows))
        assert [k for a, z in ranges for k in range(a, z)] == list(range(len(texts)))
        assert all(z - a <= rows and (z - a == 1 or sum(len((t or "").encode()) for t in texts.to_pylist()[a:z]) <= most) for a, z in ranges)
    assert encoder.encode_all(pa.array([], pa.string())) == [] and not list(token_store.in_bytes(pa.array([], pa.string())))


def test_runs_of_letters_whose_ends_are_unknown_go_through_the_whole_tokenizer():
    encoder = token_store.WordEncoder(queries.tokenizer_file())
    encoder.last[:] = False
    assert encoder.encode_all(pa.array(TEXTS)) == [whole(encoder, t) for t in TEXTS]
