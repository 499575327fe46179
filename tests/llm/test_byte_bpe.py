import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import byte_bpe as B

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def peer(name):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(P.path(name)), special_tokens={})


@pytest.mark.parametrize("name", FILES)
def test_matches_library(name, spark):
    rng = random.Random(4)
    bits = ["the ", "ing", "Ünï", "漢字", "🙂", "  ", "\n\n", "1234567", "!!!", "'s", "a" * 50, "zq", "́"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 60))) for _ in range(300)] + ["", None, "x" * 5000, "ab" * 3000, " " * 4000, "<|endoftext|>"]
    ids, ends = B.codec(P.path(name), P.PATTERN).encode(texts)
    want = peer(name)
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == want.encode_ordinary(text or "")
    assert B.codec(P.path(name), P.PATTERN).decode(ids).tobytes().decode() == "".join(t or "" for t in texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_any_text(texts):
    ids, ends = B.codec(P.path(FILES[0]), P.PATTERN).encode(texts)
    want = peer(FILES[0]) if not hasattr(test_any_text, "peer") else test_any_text.peer
    test_any_text.peer = want
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == want.encode_ordinary(text)


def test_matrix_and_heap_agree():
    own = B.codec(P.path(FILES[0]), P.PATTERN)
    rng = random.Random(8)
    cuts = ["".join(rng.choices("abcdeinrst", k=rng.randrange(2, 80))).encode() for _ in range(200)]
    for got, cut in zip(own.merge_rows(cuts), cuts):
        assert got.tolist() == own.merge_long(cut).tolist()


def test_pair_table():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**45, 5000))
    table = B.PairTable(keys, np.arange(len(keys), dtype=np.int32))
    assert (table.find(keys >> 32, keys & (2**32 - 1)) == np.arange(len(keys))).all()
    assert (table.find(np.array([2**20]), np.array([5])) == B._NONE).all()


def test_table(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, None, "y"), (2, "", "z"), (3, "long " * 100_000, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = P.path(FILES[0])
    got = B.decode(B.encode(frame, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in got), key=str) == sorted([(i, t or "") for i, t, _ in rows], key=str)
    assert B.encode(frame.limit(0), path, P.PATTERN).collect() == []
