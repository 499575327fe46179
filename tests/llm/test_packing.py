import random
import re
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folio.llm import packing as K

PATH = P.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def check(rows, docs):
    """Every id lies in exactly one piece; sequences have no gaps and are full or a power of two long."""
    want = {}
    for i, text in docs:
        ids = WHOLE.encode(text or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append(ids)
    sequences, by_doc = {}, {}
    for doc, start, length, crc, total, sequence, offset in rows:
        sequences.setdefault(sequence, []).append((offset, length))
        by_doc.setdefault(doc, []).append((start, length, crc, total))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= K.WINDOW and at & (at - 1) == 0
    assert by_doc.keys() == want.keys()
    for doc, (ids, *others) in want.items():
        if others:
            assert sum(p[1] for p in by_doc[doc]) == sum(map(len, want[doc]))
            continue
        at = 0
        for start, length, crc, total in sorted(by_doc[doc]):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)


def topics(n):
    rng = random.Random(9)
    words = [["".join(rng.choices("bcdfglmnprst" "aeiou", k=7)) for _ in range(60)] for _ in range(20)]
    return [(i, " ".join(rng.choices(words[i % 20], k=rng.randrange(1, 400)))) for i in range(n)]


def test_pieces(spark):
    docs = topics(300) + [(1000, None), (1001, ""), (1002, "word " * 30_000), (None, "lost words"), (7, "twice"), (1003, "ÉCOLE don't 12"), (1004, "<|endoftext|> x")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, start int").repartition(3)
    check([tuple(r) for r in K.pack(frame, PATH).collect()], docs)
    assert K.pack(frame.limit(0), PATH).collect() == []


def test_neighbours_match_brute_force():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 300, rng.integers(0, 60)) for _ in range(60)]
    flat, ends = np.concatenate(docs).astype(np.int32), np.cumsum([0, *map(len, docs)])
    index, n = K.Index(flat, ends), len(docs)
    mean = np.mean([len(d) for d in docs])
    unused = rng.random(n) < 0.7
    for seed in range(n):
        scores = np.zeros(n)
        for term in set(docs[seed].tolist()):
            df = sum(term in d for d in docs)
            if 1 < df <= max(2, K.COMMON * n):
                for j, d in enumerate(docs):
                    tf = (d == term).sum()
                    scores[j] += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (K.K1 + 1) / (tf + K.K1 * (1 - K.B + K.B * len(d) / mean)) if tf else 0
        got = index.neighbours(seed, unused)
        assert set(got) == {j for j in range(n) if scores[j] > 0 and unused[j]}
        assert (np.diff(scores[got]) <= 1e-9).all()


def test_terms_of_very_many_documents_find_neighbours():
    """Terms in a third of a shard's documents and in all of them count, by rows over all documents or by postings."""
    rng = np.random.default_rng(4)
    docs = [np.concatenate([[1, 2 + i % 3], rng.integers(0, 3, 5) + 10, [100 + i]]) for i in range(90)]
    flat, ends, cells = np.concatenate(docs).astype(np.int32), np.cumsum([0, *map(len, docs)]), K.CELLS
    both = []
    for K.CELLS in (cells, 0):
        index = K.Index(flat, ends)
        both.append([index.neighbours(seed, np.arange(90) != seed) for seed in range(90)])
    K.CELLS = cells
    for seed, (found, same) in enumerate(zip(*both)):
        assert len(found) == len(same) == 89 and found[0] % 3 == seed % 3
        assert sum(j % 3 == seed % 3 for j in found[:29].tolist()) > 20


def test_windows_hold_related_documents(spark):
    docs = topics(400)
    rows = K.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), PATH).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r.doc_id % 20)
    same = [sum(a == b for a, b in zip(v, v[1:])) / (len(v) - 1) for v in by.values() if len(v) > 1]
    assert np.mean(same) > 0.5


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sé́\x1c\x85<|>İΣ"))))
def test_word_by_word_is_whole(text):
    flat, _ = K.pieces(PATH).encode([text])
    assert flat.tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ1éΣ½.,;!$|&<>'`-s \n\u0301\u0338\u00a0"))
def test_signs_at_the_end_of_words(text):
    flat, _ = K.pieces(PATH).encode([text])
    assert flat.tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_cut_is_white_space():
    assert K._CUT(" a\tb\n\nc\x0bd ") == re.split(r"\s", "a b c d")
