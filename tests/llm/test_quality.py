import random
import zlib

import numpy as np

from folio.llm import quality as Q


def walk(trees, row):
    total = trees.base
    for at in trees.roots:
        while trees.left[at] != at:
            at = trees.left[at] + int(row[trees.feature[at]] > trees.cut[at])
        total += trees.value[at]
    return total


def test_fit_learns_and_flat_walk_matches_recursive_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.3) | ((x[:, 3] > 0.2) & (x[:, 4] > 0))).astype(int)
    trees = Q.fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert np.allclose(trees.margin(x[:50]), [walk(trees, row) for row in x[:50]])


def test_degenerate_labels():
    x = np.zeros((4, len(Q.FEATURES)))
    assert Q.fit(x[:0], np.array([])).score(x).tolist() == [0.5] * 4
    assert (Q.fit(x, np.ones(4)).score(x) > 0.8).all()
    assert (Q.fit(x, np.zeros(4)).score(x) < 0.2).all()


def corpus(n):
    rng = random.Random(6)
    words = ["the", "of", "river", "stone", "walking", "Éire", "under", "light", "garden", "seven"]
    rows = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        bad = i % 3 == 0
        if bad:
            body = [w.upper() + "!!" for w in body] if i % 2 else [w for w in body[:10] for _ in range(9)]
        rows.append((i, " ".join(body), "x", 0.5, int(not bad)))
    return rows


def test_held_out_accuracy_and_keep(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(r[0], r[4], 0) for r in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    trees = Q.train(docs, labels)
    got = {r.doc_id: r.score for r in Q.score(docs, trees).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(out) > 50 and np.mean([(got[r[0]] >= 0.3) == r[4] for r in out]) > 0.95
    kept = Q.keep(docs, trees)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.3}


def test_held_out_rows_are_not_examples(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, "some words here") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    assert Q.train(docs, labels).base == 0.0


def test_odd_rows(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (2, ""), (3, " \n "), (4, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.score(docs, Q.train(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert Q.score(docs.limit(0), Q.train(docs, labels)).collect() == []
