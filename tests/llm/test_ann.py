import math

import numpy as np

from folio.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def hundredth(i):
    return i % 10 == 0


def brute(rows, k=10):
    fine = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in fine:
        if q % 10 == 0:
            found = {}
            for i, w in fine:
                if i != q and len(w) == len(v):
                    found[i] = min(found.get(i, np.inf), float(np.sqrt(((v - w) ** 2).sum())))
            out[q] = sorted((d, i) for i, d in found.items())[:k]
    return out


def compare(got, want, exact):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q, near in want.items():
        mine = sorted(by.pop(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        assert [(d, i) for _, i, d in mine] == sorted((d, i) for _, i, d in mine)
        if exact:
            assert [(i, d) for _, i, d in mine] == [(i, d) for d, i in near]
        hits += len({i for _, i, _ in mine} & {i for _, i in near})
        total += len(near)
    assert not by
    return hits / max(1, total)


def test_small_table_is_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(140, rows[3][1]), (140, rows[3][1])]
    rows += [(200, None), (210, [0.0] * 8), (220, [float("nan")] * 8), (230, [None] * 8), (240, [1.0, 2.0]), (241, [1.5, 2.0]), (250, [float("inf")] + [0.0] * 7), (None, rows[0][1]), (260, [])]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    got = A.search(frame, lambda i: i % 10 == 0).collect()
    assert compare(got, brute(rows), exact=True) == 1
    assert A.search(frame.limit(0), lambda i: i % 10 == 0).collect() == []


def test_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "LEAF_ROWS", 32)
    monkeypatch.setattr(A, "BLOCK_ROWS", 20)
    monkeypatch.setattr(A, "BLOCK_QUERIES", 50)
    monkeypatch.setattr(A, "SAMPLE_ROWS", 800)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 24))
    rows = [(i, [float(np.float32(x)) for x in (centers[i % 30] + rng.normal(size=24) * 0.3 if i % 3 else rng.normal(size=24))]) for i in range(2000)]
    got = A.search(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA), lambda i: i % 10 == 0, sample_rows=800).collect()
    assert compare(got, brute(rows), exact=False) >= 0.9


def test_shared_queue_visits_every_leaf_once():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6))
    forest = A.grow(x, trees=3, leaf_rows=20)
    order = list(forest.in_order(x[0]))
    assert sorted(order) == list(range(int(forest.leaf.max()) + 1))
    assert set(forest.leaves_of(x[:1])[0]) == set(order[:3])
