import math

import numpy as np
import pytest

from folio.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, n long, key string"


def brute(rows, threshold=0.98):
    fine = [v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None for (_, v, _), ok in zip(rows, fine)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((vec_id, n[i], min(ids, default=None), vec_id == min(ids, default=None)))
    return sorted(out, key=str)


def data():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(i, rng.normal(size=16), int(rng.integers(3))) for i in range(150)]
    rows += [(1000 + i, base[i % 40] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12, 0.2]), i % 2) for i in range(250)]
    hot = rng.normal(size=16)
    rows += [(3000 + i, hot + rng.normal(size=16) * 0.15, 1) for i in range(120)] + [(4000 + i, hot, 1) for i in range(30)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [1.0, None], 1), (5003, [float("nan")] * 16, 1), (5004, [float("inf")] * 16, 1), (5005, rows[0][1], None), (5006, [1.0, 2.0], 1), (5007, [], 1), (None, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2])]
    return rows


@pytest.mark.parametrize("cell_rows, tile_rows", [(16384, 4096), (40, 16)])
def test_matches_brute_force(spark, monkeypatch, cell_rows, tile_rows):
    monkeypatch.setattr(E, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(E, "TILE_ROWS", tile_rows)
    rows = data()
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in E.near_duplicates(frame).collect()), key=str)
    assert got == brute(rows)


def test_bound_is_rigorous():
    rng = np.random.default_rng(1)
    x = E.units(rng.normal(size=(200, 33)))
    y = E.units(np.concatenate([x[:100] + rng.normal(size=(100, 33)) * 0.05, rng.normal(size=(100, 33))]))
    for threshold in (0.1, 0.9, 0.98):
        i, j = E.near_pairs(x, y, threshold)
        assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(x @ y.T >= threshold)))


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
