import random
import zlib
from collections import Counter, defaultdict

import pytest

from folio.llm import sharding

DOCS = "doc_id long, text string, shard string, key string"


def run(spark, rows, shards=24):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    made = sharding.shard(frame, shards).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in made) == want
    assert {(r.law, r.grown_shard) for r in made} <= {("bytes", None)}
    slots = defaultdict(list)
    for r in made:
        slots[r["shard"]].append(r.slot)
    assert set(slots) <= set(range(shards)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    held = Counter()
    for r in made:
        held[r["shard"]] += r["size"]
    return made, [held[s] for s in range(shards)]


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, "é" * rng.choice([0, 1, 50, 400, 2000]) + str(i)) for i in range(n)]


def spread(made):
    found = defaultdict(set)
    for r in made:
        found[r.text_crc32].add(r["shard"])
    return found


def test_sizes_are_near_equal_and_groups_stay(spark):
    rows = texts(2000, 1)
    rows += [(5000 + i, rows[i % 40][1]) for i in range(200)]
    made, held = run(spark, rows)
    assert max(held) - min(held) <= max(r["size"] for r in made)
    assert max(held) <= 1.01 * sum(held) / 24
    assert {len(s) for s in spread(made).values()} == {1}


def test_a_third_of_all_rows_is_one_text(spark):
    rows = texts(600, 2) + [(10_000 + i, "copy " * 150) for i in range(700)]
    made, held = run(spark, rows)
    assert max(held) <= 1.02 * sum(held) / 24
    wide = spread(made)
    hot = zlib.crc32(b"copy " * 150)
    assert len(wide[hot]) > 1 and {len(s) for c, s in wide.items() if c != hot} == {1}


@pytest.mark.parametrize("hot", [(7, "same row"), (None, None), (3, "")])
def test_a_third_of_all_rows_is_one_row(spark, hot):
    made, held = run(spark, texts(300, 3) + [hot] * 400, 6)
    assert max(held) <= 1.02 * sum(held) / 6


def test_sampled_splitters_and_their_subdivision(spark, monkeypatch):
    """A sample far smaller than the table: overfull ranges are drawn again and cut, none stays beyond its bound."""
    for name, value in (("RANGES", 4), ("DRAWN", 1)):
        monkeypatch.setattr(sharding, name, value)
    rows = texts(3000, 4) + [(9000 + i, "hot " * 30) for i in range(1500)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    keyed = sharding.keyed(frame)
    asked = []
    drawn = sharding._drawn
    monkeypatch.setattr(sharding, "_drawn", lambda *a: asked.append(drawn(*a)) or asked[-1])
    found = sharding.place(keyed, 8)
    assert len(asked) > 1 and len(asked[0]) < 200
    sizes = sharding._measured(keyed, found.starts)
    total, n = sum(b for b, _ in sizes.values()), sum(c for _, c in sizes.values())
    assert n == len(rows) and max((b / total + c / n) / 2 for b, c in sizes.values() if c > 1) <= sharding.OVERFULL / 32
    _, held = run(spark, rows, 8)
    assert max(held) <= 1.1 * sum(held) / 8


def test_one_very_long_text_and_few_rows(spark):
    made, held = run(spark, [(1, "long " * 400_000), *texts(100, 5)])
    assert sum(1 for r in made if r["shard"] == next(x["shard"] for x in made if x.doc_id == 1 and x["size"] > 10**6)) == 1
    assert sum(map(bool, run(spark, [(1, "a"), (2, "b"), (2, "b")])[1])) >= 2
    assert run(spark, []) == ([], [0] * 24)


def test_same_shards_from_another_order_of_rows(spark):
    rows = texts(400, 6)
    once, _ = run(spark, rows)
    again, _ = run(spark, rows[::-1])
    assert sorted(map(tuple, once), key=str) == sorted(map(tuple, again), key=str)


def test_written_shards_hold_whole_rows(spark, tmp_path):
    rows = [(*r, "x", "y") for r in texts(200, 7)]
    back = sharding.write_shards(spark.createDataFrame(rows, DOCS), str(tmp_path / "out"), 4)
    assert sorted((r.doc_id, r.text, r.key) for r in back.collect()) == sorted((i, t, k) for i, t, _, k in rows)
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
