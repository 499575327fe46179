import random
import re

import numpy as np
import xxhash

from folio.llm import simhash

DOCS = "doc_id long, text string, fp string, key string"


def brute(rows):
    prints = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    seen = list(range(len(rows)))

    def root(i):
        while seen[i] != i:
            i = seen[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                seen[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    smallest = {}
    for members in groups.values():
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        smallest |= {m: min(ids, default=None) for m in members}
    return sorted(((rows[i][0], prints[i], smallest[i]) for i in range(len(rows))), key=str)


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["ÉCOLE", "Straße", "naïve"]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 60, 300]))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(n):
        copy = base[rng.randrange(n)].split()
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((n + i, "\t ".join(copy)))
    return rows


def test_matches_brute_force(spark):
    rows = texts(120, 1) + [(None, None), (900, ""), (901, " \n"), (902, "one"), (902, "one"), (None, "one")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(frame).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_hot_key_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    rng = random.Random(3)
    center = rng.getrandbits(64)
    found = {center}
    while len(found) < 150:
        found.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
    found |= {rng.getrandbits(64) for _ in range(50)}
    signed = [int(np.uint64(x).view(np.int64)) for x in found]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    parent = {x: x for x in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in found:
        for y in found:
            if (x ^ y).bit_count() <= 3:
                parent[root(x)] = root(y)
    want, got = {}, {}
    for x, s in zip(found, signed):
        want.setdefault(root(x), set()).add(x)
        got.setdefault(roots.get(s, s), set()).add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_very_long_text(spark):
    frame = spark.createDataFrame([(1, "a b c d " * 50_000), (2, "a b c d " * 50_001)], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(frame).collect()} == {1}
