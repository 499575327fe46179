import random
import re
from collections import Counter

from folio.llm import source_divergence

DOCS = "doc_id long, text string, lang string, source string, part string, term string"


def brute(rows):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        of = Counter(t for x, _, terms in docs if x == lang for t in set(terms))
        kept = sorted(t for t in of if of[t] >= 3)
        counts = {}
        for x, source, terms in docs:
            if x == lang:
                counts.setdefault(source, Counter()).update(t for t in terms if of[t] >= 3)

        def shares(c):
            n = sum(c.values())
            return [1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept]

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in p:
            found = [(-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o.encode(), o) for o in p if o != s]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(found), 1)}
            found = [(-((a - b) ** 2 // b), t.encode(), t) for t, a, b in zip(kept, p[s], q) if counts[s][t] and a > b]
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(found)[:200], 1)}
    return out


def got(spark, rows):
    made = [tuple(r) for r in source_divergence.audit(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)).collect()]
    assert len(made) == len(set(made))
    return set(made)


def texts(n, seed, sources=7):
    rng = random.Random(seed)
    words = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)] + ["École", "straße", "中文词", "𝒜b", "it's", "x1y"]
    made = []
    for i in range(n):
        s = rng.randrange(sources)
        own = words[s * 20 :: 1 + s % 3]
        made.append((i, rng.choice([" ", "_", "\n", "\x00"]).join(rng.choices(own, k=rng.choice([0, 2, 30, 200]))), rng.choice(["en", "en", "de"]), f"s{s}"))
    return made


def test_matches_brute_force(spark):
    rows = texts(150, 1) + [(None, None, None, None), (3, "alone in here", "fr", "s1"), (3, "", "fr", "É"), (4, "one two", "en", "quiet"), (4, "one two", "en", "quiet"), (5, None, "en", "empty"), (6, "x", "it", "only")]
    assert got(spark, rows) == brute(rows)


def test_several_blocks_chunks_and_stripes(spark, monkeypatch):
    for name, value in (("CHUNK_TERMS", 16), ("STRIPE_CHUNKS", 2), ("BLOCK_GROUPS", 3), ("HELD_TERMS", 50)):
        monkeypatch.setattr(source_divergence, name, value)
    rows = texts(120, 2, 11)
    assert got(spark, rows) == brute(rows)


def test_no_term_kept_and_empty_table(spark):
    rows = [(1, "a b", "en", "s1"), (2, "a c", "en", "s2"), (3, None, "en", "s3")]
    made = got(spark, rows)
    assert made == brute(rows) and {r[4] for r in made} == {0} and len(made) == 6
    assert got(spark, []) == set()


def test_counts_beyond_64_bits(spark):
    """Products of counts that don't fit in 64 bits, in tasks and in Spark."""
    many = 10**13
    entries = spark.createDataFrame([("en", "a", "x", many, many + 5, 0, 0), ("en", "b", "x", 5, many + 5, 0, 0), ("en", "b", "y", 7, 7, 0, 1)], "lang string, source string, term string, n long, total long, chunk int, idx int")
    groups = spark.createDataFrame([("en", "a", many, 2, 1), ("en", "b", 12, 2, 1)], "lang string, source string, n long, terms long, chunks int")
    stripes = spark.createDataFrame([("en", 0, 2)], "lang string, stripe int, stripe_terms long")
    p = {"a": [1 + 10**9 * (many + 1) // (many + 2), 1 + 10**9 // (many + 2)], "b": [1 + 10**9 * 6 // 14, 1 + 10**9 * 8 // 14]}
    want = {(s, o): sum((x - y) ** 2 // y for x, y in zip(p[s], p[o])) for s, o in (("a", "b"), ("b", "a"))}
    assert {(r.source, r["item"]): r.value for r in source_divergence.pairs(entries, groups, stripes).collect()} == want
    langs = spark.createDataFrame([("en", many + 12, 2)], "lang string, lang_n long, terms long")
    found = {(r.source, r["item"]): r.value for r in source_divergence.characteristic(entries, groups, langs).collect()}
    q = [1 + 10**9 * (many + 6) // (many + 14), 1 + 10**9 * 8 // (many + 14)]
    assert found == {(s, t): (p[s][i] - q[i]) ** 2 // q[i] for s in "ab" for i, t in enumerate("xy") if p[s][i] > q[i] and (s, t) != ("a", "y")}


def test_very_long_text(spark):
    rows = [(i, "Long tale " * 100_000 if i == 1 else "long tale once more", "en", f"s{i % 2}") for i in range(6)]
    assert got(spark, rows) == brute(rows)


def test_terms_are_limited_before_the_shuffle(spark):
    entries = spark.createDataFrame([("en", "a", "x", 1, 1, 0, 0)], "lang string, source string, term string, n long, total long, chunk int, idx int")
    groups = spark.createDataFrame([("en", "a", 1, 1, 1)], "lang string, source string, n long, terms long, chunks int")
    langs = spark.createDataFrame([("en", 1, 1)], "lang string, lang_n long, terms long")
    plan = source_divergence.characteristic(entries, groups, langs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
