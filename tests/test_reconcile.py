"""The merge of candidates against the direct fold over a book."""

import random

import pytest

from folio.operators import graphs, reconcile


def key(name):
    return "".join(c for c in name.casefold() if c.isalnum())


def direct(candidates, entries=(), variants=()):
    """Peer: the whole book in one loop."""
    concepts, known = {}, {}
    for _, canonical, aliases, chapter in sorted((o, c.strip(), a, h) for o, c, a, h in entries):
        aliases = [a for a in aliases if a.strip()]
        k = key(canonical)
        concepts[k] = [canonical, list(aliases), [chapter] if chapter else []]
        known[k] = k
        for a in aliases:
            known[key(a)] = k
    for variant, canonical in variants:
        if key(canonical) in concepts:
            known[key(variant)] = key(canonical)
    for _, name, aliases, chapter in sorted(candidates):
        names = [name.strip(), *(a for a in aliases if a.strip())]
        if not names[0]:
            continue
        at = next((known[key(n)] for n in names if key(n) in known), None) or key(names[0])
        own = concepts.setdefault(at, [names[0], [], []])
        if chapter not in own[2]:
            own[2].append(chapter)
        for n in names:
            known[key(n)] = at
            if n != own[0] and n not in own[1]:
                own[1].append(n)
    variants_of = dict(variants)
    for canonical, aliases, _ in concepts.values():
        for n in (canonical, *aliases):
            variants_of[n] = variants_of[key(n)] = canonical
    return [(k, *c) for k, c in concepts.items()], variants_of


def run(spark, books):
    cands, entries, variants = [], [], []
    for book, (c, e, v) in books.items():
        cands += [(book, *x) for x in c]
        entries += [(book, *x) for x in e]
        variants += [(book, *x) for x in v]
    said = spark.createDataFrame(variants, "book string, variant string, canonical string")
    made = reconcile.reconciled(
        spark.createDataFrame(cands, "book string, ord long, name string, aliases array<string>, chapter string"),
        spark.createDataFrame(entries, "book string, ord long, canonical string, aliases array<string>, first_chapter string"),
        said,
    ).cache()
    concepts = {}
    for r in reconcile.concept_order(made).orderBy("book", "place").collect():
        concepts.setdefault(r.book, []).append((r.key, r.canonical, list(r.aliases), list(r.chapters)))
    maps = {}
    for r in reconcile.alias_map(made, said).collect():
        maps.setdefault(r.book, {})[r.variant] = r.canonical
    return concepts, maps


def random_book(rng, names, n):
    pick = lambda: rng.choice(names) + rng.choice(["", "", " ", "-X"])
    cands = [(i, pick(), [pick() for _ in range(rng.choice([0, 0, 1, 3]))], f"ch{rng.randrange(4)}") for i in range(n)]
    entries = [(i, pick(), [pick() for _ in range(rng.randrange(3))], rng.choice(["", "ch9"])) for i in range(rng.choice([0, 3]))]
    variants = list({(f"{pick()}v{i}", pick()) for i in range(rng.choice([0, 4]))})
    return cands, entries, variants


def test_random_books_against_the_direct_fold(spark):
    rng = random.Random(3)
    books = {f"b{i}": random_book(rng, [f"Name {chr(97 + j)}" for j in range(rng.choice([4, 12, 40]))], rng.choice([1, 6, 30])) for i in range(25)}
    concepts, maps = run(spark, books)
    for book, given in books.items():
        want, variants = direct(*given)
        assert concepts[book] == want, book
        assert maps[book] == variants, book


def test_one_name_in_most_rows_is_grouped_not_folded(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "_folded", lambda rows: 1 / 0)
    cands = [(i, "Recursion" if i % 2 else "recursion", [f"alias {i % 3}"], f"ch{i % 5}") for i in range(2000)]
    concepts, maps = run(spark, {"b": (cands, [(0, "RECURSION", ["rec"], "ch7")], [("loop", "recursion")])})
    assert concepts["b"] == direct(cands, [(0, "RECURSION", ["rec"], "ch7")], [("loop", "recursion")])[0]
    assert maps["b"]["loop"] == "recursion" and maps["b"]["alias1"] == "RECURSION"


def test_names_that_compete_are_decided_in_order(spark):
    cands = [(1, "a", ["b"], "c1"), (2, "c", ["d"], "c1"), (3, "x", ["d", "b"], "c2"), (4, "b", [], "c3"), (5, " ", ["a"], "c4"), (6, "…", [], "c4")]
    concepts, _ = run(spark, {"1": (cands, [], [])})
    assert concepts["1"] == direct(cands)[0] and [c[1] for c in concepts["1"]] == ["a", "c", "…"]


def test_a_candidate_without_chapter_is_an_error(spark):
    with pytest.raises(Exception, match="candidate without a chapter: a"):
        run(spark, {"1": ([(1, "a", [], " ")], [], [])})


def test_components_of_a_path_and_a_star(spark):
    edges = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(200)] + [("z", f"s{i}") for i in range(50)] + [("q", "q")]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"p{i:03d}"] for i in range(201)} == {"p000"} and got["z"] == "s0" and got["s49"] == "s0" and got["q"] == "q"
