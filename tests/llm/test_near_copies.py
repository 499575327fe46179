import random

import corpus_pipeline as C
from folio.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(rng, text, least, most):
    """A copy of ``text`` with single words changed until its similarity lies in the range."""
    while True:
        words = text.split()
        while jaccard(shingles(text), shingles(" ".join(words))) > most:
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**9)}"
        if jaccard(shingles(text), shingles(" ".join(words))) >= least:
            return " ".join(words)


def kept(rows):
    """The smallest id of each group, by comparing every pair."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    common = text(40)  # a passage of a third of all documents
    bases = [text(rng.choice([3, 5, 6, 9, 60, 150, 400])) + (" " + common if i % 3 == 0 else "") for i in range(45)]
    long = [b for b in bases if len(b.split()) >= 60]
    near = [edited(rng, rng.choice(long), low, high) for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95)) for _ in range(15)]
    far = [edited(rng, rng.choice(long), 0.7, 0.79) for _ in range(15)]
    hub = [edited(rng, long[0], 0.8, 0.95) for _ in range(20)]  # copies of one, less alike among themselves
    return list(enumerate(bases + near + far + hub + [None, "", " \n", bases[0]]))


def test_copies_of_08_and_more_go_and_others_stay(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
        got = sorted(r.doc_id for r in C.dedup_documents(spark, docs, "").collect())
        assert got == kept(rows)


def test_small_tiles_and_a_poor_sketch(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "TILE_ROWS", 4)
    monkeypatch.setattr(near_copies, "SKETCH_BITS", 3)
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == kept(rows)


def test_groups_of_another_operator_count_as_well(spark):
    """2 goes with 1 by shingles, 3 with 2 and the last with 5 by the other grouping; 4 is alone."""
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, "other words here and there are few"), (4, "alone"), (5, "fifth"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same = {3: 2, None: 5}
    texts = {i: t for i, t in rows}

    def also(texts_):
        key = {r.text: r.doc_id for r in texts_.collect()}
        return spark.createDataFrame([(key[t], key[texts[same.get(i, i)]]) for i, t in rows], "doc_id long, component_id long")

    assert sorted((r.doc_id for r in near_copies.keep_one(docs, also=also).collect()), key=str) == [1, 4, 5]


def test_rows_without_id_and_rows_of_one_id_are_told_apart_by_their_texts(spark):
    """Different texts all stay, whatever their ids; copies leave the row of the smallest id; repeated rows leave one."""
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, "first text without an id", 1), (None, "second one", 2), (None, "third", 3), (5, "one thing", 4), (5, "another matter", 5), (7, long, 6), (None, long + " x", 7), (7, long, 6), (9, long + " y", 8), (None, None, 9), (None, "", 9), (None, "third", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, folio_n int")
    got = sorted(((r.doc_id, r.text or "", r.folio_n) for r in near_copies.keep_one(docs.withColumnRenamed("folio_n", "more")).withColumnRenamed("more", "folio_n").collect()), key=str)
    assert got == sorted([(None, "first text without an id", 1), (None, "second one", 2), (None, "third", 3), (5, "one thing", 4), (5, "another matter", 5), (7, long, 6), (None, "", 9)], key=str)


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(i, f"text {i} of its own with words a{i} b{i} c{i} d{i} e{i}") for i in range(200)] + [(None if i % 2 else 1000 + i, "hot " * 30) for i in range(100)]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [*range(200), 1000]
