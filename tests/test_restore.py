"""Restored states, recorded uses and embedding requests."""

import pytest

from folio.operators import embedding, restore

FOLDERS, ORDER = "book string, chapter_id string, path string", "book string, ord int, chapter_id string"


def test_orders_stale_and_missing_folders(spark):
    folders = [("a", "two", "p2"), ("a", "one", "p1"), ("b", "x", "px"), ("b", "old", "po"), ("c", "z", "pz"), ("c", "y", "py"), ("d", "q", "pq")]
    order = [("a", 1, "one"), ("a", 2, "gone"), ("a", 3, "two"), ("a", 4, "one"), ("b", 1, "x"), ("c", 1, ""), ("e", 1, "none")]
    titles = [("a", 1, "two"), ("c", 1, "y"), ("c", 2, "z")]
    made = restore.split_state(spark.createDataFrame(folders, FOLDERS), spark.createDataFrame(order, ORDER), spark.createDataFrame(titles, ORDER))
    assert [tuple(r) for r in made.chapters.orderBy("book", "place").collect()] == [("a", 1, "one", "p1"), ("a", 2, "two", "p2"), ("c", 1, "y", "py"), ("c", 2, "z", "pz")]
    assert {(r.book, r.chapter_id) for r in made.faults.collect()} == {("b", "old"), ("d", "")}


def test_uses_once_each_in_order(spark):
    uses = spark.createDataFrame([("b", "c1", 3, "Loop"), ("b", "c1", 1, "RECURSION"), ("b", "c1", 2, "loop"), ("b", "c1", 4, "unknown"), ("x", "c1", 1, "loop")], "book string, chapter_id string, ord int, name string")
    variants = spark.createDataFrame([("b", "loop", "Loop"), ("b", "recursion", "Recursion")], "book string, variant string, canonical string")
    assert [tuple(r) for r in restore.recorded_uses(uses, variants).orderBy("place").collect()] == [("b", "c1", 1, "Recursion"), ("b", "c1", 2, "Loop")]


def test_requests_hold_so_many_texts_and_tokens_add_up(spark):
    rows = spark.createDataFrame([(i, f"text number {i % 7}" if i % 5 else None) for i in range(150)], "row_id int, text string").coalesce(1)
    sizes = spark.sparkContext.accumulator(0)

    def model(texts):
        sizes.add(1)
        return [[float(len(t)), 0.0, 3.0] for t in texts], 10 * len(texts)

    got = {r.row_id: r for r in embedding.embedded(rows, "row_id", "text", model).collect()}
    assert sorted(got) == list(range(150)) and sizes.value == 3
    assert sum(r.tokens for r in got.values()) == 1500 and sorted({r.tokens for r in got.values()}) == [0, 220, 640]
    assert list(got[0].embedding) == [0.0, 0.0, 1.0] and got[1].embedding == got[8].embedding


def test_vectors_of_hashes_and_wrong_answers(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "row_id int, text string")
    got = {r.row_id: r.embedding for r in embedding.embedded(rows, "row_id", "text", embedding.hash_embedder(8)).collect()}
    assert got[1] == got[2] != got[3] and len(got[1]) == 8
    with pytest.raises(Exception, match="2 texts, 1 vectors|1 texts, 0 vectors|3 texts"):
        embedding.embedded(rows, "row_id", "text", lambda texts: ([[1.0]] * (len(texts) - 1), 0)).collect()
    assert embedding.embedded(rows.limit(0), "row_id", "text", embedding.hash_embedder()).collect() == []
