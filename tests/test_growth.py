"""Queries whose work has to grow no faster than their input: results on larger rows, and bounds on time or on the plan."""

import time

import numpy as np
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.functions import maths
from folio.functions import text as T
from folio.operators import assembly, concepts, gram_index, mdx
from folio.plans import registry

SF = "/root/testdata/sf0.001"


def plan(made):
    return made._jdf.queryExecution().executedPlan().toString()


def test_narrations_in_long_sentences(spark):
    """The text before a narration is read once, not from each of its places."""
    text = F.concat(F.repeat(F.lit("长"), 300_000), F.lit("根据原文甲。后"))
    began = time.time()
    found = spark.range(4).select(T.narrations(text).alias("found")).collect()
    assert all(r.found == ["长" * 300_000 + "根据原文甲。"] for r in found) and time.time() - began < 60


def test_narrations_keep_long_asides_apart(spark):
    told = lambda n: f"（{'长' * n}源文中有）尾。"
    got = [r.f for r in spark.createDataFrame([(told(n),) for n in (594, 595, 596)], "t string").select(T.narrations(F.col("t")).alias("f")).collect()]
    assert got == [[told(594)[:-2]], [told(595)[:-2]], ["长" * 596 + "源文中有）尾。"]]


def test_fuzzy_places_of_many_rows(spark):
    rows = spark.range(0, 20_000, 1, 4).select("id", F.concat(F.lit("in: "), F.lit("word "), F.col("id").cast("string"), F.lit(" stands "), F.repeat(F.lit("and so on "), 50)).alias("t"))
    began = time.time()
    at = T.anchored(F.col("t"), F.concat(F.lit("wxrd "), F.col("id").cast("string"), F.lit(" stands")), F.lit(4))
    got = rows.select("id", at.alias("at")).agg(F.count_if(F.col("at.start") == 4).alias("n"), F.count_if(F.col("at.end") == 16 + F.length(F.col("id").cast("string"))).alias("ends")).first()
    assert (got.n, got.ends) == (20_000, 20_000) and time.time() - began < 60


def test_registry_folds_many_books_in_one_pass(spark):
    """No call for each book; the state of one doesn't reach the next, in whatever order their edits come."""
    schema = "book string, chapter string, chapter_ord int, op_ord int, op string, name string, other string, aliases array<string>, into array<struct<canonical: string, aliases: array<string>>>"
    rows = [(f"b{i}", f"c{k}", k, 0, "add_concept", name, None, [name.upper() + str(k)], []) for k, name in ((1, "alpha"), (0, "beta")) for i in range(300)]
    made = concepts.fold_registry(spark.createDataFrame([*rows, ("b7", "c2", 2, 0, "merge", "alpha", "beta", [], [])], schema))
    assert "FlatMapGroups" not in plan(made) and "MapInPandas" in plan(made)
    got = {}
    for r in made.orderBy("book", "ord").collect():
        got.setdefault(r.book, []).append((r.canonical, r.aliases, r.first_chapter))
    assert got.pop("b7") == [("alpha", ["ALPHA1", "beta", "BETA0"], "c0")]
    assert len(got) == 299 and all(v == [("beta", ["BETA0"], "c0"), ("alpha", ["ALPHA1"], "c1")] for v in got.values())


def test_pages_are_never_broadcast(spark):
    """Pages of a small file are large: sections go through no driver, whatever Spark thinks of the file."""
    for name in ("CH26_items", "CH26_sanitised_bodies", "CH26_slots", "XD03_resolved_slots"):
        assert "Broadcast" not in plan(registry.queries()[name](spark, SF)), name
    pages = spark.range(5).select("id", F.lit("a <A> b").alias("body"))
    assert "Broadcast" not in plan(mdx.faults(mdx.tokens(pages, "id", "body"), "id"))


def test_numbers_of_postings_are_packed():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 2**63, 2**64 - 1], np.uint64)
    data, sizes = gram_index._shrunk(values)
    assert sizes.tolist() == [1, 1, 1, 2, 2, 3, 6, 10, 10] and gram_index._grown(data).tolist() == values.tolist()


def test_tasks_of_an_index_grow_with_its_texts(spark, tmp_path, monkeypatch):
    """More signs, more tasks; ids of any size and sign come back."""
    rows = [(i, "banana bandana " * 5) for i in (-(2**63), -5, 0, 7, 2**62, 2**63 - 1)] + [(i, "bananas") for i in range(40, 60)]
    monkeypatch.setattr(gram_index, "TASK_SIGNS", 50)
    monkeypatch.setattr(gram_index, "BLOCK_SIGNS", 100)
    index = gram_index.build(spark.createDataFrame(rows, "row_id long, text string"), f"file://{tmp_path}/index", parts=2)
    assert len(index.postings.inputFiles()) > 4
    assert {r.row_id: r.tf for r in gram_index.occurrences(index, "bana").collect()} == {i: t.count("bana") for i, t in rows}


def test_slugs_of_large_families_go_through_no_row(spark):
    """Pins of a book aren't handed to each of its chapters, and a family is numbered as one chapter after the other would be."""
    n = 3000
    chapters = spark.range(n).select(F.lit("b").alias("book"), F.col("id").alias("place"), F.col("id").cast("string").alias("print"), F.concat(F.lit("pin-"), F.when(F.col("id") % 3 == 1, F.col("id") - 1).otherwise(F.col("id"))).alias("slug"))
    pins = chapters.where("place % 3 = 0").select("book", "print", F.col("slug").alias("pin"))
    made = assembly.pinned_slugs(chapters, pins, "book", "place")
    assert "collect_set" not in plan(made) and "FlatMapGroups" not in plan(made)
    assert {r.place: r.slug for r in made.collect()} == {i: f"pin-{i - 1}-2" if i % 3 == 1 else f"pin-{i}" for i in range(n)}


def test_long_props_are_read_in_pieces(spark):
    """Not sign by sign; quotes, escapes and braces count as before, and a quote that nothing ends has no end."""
    long = "word, " * 50_000
    cases = [(f'a={{["{long}"]}} b="1"', f'["{long}"]'), ('a={{"k": "}\\"}"}} c', '{"k": "}\\"}"}'), ("a={'}' + {x: {}}}", "'}' + {x: {}}"), ('a={"open}', None), ("a={}", ""), ("b={1}", None), ("a={ {1 }", None), ('a={"\\\\"} z="}"', '"\\\\"')]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases * 20)], "i int, t string")
    began = time.time()
    got = {r.i: r.v for r in rows.select("i", M.braced(F.col("t"), "a").alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [v for _, v in cases] and time.time() - began < 10


def test_a_quote_is_read_once(spark):
    """Each step names the text that the one before made; written out, the quote stood in the plan once for each reading of each."""
    rows = spark.createDataFrame([("Sum of a: x_{1} + 1",)], "t string").coalesce(1)
    for made in (maths.quote_formulas(F.col("t")), maths.normalised("t"), maths.own_lines(F.col("t"))):
        assert plan(rows.select(made.alias("q"))).count("t#") <= 6
    assert rows.select(maths.quote_formulas(F.col("t")).alias("q")).first().q == "Sum of a: $x_{1} + 1$"


def test_tags_of_a_page_are_shuffled_once(spark, tmp_path):
    """Pairs, blocks and children of all kinds come from one shuffle of a page's tags."""
    bodies = ["<QuizBlock></QuizBlock> x <QuizItemSlot />", "<QuizBlock><A/><QuizItem>t</QuizItem></QuizBlock><QuizBlock>y</QuizBlock>", "none"]
    found = mdx.tokens(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"), "id", "body")
    found.write.parquet(f"{tmp_path}/found")
    made = mdx.quiz_children(spark.read.parquet(f"{tmp_path}/found"), "id")
    assert plan(made).count("Exchange") == 1
    got = sorted((r.id, r.kind, r.name, r.start, r.end, r.block_start, r.block_end) for r in made.collect())
    assert got == [(0, "empty", "QuizBlock", 0, 23, 0, 23), (0, "stray", "QuizItemSlot", 26, 42, None, None), (1, "empty", "QuizBlock", 49, 73, 49, 73), (1, "item", "QuizItem", 15, 37, 0, 49), (1, "unknown", "A", 11, 15, 0, 49)]


def test_taken_slugs_meet_their_places_without_broadcast(spark):
    """Also where taken slugs and places come from joins by the same columns and are few and many: both are one task's."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 60_000, 1, 4).select((F.col("id") % 60).cast("string").alias("book"), F.floor(F.col("id") / 60).alias("place"), F.lit("a rather long print of a chapter ").alias("print"), F.concat(F.lit("pin-"), F.floor(F.col("id") / 60) % 10).alias("slug"))
        chapters = rows.withColumn("print", F.concat("print", "place"))
        pins = chapters.where("place < 20 AND place % 2 = 0").select("book", "print", F.concat(F.lit("pin-"), "place").alias("pin"))
        got = assembly.pinned_slugs(chapters, pins, "book", "place").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == 60_000 and len({(r.book, r.slug) for r in got}) == 60_000
