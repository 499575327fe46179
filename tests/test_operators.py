"""Operators whose results SQL can't give, against small examples and plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folio.operators import chunking, concepts, quality, relational, split
from folio.sources import vault
from folio.streaming import pickup


def plain_pack(text, most):
    if len(text) <= most:
        return [text.strip()] if text.strip() else []
    done, now = [], ""
    for p in re.split(r"\n\s*\n", text):
        if now and len(f"{now}\n\n{p}".strip()) <= most:
            now = f"{now}\n\n{p}".strip()
        elif not now and len(p) <= most:
            now = p
        else:
            done += [now] if now else []
            now = p if len(p) <= most else ""
            done += [] if now or len(p) <= most else [p[i : i + most] for i in range(0, len(p), most)]
    return [x.strip() for x in [*done, now] if x.strip()]


def test_packed_against_a_loop(spark):
    rng = random.Random(3)
    texts = ["", "a", "x" * 95] + ["\n\n".join("w" * rng.randint(0, 60) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.packed(F.col("t"), 40).alias("p")).collect()
    for r in rows:
        assert r.p == plain_pack(texts[r.i], 40)


PAGE = "intro\n# One\nalpha\n\n## Two\n<!-- source_ref: b-p2 -->\nbeta\n\n### Referenced By\n- x\n# Three\n" + "long words here. " * 10


def test_rag_chunks(spark):
    pages = spark.createDataFrame([("p1", "T", "ch", "sum", PAGE, ["a-p1"]), ("p2", "U", "ch", None, None, [])], "id string, title string, chapter_id string, summary string, body string, source_refs array<string>")
    rows = [r for r in chunking.rag_chunks(pages, 100).orderBy("chunk_id").collect() if r.page_id == "p1"]
    assert [r.heading_path for r in rows] == ["T > Summary", None, "One", "One > Two", "Three", "Three"]
    assert [r.section_id for r in rows] == ["summary", "intro", "one", "two", "three-05", "three-06"]
    assert rows[0].source_refs == ["a-p1"] and rows[3].source_refs == ["b-p2"]
    assert [r.chunk_index for r in rows] == list(range(6)) and rows[0].chunk_id == "p1#chunk-001"
    empty = chunking.rag_chunks(pages.where("id = 'p2'")).collect()
    assert [(r.chunk_id, r.heading_path, r.text) for r in empty] == [("p2#chunk-001", "U", "")]


def test_budgeted_chunks_cover_the_text(spark):
    text = "# A\n" + "one two three\n" * 30 + "## B\n```\n# not a heading\n```\n" + "four\n" * 40 + "## C\nshort\n# D\n" + "y" * 700
    rows = sorted(chunking.budgeted(spark.createDataFrame([(1, text), (2, None), (3, "tiny")], "i int, t string"), "i", "t", budget=60).collect(), key=lambda r: (r.i, r.char_start))
    own = [r for r in rows if r.i == 1]
    assert all(text[r.char_start : r.char_end] == r.text and len(r.text) // 3 <= 60 for r in own)
    assert set().union(*(range(r.char_start, r.char_end) for r in own)) == set(range(len(text)))
    assert {tuple(r.heading_path) for r in own} == {("A",), ("A", "B"), ("A", "C"), ("A", "D")}
    assert [r.text for r in rows if r.i == 3] == ["tiny"] and not [r for r in rows if r.i == 2]


def test_fragments_and_boundaries(spark):
    docs = spark.createDataFrame([("a", "lost <!-- source_ref: a-p1 --> x <!-- source_ref: a-p2 -->  <!-- source_ref: a-p3 -->tail\nChapter 2\nmore"), ("b", " plain "), ("c", None)], "path string, text string")
    parts = split.fragments(docs, "path", "text")
    assert sorted((r.source_ref, r.body) for r in parts.collect()) == [("a-p1", "x"), ("a-p3", "tail\nChapter 2\nmore"), ("b-text", "plain")]
    chapters = [split.Chapter("c1", "First", (), ("a-p1..a-p9",)), split.Chapter("c2", "Second plain")]
    found = split.carry(split.assign(parts, chapters), chapters)
    assert sorted((r.source_ref, r.chapter_id, r.reason) for r in found.collect()) == [("a-p1", "c1", "source_ref"), ("a-p3", "c1", "source_ref"), ("a-p3", "c2", "boundary"), ("b-text", "c2", "keyword")]
    rows = sorted(split.chapter_texts(found, chapters).collect(), key=lambda r: (r.chapter_id, r.path, r.pos))
    assert [r.block for r in rows if r.chapter_id == "c1"] == ["# First", "<!-- source_ref: a-p1 -->\n\nx", "<!-- source_ref: a-p3 -->\n\ntail\nChapter 2\nmore"]
    assert [r.block for r in rows if r.chapter_id == "c2"][0] == "# Second plain" and [r.block for r in rows if r.chapter_id == "appendix"] == ["# Appendix"]


EDITS = "book string, chapter string, chapter_ord int, op_ord int, op string, name string, other string, aliases array<string>, into array<struct<canonical: string, aliases: array<string>>>"


@pytest.mark.parametrize(
    "edits, want",
    [
        ([("c1", "add_concept", "Limit", None, ["lim"], []), ("c2", "add_concept", "LIM", None, ["limes"], [])], [("Limit", ["lim", "limes"], "c1")]),
        ([("c1", "add_concept", "A", None, [], []), ("c1", "rename_canonical", "a", "B", [], [])], [("B", ["A"], "c1")]),
        ([("c1", "add_concept", "A", None, [], []), ("c2", "add_concept", "B", None, ["b2"], []), ("c2", "merge", "B", "A", [], [])], [("B", ["b2", "A"], "c1")]),
        ([("c1", "add_concept", "A", None, ["x"], []), ("c2", "split", "A", None, [], [("X", []), ("Y", ["yy"])])], [("X", [], "c1"), ("Y", ["yy"], "c1")]),
        ([("c1", "merge", "no", "none", [], []), ("c1", "add_alias", "no", "z", [], []), ("c1", "add_concept", "!!", None, [], [])], []),
    ],
)
def test_registry(spark, edits, want):
    rows = [("b", e[0], int(e[0][1:]), i, e[1], e[2], e[3], e[4], e[5]) for i, e in enumerate(edits)]
    found = concepts.fold_registry(spark.createDataFrame(rows, EDITS)).orderBy("ord").collect()
    assert [(r.canonical, list(r.aliases), r.first_chapter) for r in found] == want


def test_exam_pools(spark):
    questions = spark.createDataFrame([(1, ["Limit", "series"]), (2, ["other"]), (3, ["series"])], "q int, names array<string>")
    chapters = spark.createDataFrame([("c1", 0, ["limit "]), ("c2", 1, ["Series", "Limit"]), ("c3", 2, ["series"])], "chapter_id string, ord int, concepts array<string>")
    assert sorted(map(tuple, concepts.exam_pools(questions, "q", F.col("names"), chapters).collect())) == [(1, "c2"), (2, "_unmapped"), (3, "c2")]


def test_drop_unverified(spark):
    items = spark.createDataFrame([(1, "o", "single_choice", ["a", "b"], ["a"], [("r1", "q"), ("r9", "q"), ("r1", " ")]), (2, "o", "single_choice", ["a"], ["a", "a2"], None), (3, "?", "multiple_choice", ["a"], ["a"], [("r1", "q")])], "item_id int, owner string, kind string, options array<string>, answer array<string>, citations array<struct<ref_id: string, quote: string>>")
    kept, audit = quality.drop_unverified(items, spark.createDataFrame([("o", ["r1"])], "owner string, refs array<string>"))
    assert sorted((r.item_id, [tuple(c) for c in r.citations]) for r in kept.collect()) == [(1, [("r1", "q")]), (3, [])]
    assert sorted(map(tuple, audit.collect())) == [("?", 3, "ungrounded_citation", 1), ("o", 1, "ungrounded_citation", 2), ("o", 2, "invalid_answer", 1)]


def test_vault_and_tables(spark, tmp_path):
    (tmp_path / "chapters").mkdir()
    (tmp_path / "chapters" / "limits.mdx").write_text('---\ntitle: "Limits"\norder_index: 2\n---\n# Heading\n<SourceRef id="s-p1" />\n')
    (tmp_path / "chapters" / "open.mdx").write_text("---\ntitle: x\n# No end\n")
    rows = {r.slug: r for r in vault.read_vault(spark, str(tmp_path)).collect()}
    assert (rows["chapters/limits"].title, rows["chapters/limits"].order_index, rows["chapters/limits"].source_refs) == ("Limits", 2, ["s-p1"])
    assert (rows["chapters/open"].title, rows["chapters/open"].type) == ("No end", "chapter")
    for n in (1, 2):
        vault.replace_table(spark.range(n), str(tmp_path / "t"), "x")
        assert vault.read_table(spark, str(tmp_path / "t"), "x").count() == n


def test_pick_up_passes_changes_only(spark, tmp_path):
    got, root = [], tmp_path / "in"
    root.mkdir()

    def go():
        stream = pickup.pick_up(spark, str(root), str(tmp_path / "prints"), str(tmp_path / "check"), lambda rows: got.append(sorted(r.path.rpartition("/")[2] for r in rows.collect())))
        stream.awaitTermination(120)

    (root / "a.txt").write_text("a")
    go()
    (root / "b.txt").write_text("b")
    go()
    assert got == [["a.txt"], ["b.txt"]]


def test_islands_and_coverage_of_nothing(spark):
    rows = spark.createDataFrame([(1, 0, 2), (1, 3, 4), (1, 9, 9)], "g int, a int, b int")
    assert sorted(tuple(r) for r in relational.islands(rows, "g", F.col("a"), F.col("b")).collect()) == [(1, 0, 4, 2), (1, 9, 9, 1)]
    assert relational.coverage(rows.where("g > 1"), ["a"], F.lit(True)).first().ratio == 1.0


def test_item_without_slot_is_an_error(spark):
    slots = spark.createDataFrame([(1,), (2,)], "slot int")
    good = spark.createDataFrame([(1, "a")], "slot int, item string")
    assert [tuple(r) for r in relational.filled_slots(good, slots, "slot").collect()] == [(1, "a")]
    with pytest.raises(Exception, match="no slot"):
        relational.filled_slots(spark.createDataFrame([(3, "a")], "slot int, item string"), slots, "slot").collect()
