"""Layout repair: neighbours over page bounds, the cap, patches in order."""

from folio.operators import layout

BLOCKS = "source string, page_idx int, block_index int, block_id string, page_ref string, type string, text string"
PATCHES = "source string, ord int, action string, source_block_id string, target_block_id string, confidence double, reason string"


def blocks(spark, pages):
    rows = [("s", p, i, f"s-p{p}-b{i}", f"s-p{p}", kind, text) for p, page in enumerate(pages) for i, (kind, text) in enumerate(page)]
    return spark.createDataFrame(rows, BLOCKS)


def test_tables_go_on_over_noise_but_not_over_pages(spark):
    pages = [[("table", "a"), ("footer", "f")], [("header", "h"), ("chart", "b"), ("table", " ")], [("text", "x"), ("table", "c")], [("page_number", "4")], [("table", "d")], [("table", "e")], [("table", None)]]
    got = layout.continued_tables(blocks(spark, pages)).orderBy("n").collect()
    assert [r.candidate_id for r in got] == ["s-p0-b0-to-s-p1-b1", "s-p4-b0-to-s-p5-b0"] and {r.confidence for r in got} == {0.65}


def test_the_first_twenty(spark):
    assert layout.continued_tables(blocks(spark, [[("table", "t")]] * 40)).count() == 20


def test_patches_in_order_and_warnings(spark):
    given = blocks(spark, [[("table", "a"), ("text", "c")], [("table", "b")]])
    patches = [
        ("s", 1, "promote_heading", "s-p0-b1", None, 0.9, ""), ("s", 2, "demote_repeating_header_footer", "s-p0-b1", None, 0.9, ""), ("s", 3, "link_table_parts", "s-p0-b0", "s-p9-b0", 0.9, ""), ("s", 4, "link_table_parts", "s-p0-b0", "s-p1-b0", 0.9, "same"),
        ("s", 5, "attach_caption", "s-p0-b1", "s-p0-b0", 0.9, ""), ("s", 6, None, "s-p0-b1", None, 0.9, ""), ("t", 7, "promote_heading", "s-p0-b0", None, 0.9, ""),
    ]
    made = layout.patched(given, spark.createDataFrame(patches, PATCHES))
    assert {r.block_id: (r.type, r.attached_to) for r in made.blocks.collect()} == {"s-p0-b0": ("table", None), "s-p0-b1": ("header", "s-p0-b0"), "s-p1-b0": ("table", None)}
    assert [tuple(r)[1:] for r in made.tables.orderBy("role", ascending=False).collect()] == [("s-table-001", "s-p0", 0.9, "same", "s-p0-b0", "s-p0", "start"), ("s-table-001", "s-p0", 0.9, "same", "s-p1-b0", "s-p1", "continuation")]
    assert [(r.ord, r.warning) for r in made.warnings.orderBy("ord").collect()] == [(3, "unknown block id 's-p9-b0' for action link_table_parts"), (6, "unsupported repair action ''"), (7, "unknown block id 's-p0-b0' for action promote_heading")]
    lines = [r.line for r in layout.marked(given, made.tables).orderBy("page_idx").collect()]
    assert lines == ["<!-- logical_table: s-table-001 part: start block: s-p0-b0 -->", "<!-- logical_table: s-table-001 part: continuation block: s-p1-b0 -->"]
