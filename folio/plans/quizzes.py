"""Queries of pages of components: faults, elements by place, quizzes in prose, slots. Each page is put together by one SQL
expression that both sides share; what it holds changes with the row, what comes out is stated on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import inline_quiz, mdx
from folio.plans.registry import query
from folio.session import table

NL = "chr(10)"


def _pages(spark, sf, body):
    return table(spark, sf, "part").select("p_partkey", F.expr(body).alias("body"), F.array(F.lit("s1"), F.concat(F.lit("r"), "p_size")).alias("allowed"), F.concat(F.lit("ch"), "p_size").alias("chapter_id"), (F.col("p_partkey") % 12).cast("int").alias("section_index"))


def _case(of, *parts):
    return "CASE " + " ".join(f"WHEN {of} = {i} THEN {p}" for i, p in enumerate(parts)) + " ELSE '' END"


_ODD = _case("p_size % 7", "''", "' {x. ' || p_brand || '}'", "' <script src=\"a\" />'", "' <T onClick=\"a\" ref={1}>t</T>'", "' a < b {c} <Open>'", "' <A><B></A></B>'", f"' `<a {{b`' || {NL} || '<Wide note=\"' || p_type || '>\">' || {NL} || 'x'")


@query("CH28_page_faults", f"""
WITH p AS (SELECT p_partkey, p_size % 7 AS k, length(p_name) AS n, length(p_brand) AS b, p_brand FROM part)
SELECT p_partkey, 1 AS line, CAST(n + 2 AS INTEGER) AS "column", 'no-bare-expression' AS rule, 'x. ' || p_brand AS value FROM p WHERE k = 1
UNION ALL SELECT p_partkey, 1, CAST(n + 2 AS INTEGER), 'no-raw-html-element', 'script' FROM p WHERE k = 2
UNION ALL SELECT p_partkey, 1, CAST(n + 2 AS INTEGER), 'no-unsafe-jsx-prop', unnest(['onClick', 'ref']) FROM p WHERE k = 3
UNION ALL SELECT p_partkey, 1, CAST(n + 4 AS INTEGER), 'mdx-syntax', 'bare <' FROM p WHERE k = 4
UNION ALL SELECT p_partkey, 1, CAST(n + 8 AS INTEGER), 'mdx-syntax', 'unopened A' FROM p WHERE k = 5
UNION ALL SELECT p_partkey, 2, 1, 'mdx-syntax', 'unclosed Wide' FROM p WHERE k = 6""")
def _(spark, sf):
    return mdx.faults(mdx.tokens(_pages(spark, sf, f"p_name || {_ODD}"), "p_partkey", "body"), "p_partkey")


_SLOT = "'<QuizItemSlot id=\"auto\" topic=\"{topic}\" sourceRefs={{[\"{ref}\"]}} />'"
_LAYOUT = "p_name || ' <QuizBlock><QuizItem a={{\"k\": \">\"}}>' || p_brand || '</QuizItem>' || CASE WHEN p_size % 2 = 0 THEN '<QuizItemSlot topic=\"t>0\" />' ELSE '<Odd>' || p_type || '</Odd>' END || '</QuizBlock> <QuizItemSlot id=\"x\" />'"


@query("CH27_quiz_layout", """
WITH p AS (SELECT p_partkey, p_size % 2 AS k, length(p_name) + 1 AS s, length(p_name) + 12 AS i, 36 + length(p_brand) AS w, CASE WHEN p_size % 2 = 0 THEN 28 ELSE 11 + length(p_type) END AS c FROM part),
q AS (SELECT *, i + w + c + 12 AS e FROM p)
SELECT p_partkey, CAST(s AS INTEGER) AS block_start, CAST(e AS INTEGER) AS block_end, 'item' AS kind, 'QuizItem' AS name, CAST(i AS INTEGER) AS start, CAST(i + w AS INTEGER) AS "end" FROM q
UNION ALL SELECT p_partkey, CAST(s AS INTEGER), CAST(e AS INTEGER), CASE WHEN k = 0 THEN 'slot' ELSE 'unknown' END, CASE WHEN k = 0 THEN 'QuizItemSlot' ELSE 'Odd' END, CAST(i + w AS INTEGER), CAST(i + w + c AS INTEGER) FROM q
UNION ALL SELECT p_partkey, -1, -1, 'stray', 'QuizItemSlot', CAST(e + 1 AS INTEGER), CAST(e + 24 AS INTEGER) FROM q""")
def _(spark, sf):
    return mdx.quiz_children(mdx.tokens(_pages(spark, sf, _LAYOUT), "p_partkey", "body"), "p_partkey").fillna(-1)


def _written_slot(i):
    """Slot i of a section: the fourth repeats the first, the fifth has no allowed reference."""
    return _SLOT.format(topic="t1" if i == 4 else f"t{i} > 0" if i == 2 else f"t{i}", ref="gone" if i == 5 else "s1")


_SECTION = f"'Intro ' || p_name || CASE WHEN p_size % 7 = 0 THEN ' a < b' ELSE '' END || {NL} || {NL} || '<QuizBlock>' || {NL}" + "".join(f" || CASE WHEN p_size % 10 >= {i} THEN {_written_slot(i)} || {NL} ELSE '' END" for i in range(1, 10)) + f" || '</QuizBlock>' || {NL} || {NL} || 'End'"
_KEPT = {1: 0, 2: 1, 3: 2, 6: 3, 7: 4, 8: 5, 9: 6}


def _canonical(i):
    return f"'<QuizItemSlot id=\"ch' || p_size || ':s' || p_partkey % 12 || ':slot-00{_KEPT[i]}\" topic=\"{'t2 &gt; 0' if i == 2 else f't{i}'}\" sourceRefs={{[\"s1\"]}} />'"


_STAYS = "p_size % 10 >= {i} AND ({i} < 9 OR p_size % 7 = 0)"
_BLOCK = "'<QuizBlock>' || chr(10) || " + " || ".join(f"CASE WHEN p_size % 10 >= {i} THEN {'' if i == 1 else 'chr(10) || chr(10) || '}{_canonical(i)} ELSE '' END" for i in (1, 2, 3, 6, 7, 8)) + " || chr(10) || '</QuizBlock>'"
_SAVED = "'<QuizBlock>' || chr(10) || " + " || ".join(f"CASE WHEN p_size % 10 >= {i} THEN {_canonical(i)} || chr(10) ELSE '' END" + (" || CASE WHEN p_size % 10 >= 4 THEN chr(10) ELSE '' END" if i == 3 else "") for i in _KEPT) + " || '</QuizBlock>'"


def _sections(spark, sf):
    return inline_quiz.sanitised(_pages(spark, sf, _SECTION), "p_partkey")


@query("CH26_sanitised_bodies", f"""
SELECT p_partkey, CASE
  WHEN p_size % 7 = 0 AND p_size % 10 = 0 THEN 'Intro ' || p_name || ' a < b' || chr(10) || chr(10) || '<QuizBlock>' || chr(10) || '</QuizBlock>' || chr(10) || chr(10) || 'End'
  WHEN p_size % 7 = 0 THEN 'Intro ' || p_name || ' a < b' || chr(10) || chr(10) || {_SAVED} || chr(10) || chr(10) || 'End' || chr(10)
  WHEN p_size % 10 = 0 THEN 'Intro ' || p_name || chr(10) || chr(10) || 'End' || chr(10)
  ELSE 'Intro ' || p_name || chr(10) || chr(10) || {_BLOCK} || chr(10) || chr(10) || 'End' || chr(10) END AS body FROM part""")
def _(spark, sf):
    return _sections(spark, sf).bodies


@query("CH26_slots", " UNION ALL ".join(f"SELECT p_partkey, 'ch' || p_size || ':s' || p_partkey % 12 || ':slot-00{_KEPT[i]}' AS slot_id, '{'t2 > 0' if i == 2 else f't{i}'}' AS topic, '' AS concept, 'mcq' AS kind, 's1' AS refs FROM part WHERE {_STAYS.format(i=i)}" for i in _KEPT))
def _(spark, sf):
    return _sections(spark, sf).slots.withColumn("refs", F.array_join("refs", ","))


@query("CH26_warnings", """
SELECT p_partkey, 'dropped duplicate quiz slot' AS warning FROM part WHERE p_size % 10 >= 4
UNION ALL SELECT p_partkey, 'dropped invalid quiz slot' FROM part WHERE p_size % 10 >= 5
UNION ALL SELECT p_partkey, 'quiz cap reached, dropped extra' FROM part WHERE p_size % 10 = 9 AND p_size % 7 <> 0""")
def _(spark, sf):
    return _sections(spark, sf).warnings.drop("start")


_ITEM = f"'<QuizBlock><QuizItem id=\"a\" answer=\"' || CASE WHEN p_size % 3 = 0 THEN 'z' ELSE 'b' END || '\" citations={{[{{\"ref_id\": \"r' || p_size || '\", \"quote\": \"' || p_brand || ' > {{x}}\"}}, {{\"ref_id\": \"no\", \"quote\": \"q\"}}]}}><QuizQuestion>What of ' || p_name || ' &' || ' $a<b$?</QuizQuestion><QuizChoices><QuizChoice id=\"a\">' || p_type || '</QuizChoice><QuizChoice id=\"b\">' || p_brand || '</QuizChoice><QuizChoice id=\"c\"> </QuizChoice></QuizChoices><QuizExplanation>So</QuizExplanation></QuizItem></QuizBlock>' || {NL} || 'End'"


@query("CH26_items", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'End' || chr(10) ELSE '<QuizBlock>' || chr(10) || '<QuizItem id="quiz-ch' || p_size || '-s' || lpad(CAST(p_partkey % 12 AS VARCHAR), 3, '0') || '-01" answer="choice-2" citations={[' || chr(10) || '  {' || chr(10) || '    "ref_id": "r' || p_size || '",' || chr(10) || '    "quote": "' || p_brand || ' > {x}"' || chr(10) || '  }' || chr(10) || ']}>' || chr(10)
  || '<QuizQuestion>' || chr(10) || 'What of ' || p_name || ' &amp; $a<b$?' || chr(10) || '</QuizQuestion>' || chr(10) || '<QuizChoices>' || chr(10) || '<QuizChoice id="choice-1">' || chr(10) || p_type || chr(10) || '</QuizChoice>' || chr(10) || '<QuizChoice id="choice-2">' || chr(10) || p_brand || chr(10) || '</QuizChoice>' || chr(10)
  || '</QuizChoices>' || chr(10) || '<QuizCheck />' || chr(10) || '<QuizExplanation>' || chr(10) || 'So' || chr(10) || '</QuizExplanation>' || chr(10) || '</QuizItem>' || chr(10) || '</QuizBlock>' || chr(10) || 'End' || chr(10) END AS body FROM part""")
def _(spark, sf):
    return inline_quiz.sanitised(_pages(spark, sf, _ITEM), "p_partkey").bodies


_UNFILLED = f"p_name || {NL} || '<QuizBlock>' || {NL} || '<QuizItemSlot id=\"a\" topic=\"' || p_brand || ' > 0\" />' || {NL} || '</QuizBlock>' || {NL} || {NL} || '<QuizBlock><Kept/><QuizItemSlot id=\"b\"></QuizItemSlot></QuizBlock>' || {NL} || CASE WHEN p_size % 5 = 0 THEN 'n < 3 ' ELSE '' END || '<QuizItemSlot id=\"c\" /> end'"


@query("XD03_resolved_slots", """
WITH p AS (SELECT *, p_size % 2 = 0 AS a, p_size % 3 = 0 AS b, p_size % 4 = 0 AS c, p_size % 5 = 0 AS broken FROM part)
SELECT p_partkey, p_name || chr(10) || CASE WHEN a THEN '<QuizBlock>' || chr(10) || '<A>' || p_type || '</A>' || chr(10) || '</QuizBlock>' || chr(10) || chr(10) WHEN broken THEN '' ELSE chr(10) END
  || '<QuizBlock><Kept/>' || CASE WHEN b THEN '<B/>' ELSE '' END || '</QuizBlock>' || chr(10)
  || CASE WHEN broken THEN 'n < 3 ' || CASE WHEN c THEN '<C/>' ELSE '' END WHEN c THEN '<QuizBlock>' || chr(10) || '<C/>' || chr(10) || '</QuizBlock>' ELSE '' END || ' end' AS body FROM p""")
def _(spark, sf):
    pages = _pages(spark, sf, _UNFILLED.replace("<QuizItemSlot id=\"b\"></QuizItemSlot>", "<QuizItemSlot id=\"b\" />"))
    fill = lambda slot, text, when: table(spark, sf, "part").where(when).select("p_partkey", F.lit(slot).alias("slot_id"), text.alias("mdx"))
    fills = fill("a", F.concat(F.lit("<A>"), "p_type", F.lit("</A>")), "p_size % 2 = 0").unionByName(fill("b", F.lit("<B/>"), "p_size % 3 = 0")).unionByName(fill("c", F.lit("<C/>"), "p_size % 4 = 0"))
    return inline_quiz.resolved(pages, fills, "p_partkey").select("p_partkey", "body")
