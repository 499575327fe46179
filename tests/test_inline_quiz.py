"""Tokens, elements and faults of pages; quizzes in prose checked and rendered anew; slots filled."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folio.operators import inline_quiz as Q
from folio.operators import mdx

ITEM = '<QuizItem id="x" answer="b" citations={[{"ref_id": "p1", "quote": "a > {b}"}, {"ref_id": "no", "quote": "q"}]}>\n<QuizQuestion>\nIs n & 3?\n</QuizQuestion>\n<BookFigure id="f&amp;1" />\n<QuizChoices>\n<QuizChoice id="a">one</QuizChoice>\n<QuizChoice id="b">two $x<y$</QuizChoice>\n<QuizChoice id="c"> </QuizChoice>\n</QuizChoices>\n<QuizExplanation>Because</QuizExplanation>\n</QuizItem>'
PAGE = "page int, body string"


def slot(topic, refs='["p1"]', more=""):
    return f'<QuizItemSlot id="auto" topic="{topic}"{more} sourceRefs={{{refs}}} />'


def sanitised(spark, bodies, allowed=("p1", "p2")):
    rows = [(i, b, list(allowed), "ch", i) for i, b in enumerate(bodies)]
    made = Q.sanitised(spark.createDataFrame(rows, "k int, body string, allowed array<string>, chapter_id string, section_index int"), "k")
    slots = [tuple(r) for r in made.slots.orderBy("k", "slot_id").collect()]
    warnings = [(r.k, r.warning) for r in made.warnings.orderBy("k", "start").collect()]
    return {r.k: r.body for r in made.bodies.collect()}, slots, warnings


def test_items_are_rendered_anew_and_slots_numbered(spark):
    bad = ITEM.replace('answer="b"', 'answer="z"')
    body = f"# 𝒜 Title\n\n\n\nText {{/* */}}\n<QuizBlock>\n{ITEM}\n{bad}\n{slot('t > 0', more=' concept=c')}{slot('t > 0', more=' kind=worked')}\n<Odd/>\n{slot('no', '[7]')}</QuizBlock>\nend\n\n\n".replace("{/* */}", "").replace("=c ", '="c" ').replace("=worked", '="worked"')
    bodies, slots, warnings = sanitised(spark, [body])
    assert bodies[0] == (
        "# 𝒜 Title\n\nText \n<QuizBlock>\n"
        '<QuizItem id="quiz-ch-s000-01" answer="choice-2" citations={[\n  {\n    "ref_id": "p1",\n    "quote": "a > {b}"\n  }\n]}>\n<QuizQuestion>\nIs n &amp; 3?\n</QuizQuestion>\n<BookFigure id="f&amp;1" />\n<QuizChoices>\n'
        '<QuizChoice id="choice-1">\none\n</QuizChoice>\n<QuizChoice id="choice-2">\ntwo $x<y$\n</QuizChoice>\n</QuizChoices>\n<QuizCheck />\n<QuizExplanation>\nBecause\n</QuizExplanation>\n</QuizItem>\n\n'
        '<QuizItemSlot id="ch:s0:slot-000" topic="t &gt; 0" concept="c" sourceRefs={["p1"]} />\n\n<QuizItemSlot id="ch:s0:slot-001" topic="t &gt; 0" kind="worked" sourceRefs={["p1"]} />\n</QuizBlock>\nend\n'
    )
    assert slots == [(0, "ch:s0:slot-000", "t > 0", "c", "mcq", ["p1"]), (0, "ch:s0:slot-001", "t > 0", "", "worked", ["p1"])]
    assert [w for _, w in warnings] == ["dropped invalid quiz item", "dropped stray <Odd>", "dropped invalid quiz slot"]


def test_caps_duplicates_and_empty_blocks(spark):
    many = "<QuizBlock>\n" + "\n".join(slot(f"t{i}") for i in range(10)) + "\n</QuizBlock>"
    twice = f"<QuizBlock>{slot('a')}{slot('a')}</QuizBlock>\n\n<QuizBlock>{slot('a')}</QuizBlock>\n\n<QuizBlock/>\nend"
    three = "\n".join("<QuizBlock>" + "".join(slot(f"{b}{i}") for i in range(4)) + "</QuizBlock>" for b in "abc")
    bodies, slots, warnings = sanitised(spark, [many, twice, three, "no quiz\n\n\n\nhere "])
    assert bodies[0].count("<QuizItemSlot") == 6 and [w for k, w in warnings if k == 0] == ["quiz cap reached, dropped extra"]
    assert bodies[1] == '<QuizBlock>\n<QuizItemSlot id="ch:s1:slot-000" topic="a" sourceRefs={["p1"]} />\n</QuizBlock>\n\nend\n'
    assert [w for k, w in warnings if k == 1] == ["dropped duplicate quiz slot"] * 2
    assert [s[1] for s in slots if s[0] == 2] == [f"ch:s2:slot-{i:03d}" for i in range(8)] and bodies[2].count("<QuizBlock>") == 2
    assert [w for k, w in warnings if k == 2] == ["quiz cap reached, dropped extra"]
    assert bodies[3] == "no quiz\n\nhere\n"


def test_texts_that_cant_be_parsed_keep_items_and_save_slots(spark):
    body = f"when n<30 use t.\n\n<QuizBlock>\n{ITEM}\n{slot('for t>0')}{slot('for t>0')}{slot('x', '[\"gone\"]')}\n</QuizBlock>"
    bodies, slots, warnings = sanitised(spark, [body, "n < 30", None])
    assert bodies[1] == "n < 30" and [s[1:3] for s in slots] == [("ch:s0:slot-000", "for t>0")]
    assert "when n<30 use t." in bodies[0] and '<QuizItem id="x" answer="b"' in bodies[0] and bodies[0].count("<QuizItemSlot") == 1
    assert [w for _, w in warnings] == ["dropped duplicate quiz slot", "dropped invalid quiz slot"]


def test_the_fold_against_a_loop(spark):
    rng = random.Random(1)
    rows = []
    for k in range(200):
        block, children = 0, []
        for start in range(rng.randrange(0, 30)):
            block += rng.random() < 0.2
            children.append((start, block, rng.random() < 0.8, rng.choice([None, "a", "b", "c", "d", "e", "f", "g"])))
        rows.append((k, children))
    frame = spark.createDataFrame(rows, "k int, c array<struct<start:int,block:int,valid:boolean,same:string>>")
    got = {r.k: list(r.kept) for r in frame.select("k", Q.kept_places(F.col("c"), 4, 8).alias("kept")).collect()}
    for k, children in rows:
        kept, seen, inside = [], set(), {}
        for start, block, valid, same in children:
            if len(kept) < 8 and inside.get(block, 0) < 4 and valid and same not in seen:
                kept.append(start)
                inside[block] = inside.get(block, 0) + 1
                seen |= {same} - {None}
        assert got[k] == kept


def test_slots_are_filled_wrapped_or_dropped(spark):
    pages = spark.createDataFrame([
        (1, f'𝒜\n<QuizBlock>\n{ITEM}\n<QuizItemSlot id="s1" topic="t>0" />\n</QuizBlock>\n\n<QuizBlock>\n<QuizItemSlot id="s2" /><QuizItemSlot id="s9"></QuizItemSlot>\n</QuizBlock>\n\n\nend <QuizItemSlot id="s3" /> <QuizItemSlot id="none" />\n```\n<QuizItemSlot id="s1" />\n\n\n\n```\n'),
        (2, "<QuizBlock>\n<QuizItemSlot id=\"s1\" />\n<QuizItemSlot id='none' /></QuizBlock>"),
        (3, 'n < 3 <QuizBlock>\n<QuizItemSlot id="none" topic="t>0" />\n</QuizBlock>\n\nand <QuizItemSlot id="s1" />'),
        (4, None),
    ], PAGE)
    fills = spark.createDataFrame([(1, "s1", "<One/>"), (1, "s3", "<Three/>"), (2, "s1", "<Two/>"), (3, "s1", "<X/>"), (1, "other", "<Y/>")], "page int, slot_id string, mdx string")
    got = {r.page: r.body for r in Q.resolved(pages, fills, "page").collect()}
    assert got[1] == f"𝒜\n<QuizBlock>\n{ITEM}\n<One/>\n</QuizBlock>\n\nend <QuizBlock>\n<Three/>\n</QuizBlock> \n```\n<QuizItemSlot id=\"s1\" />\n\n\n\n```\n"
    assert got[2] == "<QuizBlock>\n<Two/>\n</QuizBlock>" and got[3] == "n < 3 and <X/>" and got[4] is None


def test_edits_that_clash_are_told_and_left_out(spark):
    pages = spark.createDataFrame([(1, "a𝒜cdefgh"), (2, "xyz")], PAGE)
    edits = spark.createDataFrame([(1, 1, 2, "B"), (1, 2, 3, "no"), (1, 5, 0, "+"), (1, 5, 3, "END"), (2, 0, 3, "")], "page int, start int, length int, new string")
    assert {(r.start, r.length) for r in mdx.overlapping(edits, "page").where("clash").collect()} == {(2, 3)}
    assert {r.page: r.body for r in mdx.edited(pages, edits, "page", "body").collect()} == {1: "aBde+END", 2: ""}


def stack(text):
    """Peer: one pass with a stack over tags, braces and strings; the first fault and all elements with depths."""
    found, open_, at = [], [], 0
    while at < len(text):
        m = re.compile(r"</([A-Za-z]+)>").match(text, at)
        if m:
            if not open_ or open_[-1][0] != m[1]:
                return ("unopened " + m[1], at), found
            name, start = open_.pop()
            found.append((name, start, m.end(), len(open_) + 1))
            at = m.end()
            continue
        m = re.compile(r"<([A-Za-z]+)(?=[\s/>])").match(text, at)
        if m:
            i = m.end()
            while i < len(text) and text[i] not in "<>":
                if text[i] == '"':
                    i = text.find('"', i + 1)
                    if i < 0:
                        return ("bare <", at), found
                elif text[i] == "{":
                    depth = 0
                    while i < len(text):
                        if text[i] == '"':
                            i = text.find('"', i + 1)
                            if i < 0:
                                return ("bare <", at), found
                        depth += {"{": 1, "}": -1}.get(text[i], 0)
                        if depth == 0:
                            break
                        i += 1
                    else:
                        return ("bare <", at), found
                elif text[i] == "}":
                    return ("bare <", at), found
                i += 1
            if i >= len(text) or text[i] == "<":
                return ("bare <", at), found
            if text[i - 1] == "/":
                found.append((m[1], at, i + 1, len(open_) + 1))
            else:
                open_.append((m[1], at))
            at = i + 1
            continue
        if text[at] == "<":
            return ("bare <", at), found
        at += 1
    return ("unclosed " + open_[0][0], open_[0][1]) if open_ else None, found


@pytest.fixture(scope="module")
def random_pages():
    rng = random.Random(7)
    parts = ["<A>", "</A>", "<B>", "</B>", '<C x="a>b" />', '<A y={{"k": "}>"}}>', "text 𝒜 ", "\n", '<B z="</A>">', "\\<", "$a<b$", "`</A>`"]
    pages = []
    for _ in range(300):
        depth, out = [], []
        for _ in range(rng.randrange(1, 14)):
            p = rng.choice(parts)
            if p.startswith("</") and depth and rng.random() < 0.9:
                p = f"</{depth.pop()}>"
            elif p[0] == "<" and p[1] != "/" and not p.endswith("/>"):
                depth.append(p[1])
            out.append(p)
        pages.append("".join(out) + ("".join(f"</{d}>" for d in reversed(depth)) if rng.random() < 0.8 else ""))
    return [*pages, "a < b", "", "<A", "x {", None]


def test_faults_and_elements_against_a_stack(spark, random_pages):
    found = mdx.tokens(spark.createDataFrame(list(enumerate(random_pages)), PAGE), "page", "body").cache()
    faults = {r.page: (r.value, r.column, r.line) for r in mdx.faults(found, "page").where("rule = 'mdx-syntax'").collect()}
    every = {}
    for r in mdx.elements(found, "page").collect():
        every.setdefault(r.page, set()).add((r.name, r.start, r.end, r.depth))
    for i, text in enumerate(random_pages):
        if text is None or "{" in text and text.endswith("{"):
            continue
        blank = re.sub(r"\\.|\$[^$\n]*\$|`[^`\n]*`", lambda m: "." * len(m[0]), text)
        fault, elements = stack(blank)
        if fault is None:
            assert i not in faults and every.get(i, set()) == set(elements), text
        else:
            at = fault[1]
            line = text.count("\n", 0, at) + 1
            if fault[0].startswith("unclosed"):
                assert faults[i][0].startswith("unclosed"), text
            else:
                assert faults[i] == (fault[0], at - (text.rfind("\n", 0, at) + 1) + 1, line), text


def test_expressions_raw_elements_and_props(spark):
    body = 'ok {x.y}\n<script src="a" />\n<T onClick={() => {a}} title="ref=1 onX" ref="z">`{code}` $\\frac{a}{b}$ \\{x}</T>\n```\n{fence}\n```\n---\n'
    rows = [tuple(r) for r in mdx.faults(mdx.tokens(spark.createDataFrame([(1, body)], PAGE), "page", "body"), "page").orderBy("line", "value").collect()]
    assert rows == [(1, 1, 4, "no-bare-expression", "x.y"), (1, 2, 1, "no-raw-html-element", "script"), (1, 3, 1, "no-unsafe-jsx-prop", "onClick"), (1, 3, 1, "no-unsafe-jsx-prop", "ref")]


def test_a_long_page_in_time(spark):
    body = '<Note a={{"k": 1}}>word {x} $y$ \n</Note>\n' * 25_000 + "{" * 2000
    found = mdx.tokens(spark.createDataFrame([(1, body)], PAGE), "page", "body")
    assert [r.value for r in mdx.faults(found, "page").collect()] == ["bare {"]
