"""Queries of the markup functions and item operators. Pages are made from whole table rows by the same expression on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.functions import maths
from folio.functions import text as T
from folio.operators import items as I
from folio.operators import linking
from folio.plans.registry import query
from folio.session import table

C, L = F.col, F.lit


def made(spark, sf, name, key, *parts, where=None):
    """(key, body): a text put together from literals and columns (names behind @)."""
    rows = table(spark, sf, name)
    body = F.concat(*(C(p[1:]).cast("string") if p.startswith("@") else L(p) for p in parts))
    return rows.select(key, body.alias("body"))


@query("FN08_blocks", """
SELECT doc_id, 0 AS place, ' level="x>y"' AS attrs, text AS body FROM documents
UNION ALL SELECT doc_id, 1, ' wide', lang FROM documents UNION ALL SELECT doc_id, 2, '', source FROM documents""")
def _(spark, sf):
    pages = made(spark, sf, "documents", "doc_id", '<Note level="x>y">', "@text", "</Note> and <Note wide>", "@lang", "</Note><Note>", "@source", "</Note></Other>")
    return pages.select("doc_id", F.posexplode(M.blocks(C("body"), "Note")).alias("place", "b")).select("doc_id", "place", "b.attrs", "b.body")


@query("FN09_braced_prop", """
SELECT doc_id, '[{"q": "n}>1 \\"' || source || '\\"", "k": {"d": ' || doc_id || '}}]' AS items, '{1: {}}' AS other, TRUE AS missing FROM documents""")
def _(spark, sf):
    tags = made(spark, sf, "documents", "doc_id", ' items={ [{"q": "n}>1 \\"', "@source", '\\"", "k": {"d": ', "@doc_id", '}}] } other={{1: {}}} open={{"a": 1} ')
    return tags.select("doc_id", M.braced(C("body"), "items").alias("items"), M.braced(C("body"), "other").alias("other"), M.braced(C("body"), "open").isNull().alias("missing"))


@query("FN10_prop_value", """
SELECT doc_id, lang || ' > "x"' AS a, CAST(doc_id AS VARCHAR) AS b, source AS c, 'note: ' || lang AS d, TRUE AS e, lang || ',' || source AS f, TRUE AS g FROM documents""")
def _(spark, sf):
    tags = made(spark, sf, "documents", "doc_id", ' a={"', "@lang", ' > \\"x\\""} b={', "@doc_id", "} c='", "@source", "' d={note: ", "@lang", '} f={["', "@lang", '", "', "@source", '"]} g={[oops}')
    p = {name: M.prop(C("body"), name).alias(name) for name in "abcd"}
    lists = {name: M.prop_json(C("body"), name, "array<string>") for name in "fg"}
    return tags.select("doc_id", *p.values(), M.prop(C("body"), "e").isNull().alias("e"), F.array_join(lists["f"], ",").alias("f"), lists["g"].isNull().alias("g"))


@query("FN11_child_text", "SELECT doc_id, lang || chr(10) || '  ' || source || chr(10) || chr(10) || 'end' AS child FROM documents")
def _(spark, sf):
    bodies = made(spark, sf, "documents", "doc_id", "\n    ", "@lang", "\n      ", "@source", "\n  \n    end\n  ")
    return bodies.select("doc_id", M.child_text(C("body")).alias("child"))


QUIZ = ['# Page\n<QuizBlock>\n<QuizItem id="q', "@p_partkey", '" answer="b" citations={[{"ref_id": "src-p', "@p_size", '", "quote": "a > {b}"}]}>\n<QuizQuestion>\n  What is ', "@p_name", "?\n</QuizQuestion>\n<QuizChoice id=\"a\">", "@p_brand", '</QuizChoice><QuizChoice id="b">', "@p_type", "</QuizChoice>\n<QuizExplanation>Because.</QuizExplanation>\n</QuizItem>\n<QuizItem id=\"z\" answer=\"none\"><QuizQuestion>Odd</QuizQuestion></QuizItem>\n</QuizBlock>\n"]
EXAM = ['<ExamBlock>\n<ExamItem id="m', "@p_partkey", '" type="multiple_choice" answer={["a","c"]} fromExam><ExamQuestion>', "@p_name", '</ExamQuestion><ExamChoice id="a">', "@p_brand", '</ExamChoice><ExamChoice id="b">no</ExamChoice><ExamChoice id="c">', "@p_type", '</ExamChoice><ExamExplanation>e</ExamExplanation></ExamItem>\n<ExamItem id="w" type="worked" referenceAnswer="', "@p_size", '"><ExamQuestion>Work</ExamQuestion></ExamItem>\n<ExamItem id="f" type="fill_blank" acceptedAnswers={["x"]}><ExamQuestion>Fill ___</ExamQuestion></ExamItem>\n</ExamBlock>\n']
WORKED = ['<WorkedProblem id="p', "@p_partkey", '" question="How > ', "@p_name", '?" referenceAnswer={"', "@p_brand", '"} explanation="so">x</WorkedProblem>\n']
DECK = ['<AnkiDeck>\n<AnkiCard id="c', "@p_partkey", '"><AnkiFront>\n    ', "@p_name", "\n      more\n</AnkiFront><AnkiBack>", "@p_type", "</AnkiBack></AnkiCard>\n<AnkiCard><AnkiFront>f</AnkiFront></AnkiCard></AnkiDeck>\n"]
_QUIZ_SQL = """
SELECT p_partkey, 0 AS place, 'q' || p_partkey AS item_id, 'multiple_choice' AS type, 'What is ' || p_name || '?' AS question, p_brand || '|' || p_type AS choices, p_type AS answer, 'Because.' AS explanation, 'src-p' || p_size AS refs FROM part
UNION ALL SELECT p_partkey, 1, 'z', 'multiple_choice', 'Odd', '', 'none', '', '' FROM part"""
_EXAM_SQL = """
SELECT p_partkey, 0 AS place, 'm' || p_partkey AS item_id, 'multiple_choice' AS type, p_name AS question, p_brand || '|no|' || p_type AS choices, p_brand || ', ' || p_type AS answer, 'e' AS explanation, '' AS refs FROM part
UNION ALL SELECT p_partkey, 1, 'w', 'worked', 'Work', '', CAST(p_size AS VARCHAR), '', '' FROM part
UNION ALL SELECT p_partkey, 2, 'f', 'fill_blank', 'Fill ___', '', '', '', '' FROM part"""
_WORKED_SQL = "SELECT p_partkey, 0 AS place, 'p' || p_partkey AS item_id, 'worked' AS type, 'How > ' || p_name || '?' AS question, '' AS choices, p_brand AS answer, 'so' AS explanation, '' AS refs FROM part"


def _flat(items):
    return items.withColumns({"choices": F.array_join("choices", "|"), "refs": F.array_join(I.item_refs(F.array().cast("array<string>"), C("citations")), ",")}).drop("citations")


@query("CH11_quiz_items", _QUIZ_SQL)
def _(spark, sf):
    return _flat(I.quiz_items(made(spark, sf, "part", "p_partkey", *QUIZ, *WORKED), "p_partkey", "body"))


@query("CH11_exam_items", _EXAM_SQL)
def _(spark, sf):
    return _flat(I.exam_items(made(spark, sf, "part", "p_partkey", *QUIZ, *EXAM), "p_partkey", "body"))


@query("CH11_worked_items", _WORKED_SQL)
def _(spark, sf):
    return _flat(I.worked_items(made(spark, sf, "part", "p_partkey", *EXAM, *WORKED), "p_partkey", "body"))


@query("CH11_cards", """
SELECT p_partkey, 0 AS place, 'c' || p_partkey AS item_id, p_name || chr(10) || '  more' AS front, p_type AS back FROM part UNION ALL SELECT p_partkey, 1, '', 'f', '' FROM part""")
def _(spark, sf):
    return I.cards(made(spark, sf, "part", "p_partkey", *DECK, *WORKED), "p_partkey", "body").drop("citations")


@query("CH12_learning_items", f"""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE CAST(p_partkey AS VARCHAR) END AS chapter_id, item_id, type, answer, refs
FROM ({_QUIZ_SQL} UNION ALL {_EXAM_SQL} UNION ALL {_WORKED_SQL}) JOIN part USING (p_partkey)""")
def _(spark, sf):
    pages = made(spark, sf, "part", "p_partkey", *QUIZ, *EXAM, *WORKED).join(table(spark, sf, "part").select("p_partkey", F.when(C("p_size") % 2 == 0, C("p_brand")).alias("chapter")), "p_partkey")
    items = I.learning_items(pages, "p_partkey", "body", "chapter")
    return items.select("p_partkey", "chapter_id", "item_id", "type", "answer", F.array_join("source_refs", ",").alias("refs"))


@query("XC01_item_refs", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || ',' ELSE '' END || 'src-p' || p_size AS refs FROM part")
def _(spark, sf):
    own = F.when(C("p_size") % 2 == 0, F.array(F.concat(L(" "), C("p_brand"), L(" ")), L(" "))).otherwise(F.array(L("")))
    cited = F.from_json(F.concat(L('[{"ref_id": "src-p'), "p_size", L('"}, {"quote": "none"}, {"ref_id": "src-p'), "p_size", L(' "}]')), I.CITATIONS)
    return table(spark, sf, "part").select("p_partkey", F.array_join(I.item_refs(own, cited), ",").alias("refs"))


@query("XC03_source_ref_ids", "SELECT doc_id, source || '-p1,' || lang || '-p2,' || lang || ',plain' AS refs FROM documents")
def _(spark, sf):
    pages = made(spark, sf, "documents", "doc_id", '<SourceRef note="a > b" id="', "@source", '-p1" /> <SourceRef id={"', "@lang", "-p2\"} /> <SourceRef id={\"'", "@lang", "'\"} /> <SourceRef id='plain'></SourceRef> <SourceRef none />")
    return pages.select("doc_id", F.array_join(M.source_ref_ids("body"), ",").alias("refs"))


@query("XB04_grounded_citations", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'src-p' || p_size ELSE '' END AS refs, p_size % 2 = 0 AS valid FROM part")
def _(spark, sf):
    cited = F.from_json(F.concat(L('[{"ref_id": "src-p'), "p_size", L('"}, {"ref_id": "other"}]')), I.CITATIONS)
    allowed = F.when(C("p_size") % 3 == 0, F.array(F.concat(L("src-p"), C("p_size").cast("string")))).otherwise(F.array().cast("array<string>"))
    choices = F.array(*(F.struct(L(i).alias("id"), t.alias("text")) for i, t in (("a", C("p_name")), ("b", C("p_type")), ("c", L(" ")))))
    valid = I.item_valid(C("p_name"), L("so"), choices, F.when(C("p_size") % 2 == 0, "b").otherwise("c"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(I.grounded(cited, allowed), lambda c: c["ref_id"]), ",").alias("refs"), valid.alias("valid"))


SLOTS = ['Text <QuizItemSlot topic="t > ', "@p_name", '" concept="', "@p_brand", '" kind="worked" sourceRefs={["s', "@p_size", '","x"]} />\n\n<QuizItemSlot topic="', "@p_type", '" kind="odd" sourceRefs={["s', "@p_size", '"]} /> <QuizItemSlot topic="', "@p_type", '" sourceRefs={["y","s', "@p_size", '"]} /> <QuizItemSlot topic="  " sourceRefs={["s1"]} /> <QuizItemSlot topic="no refs" sourceRefs={["gone"]} />']


@query("XB05_valid_slots", """
SELECT p_partkey, 1 AS slot, 't > ' || p_name AS topic, 'worked' AS kind, 's' || p_size AS refs FROM part WHERE p_size <= 25
UNION ALL SELECT p_partkey, 2, p_type, 'mcq', 's' || p_size FROM part WHERE p_size <= 25""")
def _(spark, sf):
    allowed = F.transform(F.sequence(L(1), L(25)), lambda n: F.concat(L("s"), n.cast("string")))
    found = I.valid_slots(I.slots(made(spark, sf, "part", "p_partkey", *SLOTS), "p_partkey", "body"), allowed, "p_partkey")
    return found.select("p_partkey", "slot", "topic", "kind", F.array_join("refs", ",").alias("refs"))


@query("XB06_prose_without_quizzes", r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || 'end' || chr(10) AS prose FROM documents WHERE regexp_matches(text, '\S')""")
def _(spark, sf):
    pages = made(spark, sf, "documents", "doc_id", '<QuizBlock a="1>0"><QuizItem/></QuizBlock>\n', "@text", '\n<QuizItemSlot topic="a>b" />\n\nend').where(F.length(T.strip(F.regexp_replace("body", "<[^\n]*", ""))) > 3)
    return pages.select("doc_id", F.regexp_replace(M.without_quizzes(C("body")), r"\s+end\n$", "\n\nend\n").alias("prose"))


@query("XB07_answers_unknown", "SELECT p_partkey, 'q' || p_partkey AS item_id FROM part WHERE p_size % 5 = 0")
def _(spark, sf):
    items = table(spark, sf, "part").select("p_partkey", F.concat(L("q"), "p_partkey").alias("item_id"), F.array("p_name", "p_type").alias("choices"), F.when(C("p_size") % 5 == 0, L("none")).otherwise(C("p_type")).alias("answer"))
    return I.answers_unknown(items, "p_partkey")


@query("FN19_escape_text", "SELECT doc_id, 'a&lt;b &#123;' || lang || '&#125; $x<y$ &amp; `c<{d}` &#123;' || source || ' $$' || chr(10) || 'p<q' || chr(10) || '$$' AS safe FROM documents")
def _(spark, sf):
    return made(spark, sf, "documents", "doc_id", "a<b {", "@lang", "} $x<y$ & `c<{d}` \\{", "@source", " $$\np<q\n$$").select("doc_id", M.escape_text("body").alias("safe"))


@query("FN20_dollar_delimiters", r"""SELECT doc_id, 'in $' || lang || '$ and `\(x\)` q={["\(y\)"]} so' || chr(10) || chr(10) || '$$' || chr(10) || source || chr(10) || '$$' || chr(10) || chr(10) || ' end' AS shown FROM documents""")
def _(spark, sf):
    return made(spark, sf, "documents", "doc_id", r"in \( ", "@lang", r' \) and `\(x\)` q={["\(y\)"]} so \[ ', "@source", r" \]. end").select("doc_id", M.dollar_delimiters("body").alias("shown"))


@query("FN24_cites", """SELECT doc_id, 'see <SourceRef id="' || source || '" /> and <SourceRef id="' || lang || '" /> not `<cite ref="x" />`' AS refs FROM documents""")
def _(spark, sf):
    return made(spark, sf, "documents", "doc_id", 'see <cite ref="', "@source", '">quoted</cite> and <Citation ref_id=\'', "@lang", "' /> not `<cite ref=\"x\" />`").select("doc_id", M.cites_as_refs("body").alias("refs"))


@query("FN25_style_objects", """SELECT doc_id, '<div style={{''borderTop'': ''1px solid ' || lang || ''', ''color'': ''red''}}>' || source || '</div> `style="a: b"` <p style={{}}>' AS shown FROM documents""")
def _(spark, sf):
    return made(spark, sf, "documents", "doc_id", '<div style="border-top: 1px solid ', "@lang", '; bad; color:red;">', "@source", "</div> `style=\"a: b\"` <p style='none'>").select("doc_id", M.style_objects("body").alias("shown"))


@query("FN26_asset_images", """SELECT doc_id, '![' || lang || '](/public-assets/' || source || '.png) ![x](/public-assets/y.png "t") ![z](other/z.png) `![c](public-assets/c.png)`' AS shown FROM documents""")
def _(spark, sf):
    return made(spark, sf, "documents", "doc_id", "![", "@lang", "](public-assets/", "@source", '.png) ![x](/public-assets/y.png "t") ![z](other/z.png) `![c](public-assets/c.png)`').select("doc_id", M.asset_images("body").alias("shown"))


@query("FN57_stray_slots", "SELECT p_partkey, 'Text ' || chr(10) || chr(10) || '   ' AS bare, 'none <QuizBlock></QuizBlock>' AS kept FROM part")
def _(spark, sf):
    pages = made(spark, sf, "part", "p_partkey", *SLOTS)
    wrapped = F.concat("body", L('<QuizBlock>\n<QuizItemSlot topic="a>b" />\n</QuizBlock>\n'))
    return pages.select("p_partkey", M.without_slots(wrapped).alias("bare"), M.without_slots(L("none <QuizBlock></QuizBlock>")).alias("kept"))


@query("FN33_fences_kept", "SELECT doc_id, lang || chr(10) || chr(10) || '```py' || chr(10) || 'a' || chr(10) || chr(10) || chr(10) || 'b' || chr(10) || '```' || chr(10) || chr(10) || source AS tidy FROM documents")
def _(spark, sf):
    return made(spark, sf, "documents", "doc_id", "@lang", "\n\n\n\n```py\na\n\n\nb\n```\n\n\n", "@source").select("doc_id", M.blank_runs("body").alias("tidy"))


@query("FN38_headings", "SELECT doc_id, 1 AS level, lang AS title, 0 AS start FROM documents UNION ALL SELECT doc_id, 3, source, CAST(length(lang) + 27 AS INTEGER) FROM documents")
def _(spark, sf):
    pages = made(spark, sf, "documents", "doc_id", "# ", "@lang", "\n```\n# no\n```\n#none\ntext\n", "### ", "@source", " ##\n")
    return pages.select("doc_id", F.explode(M.headings("body")).alias("h")).select("doc_id", "h.*")


@query("FN32_local_links", """SELECT doc_id, CASE WHEN lang = 'en' THEN '[a](/docs/en#top)' ELSE 'a' END || ' gone [web](https://x.org/y) ![i](/no.png) `[c](/no)`' AS kept FROM documents""")
def _(spark, sf):
    pages = made(spark, sf, "documents", "doc_id", "[a](/docs/", "@lang", "#top) [gone](/docs/x/", "@source", ' "t") [web](https://x.org/y) ![i](/no.png) `[c](/no)`')
    return pages.select("doc_id", M.local_links("body", F.array(L("/docs/en"))).alias("kept"))


@query("FN35_figure_tags", """SELECT p_partkey, 'f"' || p_partkey AS id, '/a/' || p_brand || '.png' AS src, p_name || ' <' || p_type || '> & ''more''' AS caption FROM part""")
def _(spark, sf):
    tag = M.figure_tag(F.concat(L('f"'), "p_partkey"), F.concat(L("/a/"), "p_brand", L(".png")), F.concat("p_name", L(" <"), "p_type", L("> & 'more'")))
    return table(spark, sf, "part").select("p_partkey", F.explode(M.figure_tags(F.concat(L("before "), tag, L(" after")))).alias("f")).select("p_partkey", "f.*")


@query("XC13_known_figures", """SELECT p_partkey, 'a ' || CASE WHEN p_size % 2 = 0 THEN '<BookFigure id="f1" src="/x.png" />' ELSE '' END || ' b' AS body FROM part""")
def _(spark, sf):
    body = F.concat(L('a <BookFigure id="f'), F.when(C("p_size") % 2 == 0, "1").otherwise("2"), L('" src="/x.png" /> b'))
    return table(spark, sf, "part").select("p_partkey", M.known_figures(body, F.array(L("f1"))).alias("body"))


@query("FN44_card_html", r"""SELECT p_partkey, '<b>' || p_name || '</b><br><i>' || p_brand || '</i> <code>' || p_type || '</code> \(a&lt;b\) \[c\] x' AS html FROM part""")
def _(spark, sf):
    face = F.concat(L(" **"), "p_name", L("**\n*"), "p_brand", L("* `"), "p_type", L("` $a<b$ $$c$$ <u>x</u> "))
    return table(spark, sf, "part").select("p_partkey", M.card_html(face).alias("html"))


@query("FN29_term_pattern", "SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])on([^A-Za-z0-9_]|$)') AS mentions FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_like("text", M.quoted(L("on"))).alias("mentions"))


def _preview(name, href, title, summary):
    return F.struct(L(name).alias("term"), L(name.upper()).alias("canonical"), L(href).alias("href"), L(title).alias("title"), L(summary).alias("summary"))


@query("FN27_wikilinks", r"""SELECT doc_id, '# On EN' || chr(10) || CASE lang WHEN 'en' THEN '<PreviewLink href={"/docs/en"} title={"English"} summary={"a \"b\""}>EN</PreviewLink>' ELSE '[[' || CASE lang WHEN 'de' THEN 'German' ELSE lang END || ']]' END || ' `<PreviewLink href={"/docs/en"} title={"English"} summary={"a \"b\""}>EN</PreviewLink>`' AS linked FROM documents""")
def _(spark, sf):
    names = F.create_map(L("en"), L("EN"), L("de"), L("German"))
    previews = F.create_map(L("EN"), F.struct(L("/docs/en").alias("href"), L("English").alias("title"), L('a "b"').alias("summary")))
    return made(spark, sf, "documents", "doc_id", "# On [[en]]\n[[ ", "@lang", " ]] `[[en]]`").select("doc_id", M.wikilinks(C("body"), names, previews).alias("linked"))


@query("FN28_concept_links", r"""SELECT doc_id, '## the heading' || chr(10) || '`the` $the$ ' || regexp_replace(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), '(?i)(^|[^A-Za-z0-9_])(the)([^A-Za-z0-9_]|$)', '\1<PreviewLink href={"/c/the"} title={"The"} summary={"s"}>\2</PreviewLink>\3') AS linked FROM documents""")
def _(spark, sf):
    prose = F.concat(L("## the heading\n`the` $the$ "), F.regexp_replace("text", "[^A-Za-z]+", " "))
    terms = F.array(_preview("the", "/c/the", "The", "s"), _preview("zzzz never", "/c/z", "Z", "z"))
    return table(spark, sf, "documents").select("doc_id", M.concept_links(prose, terms, F.array(L("OTHER"))).alias("linked"))


@query("FN28_links_of_many_terms", r"""SELECT doc_id, '## the heading' || chr(10) || '`the` $the$ ' || regexp_replace(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), '(?i)(^|[^A-Za-z0-9_])(the)([^A-Za-z0-9_]|$)', '\1<PreviewLink href={"/c/the"} title={"The"} summary={"s"}>\2</PreviewLink>\3') AS linked FROM documents""")
def _(spark, sf):
    """Ten thousand terms that stand nowhere, and one that stands in most texts."""
    prose = F.concat(L("## the heading\n`the` $the$ "), F.regexp_replace("text", "[^A-Za-z]+", " "))
    shown = lambda term, href, title, summary: F.struct(term.alias("term"), F.upper(term).alias("canonical"), L(href).alias("href"), L(title).alias("title"), L(summary).alias("summary"))
    number = F.col("id").cast("string")
    terms = spark.range(10_001).select(F.when(F.col("id") == 0, shown(L("the"), "/c/the", "The", "s")).otherwise(shown(F.concat(L("zzzz never "), number), "/c/z", "Z", "z")).alias("t")).select("t.*")
    return linking.linked(table(spark, sf, "documents").select("doc_id", prose.alias("linked")), "doc_id", "linked", terms)


@query("FN21_normalised_maths", r"""
SELECT p_partkey, 'of ' || p_name || CASE p_size % 4 WHEN 0 THEN chr(10) || chr(10) || '$$' || chr(10) || 'x_' || p_size || chr(10) || '$$' || chr(10) || chr(10) || ' end'
  WHEN 1 THEN ' $\tag{3} \text{' || p_brand || '}\theta \mathbf{x}$ ③ `$③$`' WHEN 2 THEN ' $a \\[4pt]' || chr(10) || 'b$ \left| ' ELSE ' q={"\(' || p_type || '\)"} $\left\vert x$' END AS body FROM part""")
def _(spark, sf):
    k = C("p_size") % 4
    tail = (
        F.when(k == 0, F.concat(L(r" \[ x_"), C("p_size").cast("string"), L(r" \]. end")))
        .when(k == 1, F.concat(L(r" \(\tag{③} \text{"), "p_brand", L(r"θ} \\mathbf{x}\) ③ `$③$`")))
        .when(k == 2, L(" $a \\\\\n\n$$\n4pt]\nb$ \\left| "))
        .otherwise(F.concat(L(r' q={"\('), "p_type", L(r'\)"} $\left| x$')))
    )
    return table(spark, sf, "part").select("p_partkey", maths.normalised(F.concat(L("of "), "p_name", tail)).alias("body"))


@query("FN22_display_fences", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || chr(10) || chr(10) || '$$' || chr(10) || p_brand || chr(10) || '= 1' || chr(10) || '$$' || chr(10) || chr(10) || ' so' WHEN 1 THEN p_name || ' $$' || p_brand || '$$ so' WHEN 2 THEN p_name || ' $$' || p_brand || chr(10) || 'odd' ELSE '$$' || chr(10) || p_name || chr(10) || '$$' || chr(10) || 'so' END AS body FROM part""")
def _(spark, sf):
    k = C("p_size") % 4
    body = F.when(k == 0, F.concat("p_name", L(" $$"), "p_brand", L("\n= 1$$ so"))).when(k == 1, F.concat("p_name", L(" $$"), "p_brand", L("$$ so"))).when(k == 2, F.concat("p_name", L(" $$"), "p_brand", L("\nodd"))).otherwise(F.concat(L("$$\n"), "p_name", L("\n$$\nso")))
    return table(spark, sf, "part").select("p_partkey", maths.own_lines(body).alias("body"))


@query("FN23_quote_formulas", r"""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '$\frac{1}{' || p_size || '}$.' WHEN 1 THEN 'Sum of ' || p_name || ': $x_{' || p_size || '} + 1$' WHEN 2 THEN '\frac{1}{2} is ' || p_name ELSE p_name || ' $x_{1}$' END AS quote FROM part""")
def _(spark, sf):
    k, n = C("p_size") % 4, C("p_size").cast("string")
    quote = F.when(k == 0, F.concat(L("\\frac{1}{"), n, L("}."))).when(k == 1, F.concat(L("Sum of "), "p_name", L(": x_{"), n, L("} + 1"))).when(k == 2, F.concat(L("\\frac{1}{2} is "), "p_name")).otherwise(F.concat("p_name", L(" $x_{1}$ ")))
    return table(spark, sf, "part").select("p_partkey", maths.quote_formulas(quote).alias("quote"))
