"""Queries of registry edits, each on books of a few edits, and of small page and ranking operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.functions import text as T
from folio.operators import concepts as K
from folio.operators import items as I
from folio.operators import retrieval as R
from folio.plans.markup import made
from folio.plans.registry import query
from folio.session import table

C, L = F.col, F.lit

_EDIT = "struct<chapter: string, op: string, name: string, other: string, aliases: array<string>, into: array<struct<canonical: string, aliases: array<string>>>>"


def _edit(chapter, op, name, other=None, aliases=(), into=()):
    parts = F.array(*(F.struct(n.alias("canonical"), F.array(*a).cast("array<string>").alias("aliases")) for n, a in into)) if into else F.array()
    return F.struct(L(chapter).alias("chapter"), L(op).alias("op"), name.alias("name"), (other if other is not None else L(None).cast("string")).alias("other"), F.array(*aliases).cast("array<string>").alias("aliases"), parts.alias("into")).cast(_EDIT)


def _folded(spark, sf, *edits):
    """The registry of each part's own book after the edits, chapters c1, c2 … in order of their first edit."""
    rows = table(spark, sf, "part").select(C("p_partkey").cast("string").alias("book"), F.posexplode(F.array(*edits)).alias("op_ord", "e"))
    rows = rows.select("book", "op_ord", "e.*").withColumn("chapter_ord", F.substring("chapter", 2, 9).cast("int"))
    found = K.fold_registry(rows)
    return found.select(C("book").cast("long").alias("p_partkey"), "ord", "canonical", F.array_join("aliases", "|").alias("aliases"), "first_chapter")


@query("XA01_add_concept", "SELECT p_partkey, CAST(0 AS INTEGER) AS ord, p_name AS canonical, p_brand AS aliases, 'c1' AS first_chapter FROM part")
def _(spark, sf):
    return _folded(spark, sf, _edit("c1", "add_concept", C("p_name")), _edit("c2", "add_concept", F.upper(C("p_name")), aliases=[C("p_brand"), C("p_name")]))


@query("XA02_add_alias", "SELECT p_partkey, CAST(0 AS INTEGER) AS ord, p_name AS canonical, p_brand AS aliases, 'c1' AS first_chapter FROM part")
def _(spark, sf):
    return _folded(spark, sf, _edit("c1", "add_concept", C("p_name")), _edit("c1", "add_alias", C("p_name"), C("p_brand")), _edit("c1", "add_alias", L("nowhere"), L("x")), _edit("c2", "add_alias", C("p_name"), L("  ")))


@query("XA03_rename", "SELECT p_partkey, CAST(0 AS INTEGER) AS ord, p_brand AS canonical, p_name AS aliases, 'c1' AS first_chapter FROM part")
def _(spark, sf):
    return _folded(spark, sf, _edit("c1", "add_concept", C("p_name")), _edit("c2", "add_concept", C("p_brand")), _edit("c3", "rename_canonical", C("p_name"), C("p_brand")))


@query("XA04_merge", "SELECT p_partkey, CAST(0 AS INTEGER) AS ord, p_brand AS canonical, p_name || '|old' AS aliases, 'c1' AS first_chapter FROM part")
def _(spark, sf):
    return _folded(spark, sf, _edit("c1", "add_concept", C("p_name"), aliases=[L("old")]), _edit("c2", "add_concept", C("p_brand")), _edit("c3", "merge", C("p_brand"), C("p_name")))


@query("XA05_split", """
SELECT p_partkey, CAST(0 AS INTEGER) AS ord, 'half' AS canonical, 'old' AS aliases, 'c1' AS first_chapter FROM part UNION ALL SELECT p_partkey, 1, p_brand, '', 'c2' FROM part""")
def _(spark, sf):
    return _folded(spark, sf, _edit("c1", "add_concept", C("p_name"), aliases=[L("old")]), _edit("c2", "add_concept", C("p_brand")), _edit("c3", "split", C("p_name"), into=[(L("half"), [L("old")])]))


@query("XA06_resolve_by_alias", "SELECT p_partkey, CAST(0 AS INTEGER) AS ord, p_name AS canonical, 'old|' || p_brand AS aliases, 'c1' AS first_chapter FROM part")
def _(spark, sf):
    return _folded(spark, sf, _edit("c1", "add_concept", C("p_name"), aliases=[L("old")]), _edit("c1", "add_alias", L("O-L-D"), C("p_brand")))


@query("JN08_resolved_figures", """SELECT p_partkey, 'a <BookFigure id="f1" src="/' || p_brand || '.png" />  b' AS body FROM part""")
def _(spark, sf):
    index = F.create_map(L("f1"), F.concat(L('<BookFigure id="f1" src="/'), C("p_brand"), L('.png" />')))
    return table(spark, sf, "part").select("p_partkey", M.resolved_figures(L('a <BookFigure id="f1" /> <BookFigure id="made-up" src="x" /> b'), index).alias("body"))


@query("PF13_features", """SELECT doc_id, TRUE AS frontmatter, doc_id % 2 = 0 AS quiz, FALSE AS cards, TRUE AS sources, TRUE AS refs FROM documents""")
def _(spark, sf):
    text = F.concat(L("---\ntitle: "), "lang", L("\n---\n"), F.when(C("doc_id") % 2 == 0, "<QuizBlock>").otherwise("<Quiz>"), L("\n## Sources\n<SourceRef id='x' />"))
    return table(spark, sf, "documents").select("doc_id", M.features(text).alias("f")).select("doc_id", "f.*")


@query("PF16_first_paragraph", "SELECT doc_id, lang || ' and ' || source AS summary FROM documents")
def _(spark, sf):
    return made(spark, sf, "documents", "doc_id", "# Title\n\n\n ", "@lang", "\n and ", "@source", " \n\nmore").select("doc_id", M.first_paragraph("body").alias("summary"))


@query("SO02_refs_of_text", "SELECT doc_id, CAST(CASE WHEN source || '-p1' = lang THEN 1 ELSE 2 END AS INTEGER) AS n FROM documents")
def _(spark, sf):
    pages = made(spark, sf, "documents", "doc_id", "<!-- source_ref: ", "@source", "-p1 -->x<!-- source_ref: ", "@source", "-p1 -->\n- `", "@lang", "`: q")
    return pages.select("doc_id", F.size(T.source_refs(C("body"))).alias("n"))


@query("SO10_distinct_citations", "SELECT p_partkey, 'a:q|a:' || p_brand || '|b:q' AS cited FROM part")
def _(spark, sf):
    cited = F.from_json(F.concat(L('[{"ref_id": "a", "quote": "q"}, {"ref_id": " a ", "quote": "'), C("p_brand"), L('"}, {"ref_id": "a", "quote": "q "}, {"ref_id": "b", "quote": "q"}]')), I.CITATIONS)
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(I.distinct_citations(cited), lambda c: F.concat(c["ref_id"], L(":"), c["quote"])), "|").alias("cited"))


@query("XG02_highlights", "SELECT conv_id, string_agg(role, '|' ORDER BY turn, role) AS texts FROM conversations GROUP BY conv_id")
def _(spark, sf):
    found = I.highlights(table(spark, sf, "conversations"), "conv_id", "turn", "role")
    return found.select("conv_id", F.array_join("texts", "|").alias("texts"))


@query("RT08_packed_vectors", "SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS bytes, TRUE AS same FROM embeddings")
def _(spark, sf):
    blobs = table(spark, sf, "embeddings").select("vec_id", "embedding", R.packed(C("embedding")).alias("blob"))
    return blobs.select("vec_id", F.length("blob").alias("bytes"), (R.unpacked(C("blob")) == C("embedding")).alias("same"))


@query("TK04_fused_order", """
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 40), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 97 DESC, doc_id) AS rank FROM documents QUALIFY rank <= 40),
u AS (SELECT doc_id, 1 / (CAST(60 AS DOUBLE) + rank) AS part, 0 AS list, rank FROM a UNION ALL SELECT doc_id, 1 / (CAST(60 AS DOUBLE) + rank), 1, rank FROM b),
f AS (SELECT doc_id, sum(part) AS score, min(list * 1000 + rank) AS first FROM u GROUP BY doc_id)
SELECT CAST(row_number() OVER (ORDER BY round(score, 12) DESC, first) AS INTEGER) AS place, doc_id FROM f""")
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id")
    lists = [R.ranked(docs.select("row_id", score.cast("double").alias("score")), "row_id", 10 * R.OVERFETCH) for score in (C("n_chars"), C("row_id") % 97)]
    fused = R.fuse(lists, "row_id").select("row_id", F.round("score", 12).alias("score"), "first")
    return fused.select(F.row_number().over(Window.orderBy(F.desc("score"), "first")).alias("place"), C("row_id").alias("doc_id"))  # at most two lists of 40
