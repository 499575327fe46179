"""Queries of the split of sources into chapters and of chunking, on markup derived from the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import chunking, split
from folio.operators.relational import coverage
from folio.plans.registry import query
from folio.session import table

C = F.col

CHAPTERS = [
    split.Chapter("ch01", "Thble with thing", ("oning",), ("src1-p0..src1-p400", "src3-p3")),
    split.Chapter("ch02", "Attion", ("erble", "ertion"), ("src2-p100..src2-p90000", "src3-p3", "src3-p23")),
    split.Chapter("ch03", "Thanea from ontion", (), ("src1-p300..src1-p90000",)),
]
_KEYWORDS = {"ch01": ["oning", "thble", "thing"], "ch02": ["attion", "erble", "ertion"], "ch03": ["ontion", "thanea"]}


def _marked(spark, sf):
    """Documents as sources: a mark and the text; in every second one a second mark, in every fifth a chapter's heading."""
    d = table(spark, sf, "documents")
    mark = lambda ref: F.concat(F.lit("<!-- source_ref: "), ref, F.lit(" -->"))
    body = F.concat("text", F.when(C("doc_id") % 5 == 0, "\n## Chapter 2\nmore").otherwise(""))
    second = F.when(C("doc_id") % 2 == 0, F.concat(F.lit("\n"), mark(F.concat("lang", F.lit("-p1"))), F.lit("\n"), "lang")).otherwise("")
    return d.select(C("doc_id").cast("string").alias("path"), F.concat(mark(F.concat("source", F.lit("-p"), C("doc_id").cast("string"))), body, second).alias("text"))


_FRAGMENTS = r"""f AS (SELECT CAST(doc_id AS VARCHAR) AS path, 0 AS pos, source || '-p' || doc_id AS source_ref,
  regexp_replace(text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '## Chapter 2' || chr(10) || 'more' ELSE '' END, '^\s+|\s+$', '', 'g') AS body FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, lang || '-p1', lang FROM documents WHERE doc_id % 2 = 0)"""
_COUNT = lambda words: " + ".join(f"CAST(contains(lower(body), '{w}') AS INTEGER)" for w in words)
_ASSIGNED = _FRAGMENTS + f""", k AS (SELECT *, CAST(regexp_extract(source_ref, '(\\d+)$', 1) AS BIGINT) AS n, {", ".join(f"{_COUNT(w)} AS n_{c}" for c, w in _KEYWORDS.items())} FROM f),
r AS (SELECT *, CASE WHEN source_ref = 'src3-p3' OR source_ref LIKE 'src1-p%' AND n <= 400 THEN 'ch01'
  WHEN source_ref = 'src3-p23' OR source_ref LIKE 'src2-p%' AND n BETWEEN 100 AND 90000 THEN 'ch02' WHEN source_ref LIKE 'src1-p%' AND n BETWEEN 300 AND 90000 THEN 'ch03' END AS by_ref,
  greatest(n_ch01, n_ch02, n_ch03) AS most FROM k),
a AS (SELECT path, pos, source_ref, body, coalesce(by_ref, CASE WHEN most = 0 THEN 'appendix' WHEN n_ch01 = most THEN 'ch01' WHEN n_ch02 = most THEN 'ch02' ELSE 'ch03' END) AS chapter_id,
  CASE WHEN by_ref IS NOT NULL THEN 1.0 WHEN most = 0 THEN 0.0 ELSE least(0.85, 0.35 + most * 0.1) END AS confidence,
  CASE WHEN by_ref IS NOT NULL THEN 'source_ref' WHEN most = 0 THEN 'unassigned' ELSE 'keyword' END AS reason FROM r)"""
_CARRIED = _ASSIGNED + r""", b AS (SELECT path, pos, chapter_id, reason FROM a UNION ALL
  SELECT path, pos, CASE chapter_id WHEN 'ch01' THEN 'ch02' ELSE 'ch03' END, 'boundary' FROM a WHERE chapter_id IN ('ch01', 'ch02') AND contains(body, '## Chapter 2') AND NOT starts_with(body, '## Chapter 2'))"""


@query("CH08_fragments", f"WITH {_FRAGMENTS} SELECT * FROM f WHERE body <> ''")
def _(spark, sf):
    return split.fragments(_marked(spark, sf), "path", "text")


@query("JN03_range_join", f"WITH {_ASSIGNED} SELECT DISTINCT source_ref AS ref, by_ref AS chapter_id FROM r WHERE by_ref IS NOT NULL AND body <> ''")
def _(spark, sf):
    specs = spark.createDataFrame([(c.chapter_id, i, list(c.source_refs)) for i, c in enumerate(CHAPTERS)], "chapter_id string, ord int, source_refs array<string>")
    return split.by_reference(split.fragments(_marked(spark, sf), "path", "text"), "source_ref", specs)


@query("JN04_keyword_fallback", f"WITH {_ASSIGNED} SELECT path, pos, chapter_id, CAST(confidence AS DOUBLE) AS confidence, reason FROM a WHERE body <> ''")
def _(spark, sf):
    parts = split.fragments(_marked(spark, sf), "path", "text")
    return split.assign(parts, CHAPTERS).select("path", "pos", "chapter_id", "confidence", "reason")


@query("JN05_boundary_carry", f"WITH {_CARRIED} SELECT b.* FROM b JOIN f USING (path, pos) WHERE body <> ''")
def _(spark, sf):
    assigned = split.assign(split.fragments(_marked(spark, sf), "path", "text"), CHAPTERS)
    return split.carry(assigned, CHAPTERS).select("path", "pos", "chapter_id", "reason")


@query("CH09_split_report", f"""WITH {_CARRIED}, g AS (SELECT path, pos, max(CASE WHEN chapter_id <> 'appendix' THEN 1 ELSE 0 END) AS got FROM b JOIN f USING (path, pos) WHERE body <> '' GROUP BY ALL)
SELECT count(*) AS total, CAST(sum(got) AS BIGINT) AS assigned, CAST(count(*) - sum(got) AS BIGINT) AS unassigned, round_even(CAST(sum(got) AS DOUBLE) / count(*), 4) AS ratio FROM g""")
def _(spark, sf):
    assigned = split.assign(split.fragments(_marked(spark, sf), "path", "text"), CHAPTERS)
    return coverage(split.carry(assigned, CHAPTERS), ["path", "pos"], C("chapter_id") != "appendix")


@query("CH09_chapter_texts", f"""WITH {_CARRIED}
SELECT b.chapter_id, path, pos, '<!-- source_ref: ' || source_ref || ' -->' || chr(10) || chr(10) || body AS block FROM b JOIN f USING (path, pos) WHERE body <> ''
UNION ALL SELECT * FROM (VALUES ('ch01', '', -1, '# Thble with thing'), ('ch02', '', -1, '# Attion'), ('ch03', '', -1, '# Thanea from ontion'), ('appendix', '', -1, '# Appendix'))""")
def _(spark, sf):
    assigned = split.assign(split.fragments(_marked(spark, sf), "path", "text"), CHAPTERS)
    return split.chapter_texts(split.carry(assigned, CHAPTERS), CHAPTERS)


def _pages(spark, sf):
    """Pages as Markdown: headings and paragraphs become headings of two levels."""
    body = F.regexp_replace(F.regexp_replace("html", r"(?i)<h1[^>]*>", "\n# "), r"(?i)<p[^>]*>", "\n\n## ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?i)</(?:h1|p)>", "\n\n"), r"<[^>]*>", " ")
    return table(spark, sf, "pages").select(C("page_id").alias("id"), C("url").alias("title"), F.lit("ch01").alias("chapter_id"), F.when(C("page_id") % 2 == 0, C("url")).alias("summary"), body.alias("body"), F.array().cast("array<string>").alias("source_refs"))


@query("CH01_rag_chunks")
def _(spark, sf):
    return chunking.rag_chunks(_pages(spark, sf))


@query("WN04_heading_paths")
def _(spark, sf):
    return _pages(spark, sf).select("id", F.posexplode(chunking.sections(C("body"))).alias("pos", "s")).select("id", "pos", "s.heading_path", "s.slug")


@query("CH02_packed_paragraphs")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(chunking.packed(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("pos", "part"))


@query("CH04_budgeted_chunks")
def _(spark, sf):
    return chunking.budgeted(_pages(spark, sf), "id", "body", budget=200)
