"""Queries of retrieval: documents are the chunks, embeddings their vectors, vector 0 the query's."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from folio.operators import gram_index as G
from folio.operators import retrieval as R
from folio.plans.registry import query
from folio.session import shared_folder, table, version_of

C = F.col
QUERY = "ation ering"


def _vector(spark, sf):
    return list(table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first().embedding)


def _docs(spark, sf):
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id")


def _index(spark, sf):
    """The trigram index of documents: written at its first use, then opened as long as the table's files stay the same."""
    docs = _docs(spark, sf)
    folder = f"{shared_folder(spark)}/folio/gram-index2-{version_of(spark, f'{sf}/documents.parquet')}"
    try:
        return G.opened(spark, folder)
    except AnalysisException:  # there is none yet
        return G.build(docs, folder)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(C("vec_id").alias("row_id"), "embedding")


def _bm25_sql(terms: list[str]) -> str:
    count = lambda t: f"CAST((length(x) - length(replace(x, '{t}', ''))) / {len(t)} AS INTEGER)"
    tf = ", ".join(f"{count(t)} AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    idf = lambda i: f"(CASE WHEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) > 0 THEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END)"
    part = lambda i: f"{idf(i)} * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / mean))"
    return f"""bm_t AS (SELECT doc_id, d, {tf} FROM (SELECT doc_id, lower(text) AS x, greatest(length(text) - 2, 0) AS d FROM documents)),
bm_s AS (SELECT count(*) AS n, avg(d) AS mean, {df} FROM bm_t),
bm AS (SELECT doc_id AS row_id, {' + '.join(part(i) for i in range(len(terms)))} AS score FROM bm_t, bm_s WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(terms)))})"""


_DOTS = """q AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings WHERE vec_id = 0),
vx AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS y FROM embeddings),
dots AS (SELECT vec_id AS row_id, sum(CAST(x AS DOUBLE) * CAST(y AS DOUBLE)) AS score FROM vx JOIN q USING (i) GROUP BY vec_id)"""


def _rank_sql(name: str, source: str, n: int) -> str:
    return f"{name} AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM {source} QUALIFY rank <= {n})"


@query("RT03_bm25", f"WITH {_bm25_sql(['ation', 'ering'])} SELECT row_id, score FROM bm")
def _(spark, sf):
    return G.bm25(_index(spark, sf), QUERY)


@query("TK02_bm25_top", f"WITH {_bm25_sql(['ation', 'ering'])}, {_rank_sql('r', 'bm', 32)} SELECT row_id, CAST(rank AS INTEGER) AS rank FROM r")
def _(spark, sf):
    return R.ranked(G.bm25(_index(spark, sf), QUERY), "row_id", 32)


@query("RT03_gram_index", """
SELECT gram, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS places FROM (SELECT doc_id, gram, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS gram FROM documents WHERE length(text) >= 3) GROUP BY ALL) GROUP BY gram""")
def _(spark, sf):
    return G.dictionary(_index(spark, sf)).withColumn("gram", G.gram_text(C("gram")))


@query("RT04_like_fallback", "SELECT doc_id AS row_id, CAST(0 AS DOUBLE) AS score FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'é ')")
def _(spark, sf):
    return R.like(_docs(spark, sf), "é ", "row_id", "text")


@query("RT04_short_query_by_index", "SELECT doc_id AS row_id, CAST(0 AS DOUBLE) AS score FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%')")
def _(spark, sf):
    return G.holding(_index(spark, sf), _docs(spark, sf), "%")


@query("PF02_like_scan", "SELECT doc_id AS row_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'licensed under') ORDER BY doc_id LIMIT 32")
def _(spark, sf):
    return G.holding(_index(spark, sf), _docs(spark, sf), "LICENSED under").orderBy("row_id").limit(32).select("row_id")


@query("RT06_dot", f"WITH {_DOTS} SELECT row_id, score FROM dots")
def _(spark, sf):
    return R.nearest(_vectors(spark, sf), _vector(spark, sf), "row_id", "embedding")


@query("RT07_normalise", "SELECT vec_id, sqrt(sum((CAST(x AS DOUBLE) * 3 / n) ** 2)) AS length FROM (SELECT vec_id, unnest(embedding) AS x, 3 * sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS n FROM embeddings) GROUP BY vec_id")
def _(spark, sf):
    unit = R.normalised(F.transform("embedding", lambda x: x * 3))
    return table(spark, sf, "embeddings").select("vec_id", F.sqrt(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x)).alias("length"))


@query("TK01_vector_top", f"WITH {_DOTS}, {_rank_sql('r', 'dots', 32)} SELECT row_id, CAST(rank AS INTEGER) AS rank FROM r")
def _(spark, sf):
    return R.ranked(R.nearest(_vectors(spark, sf), _vector(spark, sf), "row_id", "embedding"), "row_id", 32)


_FUSED = f"""WITH {_bm25_sql(['ation', 'ering'])}, {_DOTS}, {_rank_sql('k', 'bm', 32)}, {_rank_sql('v', 'dots', 32)},
u AS (SELECT row_id, rank, 0 AS l FROM k UNION ALL SELECT row_id, rank, 1 AS l FROM v),
f AS (SELECT row_id, sum(1 / (60::DOUBLE + rank)) AS score, min(l * 1000 + rank) AS first FROM u GROUP BY row_id)"""


@query("RT05_rrf", _FUSED + " SELECT row_id, score FROM f")
def _(spark, sf):
    lists = [R.ranked(G.bm25(_index(spark, sf), QUERY), "row_id", 32), R.ranked(R.nearest(_vectors(spark, sf), _vector(spark, sf), "row_id", "embedding"), "row_id", 32)]
    return R.fuse(lists, "row_id").select("row_id", "score")


@query("RT01_hybrid_search", _FUSED + """, t AS (SELECT row_id, score, row_number() OVER (ORDER BY score DESC, first) AS place FROM f QUALIFY place <= 8)
SELECT CAST(place AS INTEGER) AS place, row_id, score, lang, source, text FROM t JOIN documents ON row_id = doc_id""")
def _(spark, sf):
    found = R.hybrid(_docs(spark, sf), _vectors(spark, sf), QUERY, _vector(spark, sf), index=_index(spark, sf))
    return found.select("place", "row_id", "score", "lang", "source", "text")


@query("PF01_chapter_filter", f"""WITH {_bm25_sql(['ation', 'ering'])}, a AS (SELECT doc_id AS row_id FROM documents WHERE source = 'src1'), b AS (SELECT * FROM bm SEMI JOIN a USING (row_id)), {_rank_sql('k', 'b', 32)}
SELECT CAST(rank AS INTEGER) AS place, row_id, 1 / (60::DOUBLE + rank) AS score FROM k WHERE rank <= 8""")
def _(spark, sf):
    return R.hybrid(_docs(spark, sf), None, QUERY, None, where=C("source") == "src1", index=_index(spark, sf)).select("place", "row_id", "score")


@query("RT12_search_api", _FUSED + """, t AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, first) AS place FROM f QUALIFY place <= 8), s AS (SELECT place, source FROM t JOIN documents ON row_id = doc_id)
SELECT CAST(min(place) AS INTEGER) AS place, 'page' AS kind, source FROM s GROUP BY source UNION ALL SELECT CAST(place AS INTEGER), 'text', source FROM s""")
def _(spark, sf):
    return R.search_results(R.hybrid(_docs(spark, sf), _vectors(spark, sf), QUERY, _vector(spark, sf), index=_index(spark, sf)), "source")


@query("RT13_grounding", _FUSED + """, t AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, first) AS place FROM f QUALIFY place <= 4)
SELECT string_agg(text, chr(10) || '---' || chr(10) ORDER BY place) AS body FROM t JOIN documents ON row_id = doc_id""")
def _(spark, sf):
    found = R.hybrid(_docs(spark, sf), _vectors(spark, sf), QUERY, _vector(spark, sf), index=_index(spark, sf), limit=8).where("place <= 4")
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return found.agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n---\n").alias("body"))


@query("RT18_citations", "SELECT doc_id, 's:' || source || '-p' || doc_id || ',p:chapters/' || lang || ',s:' || source AS tokens FROM documents")
def _(spark, sf):
    ref = F.concat(C("source"), F.lit("-p"), C("doc_id").cast("string"))
    text = F.concat(F.lit("see ["), ref, F.lit("] and [^page:docs/chapters/"), C("lang"), F.lit("#chunk-003, ^"), C("source"), F.lit("] but [^not this one] nor [^1]: x ["), ref, F.lit("](url)"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(R.citations(text), ",").alias("tokens"))


@query("RT11_search_meta", "SELECT count(*) AS vectors, min(len(embedding)) AS dim FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).cast("long").alias("dim"))


@query("RT14_article_cap", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '[truncated]' ELSE text END AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.length("text") > 500, F.concat(F.substring("text", 1, 500), F.lit("\n[truncated]"))).otherwise(C("text")).alias("text"))
