"""Queries of restored runs, recorded uses, embedding requests and searches joined with their chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import embedding, gram_index, restore
from folio.operators.concepts import alias_map
from folio.plans.registry import query
from folio.plans.retrieval import QUERY, _bm25_sql, _docs, _index
from folio.session import table

C, L = F.col, F.lit
#: A book is a customer, a chapter an order; some books kept no order but titles, some nothing, some have a folder more.
_STATE = """f AS (SELECT o_custkey AS book, CAST(o_orderkey AS VARCHAR) AS chapter_id, o_orderstatus AS path, o_custkey % 5 AS k, o_totalprice AS price FROM orders),
o AS (SELECT book, chapter_id, -price AS ord FROM f WHERE k < 3 AND NOT (k = 1 AND chapter_id LIKE '%7')), t AS (SELECT book, chapter_id, price AS ord FROM f WHERE k = 3),
n AS (SELECT * FROM o UNION ALL SELECT * FROM t), stale AS (SELECT book, chapter_id FROM f WHERE k < 4 AND chapter_id NOT IN (SELECT chapter_id FROM n) AND book IN (SELECT book FROM n)), lost AS (SELECT DISTINCT book FROM f WHERE book NOT IN (SELECT book FROM n))"""


def _state(spark, sf):
    folders = table(spark, sf, "orders").select(C("o_custkey").alias("book"), C("o_orderkey").cast("string").alias("chapter_id"), C("o_orderstatus").alias("path"), (C("o_custkey") % 5).alias("k"), C("o_totalprice").alias("price"))
    order = folders.where("k < 3 AND NOT (k = 1 AND chapter_id LIKE '%7')").select("book", (-C("price")).alias("ord"), "chapter_id")
    gone = folders.where("k = 0").select("book", L(0.5).alias("ord"), F.concat(L("gone-"), "chapter_id").alias("chapter_id"))
    return restore.split_state(folders.drop("k", "price"), order.unionByName(gone), folders.where("k IN (2, 3)").select("book", C("price").alias("ord"), "chapter_id"))


@query("SC23_split_state", f"WITH {_STATE} SELECT f.book, CAST(row_number() OVER (PARTITION BY f.book ORDER BY n.ord) AS INTEGER) AS place, f.chapter_id, path FROM f JOIN n ON n.book = f.book AND n.chapter_id = f.chapter_id WHERE f.book NOT IN (SELECT book FROM stale)")
def _(spark, sf):
    return _state(spark, sf).chapters


@query("SC23_split_faults", f"WITH {_STATE} SELECT book, chapter_id, 'not in the chapter order, run the split again' AS fault FROM stale UNION ALL SELECT book, '', 'no chapter order, run the split again' FROM lost")
def _(spark, sf):
    return _state(spark, sf).faults


@query("XF05_restart_stage", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' AND o_orderpriority NOT LIKE '1%' AND o_totalprice > 1000 THEN 'caption' ELSE 'convert' END AS stage FROM orders")
def _(spark, sf):
    stop = F.when(C("o_orderpriority").startswith("1"), "convert").when(C("o_orderpriority").startswith("2"), "check")
    return table(spark, sf, "orders").select("o_orderkey", restore.restart_stage(C("o_orderstatus") != "P", stop, C("o_totalprice") > 1000).alias("stage"))


@query("XF04_scale", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size ELSE CAST(round(p_size / 21.6::DOUBLE + 10 / 3.2::DOUBLE) AS INTEGER) END AS sections, CASE WHEN p_size % 6 = 0 THEN p_size + 1 ELSE CAST(round_even(CASE WHEN p_size % 3 = 0 THEN p_size ELSE round(p_size / 21.6::DOUBLE + 10 / 3.2::DOUBLE) END * 3.5::DOUBLE, 0) AS INTEGER) END AS concepts,
CAST(round_even(p_size * 0.114::DOUBLE, 0) AS INTEGER) AS images, CASE WHEN p_size % 3 = 0 THEN 'structure' ELSE 'input scan' END AS basis FROM part""")
def _(spark, sf):
    counted = F.when(C("p_size") % 3 == 0, C("p_size"))
    graph = F.when(C("p_size") % 6 == 0, C("p_size") + 1).when(C("p_size") % 6 == 3, L(0))
    return table(spark, sf, "part").select("p_partkey", restore.scale(counted, graph, C("p_size"), C("p_size"), L(10)).alias("s")).select("p_partkey", "s.*")


@query("CH14_recorded_uses", """
WITH v AS (SELECT n_name, n_nationkey FROM nation), u AS (SELECT l_orderkey, l_suppkey % 30 AS k, l_partkey AS ord FROM lineitem), m AS (SELECT l_orderkey, n_name, min(ord) AS ord FROM u JOIN v ON n_nationkey = k GROUP BY ALL)
SELECT l_orderkey AS chapter_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY ord, n_name) AS INTEGER) AS place, n_name AS canonical FROM m""")
def _(spark, sf):
    entries = table(spark, sf, "nation").select(C("n_name").alias("canonical"), F.array(F.concat(L("Nation No. "), "n_nationkey")).alias("aliases"), C("n_nationkey").alias("ord"))
    uses = table(spark, sf, "lineitem").select(L("b").alias("book"), C("l_orderkey").alias("chapter_id"), C("l_partkey").alias("ord"), F.concat(L("NATION-no "), C("l_suppkey") % 30).alias("name"))
    return restore.recorded_uses(uses, alias_map(entries, "ord").withColumn("book", L("b"))).drop("book")


@query("RT09_embedded", "SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4) AS tokens, 16 AS dim, TRUE AS unit FROM documents")
def _(spark, sf):
    """One text a request, so that the tokens are each text's own."""
    made = embedding.embedded(table(spark, sf, "documents"), "doc_id", "text", embedding.hash_embedder(), request=1)
    norm = F.sqrt(F.aggregate("embedding", L(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return made.select("doc_id", "tokens", F.size("embedding").alias("dim"), (F.abs(norm - 1) < 1e-6).alias("unit"))


@query("JN02_found_chunks", f"WITH {_bm25_sql(['ation', 'ering'])} SELECT row_id, score, lang, source, length(text) AS size FROM bm JOIN documents ON doc_id = row_id")
def _(spark, sf):
    return gram_index.bm25(_index(spark, sf), QUERY).join(_docs(spark, sf), "row_id").select("row_id", "score", "lang", "source", F.length("text").cast("long").alias("size"))
