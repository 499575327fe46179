"""Queries of nested values. The values are made of whole texts, five levels deep, by Spark's JSON writer; SQL states what comes out."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import nested
from folio.plans.registry import query
from folio.session import table

C, L = F.col, F.lit


@query("XB08_citations_at_any_depth", """
SELECT doc_id, 0 AS n, '"' || source || '"' AS ref_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 - doc_id % 2, source || 'A' FROM documents
UNION ALL SELECT doc_id, 2 - doc_id % 2, text FROM documents UNION ALL SELECT doc_id, 3 - doc_id % 2, CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 3 = 0""")
def _(spark, sf):
    """The escape of the second one is written as such; names that only look like references, and refs without a quote, don't count."""
    cite = lambda ref: F.struct(L(None).cast("string").alias("quote"), ref.alias("ref_id"))
    head = F.when(C("doc_id") % 2 == 0, cite(F.concat(L('"'), "source", L('"')))).otherwise(F.struct(L(None).cast("string").alias("quote"), L(None).cast("string").alias("ref_id")))
    deep = F.struct(F.array(F.struct(F.struct(cite(C("text")).alias("z"), C("source").alias("ref_id")).alias("y"))).alias("x"), C("lang").alias("ref_id"))
    last = F.when(C("doc_id") % 3 == 0, F.concat(L('{"ref_id":'), C("doc_id").cast("string"), L(',"quote":{"ref_id":"only"}}'))).otherwise('{"quote":"only"}')
    written = F.concat(L('{"quote":"q","ref_id":"'), "source", L('\\u0041"}'))
    body = F.concat(L('[{"m":'), F.to_json(head, {"ignoreNullFields": "false"}), L(',"b":['), written, L(',{"c":{"d":'), F.to_json(deep, {"ignoreNullFields": "false"}), L('}}]},'), last, L("]"))
    rows = table(spark, sf, "documents").select("doc_id", F.replace(body, L('"m":{"quote":null,"ref_id":null}'), L('"m":{"quote":null}')).alias("body"))
    return nested.cited_refs(rows, "doc_id", "body").withColumn("n", C("n").cast("long"))


@query("FN18_compacted_values", """
WITH d AS (SELECT doc_id, lang, text, greatest(1, length(text) // 3) AS tokens FROM documents)
SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS number, CASE WHEN tokens <= 50 THEN text ELSE substr(text, 1, CAST(greatest(1, floor(length(text) * 50 / tokens * 0.97::DOUBLE)) AS INTEGER)) || chr(10) || chr(10) || '[truncated]' END AS deep FROM d""")
def _(spark, sf):
    value = F.struct(C("lang").alias("z"), F.array(F.struct(F.struct(F.array(F.struct(C("text").alias("t"), C("doc_id").alias("n"))).alias("c")).alias("b"))).alias("a"))
    rows = table(spark, sf, "documents").select("doc_id", F.to_json(value).alias("body"))
    cut = nested.compacted(rows, "doc_id", "body", 50)
    return cut.select("doc_id", F.get_json_object("json", "$.z").alias("lang"), F.get_json_object("json", "$.a[0].b.c[0].n").alias("number"), F.get_json_object("json", "$.a[0].b.c[0].t").alias("deep"))


@query("FN36_block_texts", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN 'see $' || p_brand || '$and ' || p_size WHEN 2 THEN '$$' || chr(10) || p_type || chr(10) || '$$' || chr(10) || p_name WHEN 3 THEN '- ' || p_name || chr(10) || '- ' || p_type ELSE p_name || p_brand || chr(10) || 'foot' END AS text FROM part""")
def _(spark, sf):
    q = lambda c: F.regexp_extract(F.to_json(F.struct(C(c).alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    k = C("p_size") % 5
    body = (
        F.when(k == 0, F.concat(L('{"type":"text","md":'), q("p_name"), L("}")))
        .when(k == 1, F.concat(L('{"type":"paragraph","content":{"paragraph_content":["see ",{"type":"inline_equation","content":'), q("p_brand"), L('},{"content":[" and ",'), C("p_size").cast("string"), L("]}]}}")))
        .when(k == 2, F.concat(L('{"category":"note","content":{"html":'), q("p_name"), L(',"math_content":'), q("p_type"), L(',"math_type":"display"}}')))
        .when(k == 3, F.concat(L('{"type":"list","list_items":['), q("p_name"), L(","), q("p_type"), L('],"text":"no"}')))
        .otherwise(F.concat(L('{"type":"image","content":{"image_footnote":"foot","image_caption":[{"text":'), q("p_name"), L('},{"value":{"latex":'), q("p_brand"), L("}}]}}")))
    )
    return nested.block_text(table(spark, sf, "part").select("p_partkey", body.alias("body")), "p_partkey", "body")


@query("FN37_math_texts", """
SELECT p_partkey, p_name AS bare, CASE WHEN p_size % 4 = 0 THEN '$' || p_name || '$' WHEN p_size % 4 = 1 THEN '$$' || chr(10) || p_name || chr(10) || '$$' WHEN p_size % 4 = 2 THEN '$$' || chr(10) || 'a' || chr(10) || p_name || chr(10) || '$$' ELSE '$' || p_name || '$' END AS shown FROM part""")
def _(spark, sf):
    k = C("p_size") % 4
    around = F.when(k == 0, F.concat(L("$$ "), "p_name", L(" $$"))).when(k == 1, F.concat(L("\\["), "p_name", L("\\]"))).when(k == 2, F.concat(L(" $"), "p_name", L("$"))).otherwise(F.concat(L("\\( "), "p_name", L("\\) \n")))
    given = F.when(k == 2, F.concat(L("a\n"), "p_name")).otherwise(around)
    kind = F.when(k == 0, "inline").when(k == 1, "Display")
    return table(spark, sf, "part").select("p_partkey", nested.bare_math(around).alias("bare"), nested.math_text(given, kind, L("text")).alias("shown"))
