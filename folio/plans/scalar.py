"""Queries of the text functions and of predicates: one projection over a whole table each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.plans.registry import query
from folio.session import table

C = F.col


def _project(name: str, source: str, keys: str, spark_columns: Callable[[], dict[str, Column]], sql: str, where: Callable[[], Column] | None = None) -> None:
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, source)
        rows = rows if where is None else rows.where(where())
        return rows.select(*keys.split(), *(c.alias(n) for n, c in spark_columns().items()))

    query(name, sql)(run)


_REF = lambda: F.concat(C("source"), F.lit("-p"), C("doc_id").cast("string"))
_EITHER = lambda: F.concat(C("source"), F.when(C("doc_id") % 2 == 0, "-p").otherwise("-slide"), C("doc_id").cast("string"))
_MARKED = lambda: F.concat(F.lit("<!-- source_ref: "), _REF(), F.lit(" -->\n- `note-"), C("lang"), F.lit("`: see <SourceRef id=\"src0-p1\" />\n"), C("text"))
#"'<!-- source_ref: ' || source || '-p' || doc_id || ' -->' || chr(10) || '- `note-' || lang || '`: see <SourceRef id=\"src0-p1\" />' || chr(10) || text"

_project("FN01_concept_key", "documents", "doc_id", lambda: {"key": T.concept_key(C("text"))}, r"SELECT doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g') AS key FROM documents")
_project("FN02_brief", "part", "p_partkey", lambda: {"brief": T.brief(C("p_name"), F.split("p_type", " "))}, "SELECT p_partkey, substr(p_name || '：' || array_to_string(list_slice(string_split(p_type, ' '), 1, 3), '、'), 1, 80) AS brief FROM part")
_project("FN04_clean_markdown", "documents", "doc_id", lambda: {"clean": T.clean_markdown(F.replace("text", F.lit("\n"), F.lit(" \r\n\n\n")))}, r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(10), ' ' || chr(10) || chr(10) || chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents")
_project("FN05_source_id", "pages", "page_id", lambda: {"source_id": T.source_id_from_stem(C("url"))}, r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'source') AS source_id FROM pages")
_project("FN06_ref_parts", "documents", "doc_id", lambda: {"source_id": T.ref_source(_EITHER()), "page": F.coalesce(T.ref_page(_EITHER()), F.lit(-1)), "slide": F.coalesce(T.ref_slide(_EITHER()), F.lit(-1))}, "SELECT doc_id, source AS source_id, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE -1 END AS INTEGER) AS page, CAST(CASE WHEN doc_id % 2 = 1 THEN doc_id ELSE -1 END AS INTEGER) AS slide FROM documents")
_project("FN07_source_refs", "documents", "doc_id", lambda: {"refs": F.array_join(T.source_refs(_MARKED()), ",")}, "SELECT doc_id, CASE WHEN source || '-p' || doc_id = 'src0-p1' THEN 'src0-p1,note-' || lang ELSE source || '-p' || doc_id || ',src0-p1,note-' || lang END AS refs FROM documents")
_project("FN12_title", "pages", "page_id", lambda: {"title": F.coalesce(F.nullif(F.regexp_extract(F.replace(F.replace("html", F.lit("<h1>"), F.lit("\n# ")), F.lit("</h1>"), F.lit("\n")), r"(?m)^#[ \t]+(.+?)[ \t]*$", 1), F.lit("")), C("url"))}, r"SELECT page_id, coalesce(nullif(trim(regexp_extract(replace(replace(html, '<h1>', chr(10) || '# '), '</h1>', chr(10)), '(?m)^#[ \t]+(.+?)[ \t]*$', 1)), ''), url) AS title FROM pages")
_project("FN13_plain_text", "documents", "doc_id", lambda: {"plain": T.plain_text(F.concat(F.lit("<QuizBlock a=\"b>c\"><QuizItem/>q</QuizBlock><Note level=\"1>0\">"), C("text"), F.lit("</Note>\n---\n<!-- source_ref: x -->")))}, r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\s*---\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS plain FROM documents")
_project("FN14_section_slug", "part", "p_partkey", lambda: {"slug": T.section_slug(F.concat_ws(" / ", "p_name", "p_brand"))}, "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
_project("FN15_token_count", "documents", "doc_id", lambda: {"tokens": T.token_count(C("text"))}, "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
_project("FN16_fallback_tokens", "documents", "doc_id", lambda: {"tokens": T.token_count(C("text"), 3)}, "SELECT doc_id, greatest(1, length(text) // 3) AS tokens FROM documents")
_project("FN17_input_budget", "documents", "doc_id", lambda: {"budget": (F.when(C("lang") == "en", 128000).when(C("lang") == "de", 64000).otherwise(200000) - 8192 - 2048).cast("long")}, "SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 128000 WHEN 'de' THEN 64000 ELSE 200000 END - 8192 - 2048 AS BIGINT) AS budget FROM documents")
_project("FN30_summary", "documents", "doc_id", lambda: {"summary": T.summary(F.replace("text", F.lit("\n"), F.lit("\n\n")))}, r"WITH f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n[\s\S]*$', ''), '<[^>]+>', ' ', 'g'), '[*_`#>]', '', 'g'), '\s+', ' ', 'g')) AS b FROM documents) SELECT doc_id, CASE WHEN length(b) > 180 THEN rtrim(substr(b, 1, 177)) || '...' ELSE b END AS summary FROM f")
_project("FN39_keywords", "documents", "doc_id", lambda: {"words": F.array_join(T.keywords(C("text")), " ")}, "SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{3,}')), lambda w: w NOT IN ('and', 'the', 'with', 'from', 'chapter', 'search'))), ' ') AS words FROM documents")
_project("FN40_number_suffix", "customer", "c_custkey", lambda: {"prefix": T.ref_prefix(C("c_name")), "number": T.ref_number(C("c_name"))}, r"SELECT c_custkey, nullif(regexp_extract(c_name, '^(.*?)(\d+)$', 1), '') AS prefix, TRY_CAST(nullif(regexp_extract(c_name, '^(.*?)(\d+)$', 2), '') AS BIGINT) AS number FROM customer")
_project("FN41_fingerprint", "documents", "doc_id", lambda: {"print": T.fingerprint(C("source"), C("lang"), C("text"))}, "SELECT doc_id, substr(sha256(source || chr(0) || lang || chr(0) || text), 1, 16) AS print FROM documents")
_project("FN42_decode", "pages", "page_id", lambda: {"slug": T.decoded(C("url"))}, "SELECT page_id, url_decode(url) AS slug FROM pages")
_project("FN43_page_slug", "pages", "page_id", lambda: {"slug": F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+", ""), r"[?#].*$", ""), r"^/+|/+$", "")}, r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '^/+|/+$', '', 'g') AS slug FROM pages")
_project("FN45_csv_field", "benchmark", "item_id", lambda: {"field": T.csv_field(C("text"))}, "SELECT item_id, CASE WHEN regexp_matches(text, '[\",\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS field FROM benchmark")
_project("FN46_string_array", "documents", "doc_id", lambda: {"items": F.array_join(T.string_array(F.concat(F.lit('["'), C("lang"), F.lit('", 7, null, {"a": "b"}, "'), C("source"), F.when(C("doc_id") % 7 == 0, F.lit('"')).otherwise(F.lit('"]')))), "|")}, "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang || '|' || source END AS items FROM documents")
_project("FN47_blank_answer", "part", "p_partkey", lambda: {"answer": T.blank_answer(F.concat(F.lit(" Ａ１ "), C("p_name")))}, "SELECT p_partkey, 'a1' || replace(lower(p_name), ' ', '') AS answer FROM part")
_project("FN55_body_blocks", "documents", "doc_id", lambda: {"blocks": F.size(F.filter(F.split(F.replace("text", F.lit("\n"), F.lit("\n\n")), r"\n\s*\n"), lambda b: T.strip(b) != "")).cast("long")}, r"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g') <> '')) AS BIGINT) AS blocks FROM documents")
_project("FN53_chapter_heading", "lineitem", "l_orderkey l_linenumber", lambda: {"chapter": F.transform(F.regexp_extract_all(F.concat(F.lit("Chapter "), C("l_linenumber").cast("string"), F.lit(" Parts\n")), F.lit(r"(?i)chapter\s+(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("ch"), F.lpad(n, 2, "0")))[0]}, "SELECT l_orderkey, l_linenumber, 'ch' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS chapter FROM lineitem")
_project("RT16_estimated_tokens", "documents", "doc_id", lambda: {"tokens": T.estimated_tokens(F.concat(C("text"), F.lit("漢字かな")))}, "SELECT doc_id, CAST(ceil(4 + length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
_project("RT15_article_budget", "customer", "c_custkey", lambda: {"budget": F.greatest(F.least(C("c_custkey") * 100 - 2000 - 3000, F.floor(C("c_custkey") * 100 * 0.6)), F.lit(1000)).cast("long")}, "SELECT c_custkey, CAST(greatest(least(c_custkey * 100 - 5000, floor(c_custkey * 60)), 1000) AS BIGINT) AS budget FROM customer")
_project("RT10_embedding_cost", "documents", "doc_id", lambda: {"cost": F.length("text") * F.lit(0.068) / 1e6}, "SELECT doc_id, length(text) * CAST(0.068 AS DOUBLE) / 1e6 AS cost FROM documents")
_project("PF06_not_blank", "documents", "doc_id", lambda: {"n": F.length("text").cast("long")}, r"SELECT doc_id, length(text) AS n FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''", lambda: T.strip(C("text")) != "")
_project("PF07_suspicious", "documents", "doc_id", lambda: {"found": F.array_join(T.suspicious_phrases(C("text"), ["password=", "token =", "the end"]), ",")}, "SELECT doc_id, array_to_string(list_filter(['password=', 'token =', 'the end'], lambda p: contains(lower(text), p)), ',') AS found FROM documents")
_project("PF09_exam", "documents", "doc_id", lambda: {"exam": F.lower(F.substring("text", 1, 800)).rlike("rights reserved|licen[sc]e|version [0-9]")}, "SELECT doc_id, regexp_matches(lower(substr(text, 1, 800)), 'rights reserved|licen[sc]e|version [0-9]') AS exam FROM documents")
_project("PF10_boundary", "documents", "doc_id", lambda: {"boundary": F.coalesce(T.strip(F.substring("text", F.lit(1), F.regexp_instr("text", F.lit("Licensed|Released")) - 1)) != "", F.lit(False)) & (F.regexp_instr("text", F.lit("Licensed|Released")) > 0)}, r"SELECT doc_id, regexp_matches(text, '^[\s\S]*?\S[\s\S]*?(Licensed|Released)') AND NOT regexp_matches(text, '^\s*(Licensed|Released)') AS boundary FROM documents")
_project("PF12_presence", "pages", "page_id", lambda: {"quiz": F.contains("html", F.lit("<table")), "cards": F.contains("html", F.lit("<pre")), "sources": F.contains("html", F.lit("<a href"))}, "SELECT page_id, contains(html, '<table') AS quiz, contains(html, '<pre') AS cards, contains(html, '<a href') AS sources FROM pages")
_project("PF14_truncated", "documents", "doc_id", lambda: {"short": (F.length(F.regexp_extract("text", r"^[^\n]*", 0)) * 100 < 34 * F.length("text")) & (F.length("text") > 0)}, "SELECT doc_id, length(split_part(text, chr(10), 1)) < 0.34 * length(text) AND length(text) > 0 AS short FROM documents")
_project("PF04_noise", "documents", "doc_id", lambda: {"lang": C("lang")}, "SELECT doc_id, lang FROM documents WHERE source NOT IN ('src1', 'src2', 'src3')", lambda: ~C("source").isin("src1", "src2", "src3"))
_project("PF05_decorative", "part", "p_partkey", lambda: {"reason": F.when(C("p_size") * 10 < 180, "small side").when(C("p_size") * 10 * C("p_retailprice") / 4 < 90000, "small area").otherwise("")}, "SELECT p_partkey, CASE WHEN p_size * 10 < 180 THEN 'small side' WHEN p_size * 10 * p_retailprice / 4 < 90000 THEN 'small area' ELSE '' END AS reason FROM part")
_project("AG20_cost_model", "orders", "o_orderkey", lambda: {"cost": F.lit(0.898002) * C("o_custkey") + F.lit(0.030981) * C("o_orderkey") + F.lit(1.026168)}, "SELECT o_orderkey, CAST(0.898002 AS DOUBLE) * o_custkey + CAST(0.030981 AS DOUBLE) * o_orderkey + CAST(1.026168 AS DOUBLE) AS cost FROM orders")
_project("AG21_scale", "orders", "o_orderkey", lambda: {"sections": F.bround(C("o_custkey") / F.lit(2.0), 0).cast("long"), "concepts": F.bround(C("o_custkey") * F.lit(3.5), 0).cast("long")}, "SELECT o_orderkey, CAST(round_even(o_custkey / CAST(2 AS DOUBLE), 0) AS BIGINT) AS sections, CAST(round_even(o_custkey * CAST(3.5 AS DOUBLE), 0) AS BIGINT) AS concepts FROM orders")
_project("XF02_cost_source", "lineitem", "l_orderkey l_linenumber", lambda: {"cost": F.when(C("l_discount") > 0.05, C("l_discount")).when(C("l_tax") > 0, C("l_tax") * 6.8).otherwise(C("l_quantity") * 0.001)}, "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN l_discount WHEN l_tax > 0 THEN l_tax * CAST(6.8 AS DOUBLE) ELSE l_quantity * CAST(0.001 AS DOUBLE) END AS cost FROM lineitem")
_project("XF03_unfinished", "lineitem", "l_orderkey l_linenumber", lambda: {"rest": F.greatest(C("l_extendedprice") - C("l_quantity") * 900 - C("l_tax"), F.lit(0.0))}, "SELECT l_orderkey, l_linenumber, greatest(l_extendedprice - l_quantity * 900 - l_tax, CAST(0 AS DOUBLE)) AS rest FROM lineitem")
_project("XB01_answer_valid", "orders", "o_orderkey", lambda: {"valid": F.size(F.array_except(F.array("o_orderstatus"), F.array(F.lit("O"), F.lit("F")))) == 0}, "SELECT o_orderkey, o_orderstatus IN ('O', 'F') AS valid FROM orders")
_project("FN03_slug", "pages", "page_id", lambda: {"slug": F.substring(F.regexp_replace(F.regexp_replace("url", r"(?U)[^\w.-]+", "-"), r"^[-.]+|[-.]+$", ""), 1, 80)}, r"SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}\p{M}_.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 80) AS slug FROM pages")
_project("CH03_fixed_slices", "documents", "doc_id", lambda: {"slices": F.greatest(F.lit(1), F.ceil(F.length("text") / 1200)).cast("long"), "last": F.substring(C("text"), (F.greatest(F.lit(1), F.ceil(F.length("text") / 1200)) - 1).cast("int") * 1200 + 1, F.lit(1200))}, "SELECT doc_id, CAST(greatest(1, ceil(length(text) / 1200.0)) AS BIGINT) AS slices, substr(text, CAST((greatest(1, ceil(length(text) / 1200.0)) - 1) * 1200 + 1 AS BIGINT), 1200) AS last FROM documents")
