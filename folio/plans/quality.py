"""Queries of checks and repairs, of readers and exports, and of usage windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import quality as Q
from folio.plans.registry import query
from folio.session import table
from folio.sources import vault
from folio.streaming import pickup

C = F.col


def _pages(spark, sf):
    n = C("doc_id")
    text = F.concat(F.when(n % 2 == 0, "---\n").otherwise(""), F.when(n % 3 == 0, "<QuizBlock>").otherwise(""), F.when(n % 5 == 0, "<!-- source_ref: a-p1 -->").otherwise(""), F.when(n % 7 == 0, "the System Prompt").otherwise(""), F.lit(" x"))
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


_ISSUES = """i AS (SELECT CAST(doc_id AS VARCHAR) AS owner, 'error' AS severity, 'missing_frontmatter' AS code, 'no frontmatter' AS message FROM documents WHERE doc_id % 2 <> 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'warning', 'missing_quiz', 'no quiz' FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'warning', 'missing_cards', 'no cards' FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'error', 'missing_sources', 'no source reference' FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'critical', 'suspicious_instruction', 'system prompt' FROM documents WHERE doc_id % 7 = 0)"""


@query("CH31_page_issues", f"WITH {_ISSUES} SELECT * FROM i")
def _(spark, sf):
    return Q.page_issues(_pages(spark, sf), "doc_id", "text")


@query("CH33_repair_targets", f"WITH {_ISSUES} SELECT owner, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM i WHERE severity IN ('error', 'critical') GROUP BY owner")
def _(spark, sf):
    return Q.repair_targets(Q.page_issues(_pages(spark, sf), "doc_id", "text")).withColumn("codes", F.array_join("codes", ","))


def _items(spark, sf):
    none = F.array().cast("array<string>")
    ref = lambda k: F.struct(F.concat(F.lit("r"), (C(k) % 3).cast("string")).alias("ref_id"), F.lit("q").alias("quote"))
    items = table(spark, sf, "lineitem").select((C("l_orderkey") * 10 + C("l_linenumber")).alias("item_id"), C("l_suppkey").alias("owner"), F.lit("single_choice").alias("kind"), F.array(F.lit("A"), F.lit("N")).alias("options"), F.when(C("l_linestatus") == "O", F.array("l_returnflag")).otherwise(none).alias("answer"), F.array(ref("l_partkey"), ref("l_orderkey")).alias("citations"))
    allowed = table(spark, sf, "supplier").select(C("s_suppkey").alias("owner"), F.array(F.concat(F.lit("r"), (C("s_suppkey") % 3).cast("string"))).alias("refs"))
    return Q.drop_unverified(items, allowed)


_ITEMS = """x AS (SELECT l_orderkey * 10 + l_linenumber AS item_id, l_suppkey AS owner, l_linestatus = 'O' AND l_returnflag IN ('A', 'N') AS ok, l_partkey % 3 AS c1, l_orderkey % 3 AS c2, l_suppkey % 3 AS c FROM lineitem),
y AS (SELECT *, CASE WHEN c1 = c OR c2 = c THEN 1 ELSE 0 END AS good FROM x)"""


@query("CH32_kept_items", f"WITH {_ITEMS} SELECT item_id, owner, good AS citations FROM y WHERE ok")
def _(spark, sf):
    kept, _audit = _items(spark, sf)
    return kept.select("item_id", "owner", F.size("citations").alias("citations"))


@query("CH32_repair_audit", f"WITH {_ITEMS} SELECT owner, item_id, 'invalid_answer' AS reason, 1 AS n FROM y WHERE NOT ok UNION ALL SELECT owner, item_id, 'ungrounded_citation', 2 - good FROM y WHERE ok AND good < 2")
def _(spark, sf):
    return _items(spark, sf)[1]


@query("XB02_blanks", "SELECT p_partkey, p_size % 4 <> 0 AS ok FROM part")
def _(spark, sf):
    blank = F.when(C("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name"))
    return table(spark, sf, "part").select("p_partkey", Q.blanks_valid(F.array(F.array("p_type"), blank)).alias("ok"))


@query("SC09_content_blocks", """SELECT CAST(doc_id AS VARCHAR) AS source_id, doc_id % 3 AS page_idx, doc_id || '-p' || lpad(CAST(doc_id % 3 + 1 AS VARCHAR), 3, '0') || '-b001' AS block_id, 'text' AS type, lang AS text FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, doc_id || '-p001-b' || CASE WHEN doc_id % 3 = 0 THEN '003' ELSE '002' END, 'image', '' FROM documents""")
def _(spark, sf):
    json = F.format_string('[{"type":"text","text":"%s","page_idx":%d},{"type":"text","text":" "},{"type":"image"}]', "lang", C("doc_id") % 3)
    return vault.content_blocks(table(spark, sf, "documents").select(C("doc_id").cast("string").alias("id"), json.alias("json")), "id", "json").withColumn("page_idx", C("page_idx").cast("long"))


@query("SC11_fallback_pages", r"""WITH p AS (SELECT doc_id, string_split(replace(text, chr(10), chr(12)), chr(12)) AS ps FROM documents), u AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS page_idx, regexp_replace(unnest(ps), '^\s+|\s+$', '', 'g') AS body FROM p)
SELECT doc_id AS source_id, CAST(page_idx AS INTEGER) AS page_idx, body FROM u WHERE body <> ''""")
def _(spark, sf):
    return vault.fallback_pages(table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text")), "doc_id", "text")


@query("SC16_flashcards", "SELECT p_partkey, chr(34) || p_name || ', ' || repeat(chr(34), 2) || p_brand || repeat(chr(34), 3) || ',' || p_type || ',' || p_type || ' a_b' AS line FROM part")
def _(spark, sf):
    cards = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("front"), C("p_type").alias("back"), F.array(C("p_type"), F.lit("a b"), C("p_type")).alias("tags"))
    return vault.flashcard_lines(cards, "front", "back", "tags").select("p_partkey", "line")


@query("SC18_snapshot", "SELECT to_json(nation) AS line FROM nation")
def _(spark, sf):
    return vault.snapshot(table(spark, sf, "nation"))


@query("ST01_usage_window", "SELECT date_trunc('hour', ts) AS start, event_type, sum(value) AS cost, count(*) AS calls FROM events GROUP BY ALL")
def _(spark, sf):
    return pickup.usage_by_window(table(spark, sf, "events"), "ts", "event_type", "value")
