"""Queries of joins, aggregates, windows, top-k and sets over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import relational as R
from folio.plans.registry import query
from folio.session import table

C = F.col


def _in_file() -> list:
    """Where a row stands: SQL on one thread takes the first of rows that its order leaves equal."""
    return [C("_metadata.file_path").alias("file"), C("_metadata.row_index").alias("row")]


@query("JN01_chunks_pages", "SELECT o_orderkey, l_linenumber, c_name, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey")
def _(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), C("l_orderkey") == C("o_orderkey"))
    return joined.join(table(spark, sf, "customer"), C("c_custkey") == C("o_custkey")).select("o_orderkey", "l_linenumber", "c_name", "o_orderdate")


@query("JN07_alias_resolution", "SELECT p_partkey, p_name, CASE WHEN p_name LIKE 'red%' THEN 'crimson' WHEN p_name = 'blue bolt' THEN 'bolt' ELSE '' END AS canonical FROM part")
def _(spark, sf):
    parts = table(spark, sf, "part")
    reds = parts.where(C("p_name").startswith("red")).select(C("p_name").alias("variant")).distinct().withColumn("canonical", F.lit("crimson"))
    variants = reds.unionByName(spark.createDataFrame([("bluebolt", "bolt")], "variant string, canonical string"))
    found = R.resolve_names(parts.select("p_partkey", "p_name"), "p_name", F.regexp_replace("p_name", r"[\W_]+", ""), variants)
    return found.select("p_partkey", "p_name", F.coalesce("canonical", F.lit("")).alias("canonical"))


@query("JN06_best_overlap", """
WITH q AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM benchmark)),
c AS (SELECT DISTINCT source, w FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM documents)),
o AS (SELECT source, CAST(row_number() OVER (ORDER BY source) AS BIGINT) AS ord FROM (SELECT DISTINCT source FROM documents)),
n AS (SELECT item_id, source, ord, count(*) AS n FROM q JOIN c USING (w) JOIN o USING (source) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, ord) AS rn FROM n)
SELECT b.item_id, coalesce(source, '_unmapped') AS source, coalesce(n, 0) AS n FROM benchmark b LEFT JOIN r ON b.item_id = r.item_id AND rn = 1""")
def _(spark, sf):
    words = lambda t: F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))
    questions, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    asked = questions.select("item_id", words("text").alias("w")).distinct()
    owned = docs.select("source", words("text").alias("w")).distinct()
    names = docs.groupBy("source").agg(F.lit(0))
    ordered = names.select("source", F.row_number().over(Window.orderBy("source")).cast("long").alias("ord"))  # one row a source
    best = R.best_match(asked.join(owned, "w").join(ordered, "source"), "item_id", "source", "ord")
    return questions.select("item_id").join(best, "item_id", "left").select("item_id", F.coalesce("source", F.lit("_unmapped")).alias("source"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("JN12_foreign_citations", "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es')")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return R.anti(docs.select("doc_id", "source"), docs.where("lang = 'es'"), "source")


_LINKS = r'<a href="/([^"]*)"'


@query("JN13_missing_targets", """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS target FROM pages),
k AS (SELECT DISTINCT target FROM l WHERE page_id % 2 = 0)
SELECT page_id, target, count(*) AS n FROM l ANTI JOIN k USING (target) GROUP BY ALL""")
def _(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_LINKS), F.lit(1))).alias("target"))
    return R.anti(links, links.where("page_id % 2 = 0"), "target").groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query("JN14_hydrate", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def _(spark, sf):
    wanted = table(spark, sf, "embeddings").where("label = 3").select(C("vec_id").alias("doc_id"))
    return table(spark, sf, "documents").join(wanted, "doc_id", "left_semi").select("doc_id", "lang")


@query("JN15_backlinks", """
SELECT w AS concept, array_to_string(list(item_id ORDER BY item_id), ',') AS items, count(*) AS n FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark) GROUP BY w""")
def _(spark, sf):
    uses = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("concept"))
    return uses.groupBy("concept").agg(F.array_join(F.array_sort(F.collect_list("item_id")).cast("array<string>"), ",").alias("items"), F.count("*").alias("n"))


@query("JN17_graded_points", """
WITH g AS (SELECT l_orderkey, l_linenumber, arg_min(l_discount, l_partkey) AS earned FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, least(greatest(coalesce(g.earned, 0) * 100, 0), l.l_quantity) AS earned FROM lineitem l LEFT JOIN g USING (l_orderkey, l_linenumber)""")
def _(spark, sf):
    """Of returned rows with one part the first in the file gives the points; those without a part or a discount give none."""
    lines = table(spark, sf, "lineitem")
    returned = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", C("l_discount").alias("earned"), *_in_file())
    graded = R.first_writer(returned, ["l_orderkey", "l_linenumber"], ["l_partkey", "file", "row"], "earned")
    joined = lines.select("l_orderkey", "l_linenumber", "l_quantity").join(graded, ["l_orderkey", "l_linenumber"], "left")
    return joined.select("l_orderkey", "l_linenumber", F.least(F.greatest(F.coalesce("earned", F.lit(0.0)) * 100, F.lit(0.0)), "l_quantity").alias("earned"))


@query("AG01_page_text", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return R.group_text(table(spark, sf, "conversations"), "conv_id", "text", "turn")


@query("AG02_has_rows", "SELECT source, count(*) FILTER (WHERE lang = 'es') > 0 AS has_any FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.coalesce(F.bool_or(C("lang") == "es"), F.lit(False)).alias("has_any"))


@query("AG03_ordered_refs", """
WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS ord FROM lineitem GROUP BY ALL)
SELECT l_orderkey, array_to_string(list(l_suppkey ORDER BY ord, l_suppkey), ',') AS refs FROM f GROUP BY l_orderkey""")
def _(spark, sf):
    made = R.ordered_distinct(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", ["l_linenumber"])
    return made.select("l_orderkey", F.array_join(C("values").cast("array<string>"), ",").alias("refs"))


@query("AG04_ref_registry", "SELECT l_partkey, arg_min(l_shipdate, l_orderkey * 100 + l_linenumber) AS l_shipdate FROM lineitem GROUP BY l_partkey")
def _(spark, sf):
    """Of rows with one place the first in the file writes."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", (C("l_orderkey") * 100 + C("l_linenumber")).alias("place"), *_in_file())
    return R.first_writer(lines, "l_partkey", ["place", "file", "row"], "l_shipdate")


@query("AG05_coverage", """
WITH f AS (SELECT source, lang, max(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS a FROM documents GROUP BY ALL)
SELECT count(*) AS total, CAST(sum(a) AS BIGINT) AS assigned, CAST(count(*) - sum(a) AS BIGINT) AS unassigned, round_even(CAST(sum(a) AS DOUBLE) / count(*), 4) AS ratio FROM f""")
def _(spark, sf):
    return R.coverage(table(spark, sf, "documents"), ["source", "lang"], C("doc_id") % 3 == 0)


@query("AG06_source_language_pivot", "SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().fillna(0)


@query("AG07_fragment_stats", "SELECT source, count(*) AS fragments, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT lang) AS langs, count(*) FILTER (WHERE length(text) < 500) AS short FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("fragments"), F.sum(F.length("text")).alias("chars"), F.countDistinct("lang").alias("langs"), F.count_if(F.length("text") < 500).alias("short"))


@query("AG08_by_severity", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("AG09_repair_targets", "SELECT source, min(doc_id) AS first_doc FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY source")
def _(spark, sf):
    bad = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return table(spark, sf, "documents").join(bad, "doc_id", "left_semi").groupBy("source").agg(F.min("doc_id").alias("first_doc"))


@query("AG10_codes_by_owner", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS codes FROM events GROUP BY user_id")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("codes"))


@query("AG11_merge_summaries", "SELECT source, arg_min(lang, doc_id) AS lang, bool_or(length(text) > 5000) AS any_long, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.min_by("lang", "doc_id").alias("lang"), F.bool_or(F.length("text") > 5000).alias("any_long"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("AG13_exam_questions", "SELECT conv_id, count(*) AS questions FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("questions"))


@query("AG14_edges_and_degree", """
WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS weight FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL)
SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node""")
def _(spark, sf):
    return R.degrees(R.co_occurrence(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey"))


@query("AG15_usage_rollup", """
SELECT CASE WHEN grouping(run) = 1 THEN 'total' ELSE CAST(run AS VARCHAR) END AS run, CASE WHEN grouping(stage) = 1 THEN 'sum' ELSE stage END AS stage, sum(value) AS cost, count(*) AS calls
FROM (SELECT CAST(ts AS DATE) AS run, event_type AS stage, value FROM events) GROUP BY GROUPING SETS ((run, stage), (run), ())""")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.to_date("ts").alias("run"), C("event_type").alias("stage"), "value")
    return R.usage_rollup(rows, "run", "stage", "value")


@query("AG16_score", "SELECT l_orderkey, sum(l_quantity) AS max_score, sum(least(greatest(l_discount * 100, 0), l_quantity)) AS score FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("max_score"), F.sum(F.least(F.greatest(C("l_discount") * 100, F.lit(0.0)), "l_quantity")).alias("score"))


@query("AG17_all_hit", "SELECT o_custkey, count(*) > 0 AND bool_and(o_orderstatus = 'F') AS hit FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_and(C("o_orderstatus") == "F").alias("hit"))


@query("AG18_same_page_jobs", "SELECT o_custkey, min(o_orderkey) AS first_job, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS jobs FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_job"), F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("jobs"))


@query("AG22_article_refs", """
WITH f AS (SELECT conv_id, w, min(turn * 100000 + pos) AS place FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Z][a-z]{6,}') AS ws FROM conversations)) GROUP BY ALL)
SELECT conv_id, array_to_string(list(w ORDER BY place), ',') AS refs FROM f GROUP BY conv_id""")
def _(spark, sf):
    refs = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0))).alias("pos", "w"))
    return R.ordered_distinct(refs, "conv_id", "w", ["turn", "pos"]).select("conv_id", F.array_join("values", ",").alias("refs"))


@query("WN01_ordinals", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS chunk_index, l_orderkey || '#chunk-' || lpad(CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS VARCHAR), 3, '0') AS chunk_id FROM lineitem")
def _(spark, sf):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (n - 1).alias("chunk_index"), F.format_string("%s#chunk-%03d", "l_orderkey", n).alias("chunk_id"))


@query("WN02_neighbour_briefs", "SELECT o_orderkey, coalesce(lag(o_orderkey) OVER w, -1) AS previous, coalesce(lead(o_orderkey) OVER w, -1) AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _(spark, sf):
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.lag("o_orderkey").over(by), F.lit(-1)).alias("previous"), F.coalesce(F.lead("o_orderkey").over(by), F.lit(-1)).alias("next"))


@query("WN05_item_ids", "SELECT l_orderkey, l_linenumber, l_returnflag || '-' || lpad(CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS VARCHAR), 3, '0') AS item_id FROM lineitem")
def _(spark, sf):
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%s-%03d", "l_returnflag", n).alias("item_id"))


@query("WN08_position_flags", "SELECT conv_id, turn, turn = min(turn) OVER (PARTITION BY conv_id) AS is_first, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations")
def _(spark, sf):
    by = Window.partitionBy("conv_id")
    return table(spark, sf, "conversations").select("conv_id", "turn", (C("turn") == F.min("turn").over(by)).alias("is_first"), (C("turn") == F.max("turn").over(by)).alias("is_last"), F.count("*").over(by).alias("n"))


@query("WN10_first_per_id", "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS first_place FROM lineitem GROUP BY l_partkey")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min(C("l_orderkey") * 10 + C("l_linenumber")).alias("first_place"))


@query("XC10_line_windows", """
WITH s AS (SELECT user_id, event_id // 40 AS low, event_id // 40 + 2 AS high FROM events), p AS (SELECT *, max(high) OVER (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR low > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM p)
SELECT user_id, min(low) AS low, max(high) AS high, count(*) AS n FROM i GROUP BY user_id, island""")
def _(spark, sf):
    low = F.expr("event_id DIV 40")  # exact and towards zero, as in SQL
    return R.islands(table(spark, sf, "events"), "user_id", low, low + 2)


@query("XF01_budget_stop", """
WITH r AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events)
SELECT user_id, min(event_id) AS stopped_at FROM r WHERE spent > 500 GROUP BY user_id""")
def _(spark, sf):
    by = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("user_id", "event_id", F.sum("value").over(by).alias("spent")).where("spent > 500").groupBy("user_id").agg(F.min("event_id").alias("stopped_at"))


@query("TK06_graph_backbone", """
WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS weight FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL),
d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node), k AS (SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 120),
r AS (SELECT a, b, weight, row_number() OVER (ORDER BY x.degree + y.degree DESC, a, b) AS n FROM e JOIN k x ON a = x.node JOIN k y ON b = y.node),
f AS (SELECT min(n) AS n FROM (SELECT a AS node, n FROM r UNION ALL SELECT b, n FROM r) GROUP BY node)
SELECT a, b, weight FROM r WHERE n <= 400 OR n IN (SELECT n FROM f)""")
def _(spark, sf):
    edges = R.co_occurrence(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    top = R.degrees(edges).orderBy(F.desc("degree"), "node").limit(120)
    within = edges.join(top.select(C("node").alias("a"), C("degree").alias("da")), "a").join(top.select(C("node").alias("b"), C("degree").alias("db")), "b")
    return R.backbone(within, C("da") + C("db"), 400)


@query("TK07_card_order", "SELECT CAST(row_number() OVER (ORDER BY p_brand, p_type, p_partkey) AS BIGINT) AS place, p_partkey FROM part ORDER BY 1 LIMIT 500")
def _(spark, sf):
    first = table(spark, sf, "part").orderBy("p_brand", "p_type", "p_partkey").limit(500)
    return first.select(F.row_number().over(Window.orderBy("p_brand", "p_type", "p_partkey")).cast("long").alias("place"), "p_partkey")


@query("TK09_longest_first", "SELECT p_partkey, length(p_name || p_brand) AS n FROM part ORDER BY n DESC, p_partkey LIMIT 50")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.length(F.concat("p_name", "p_brand")).cast("long").alias("n")).orderBy(F.desc("n"), "p_partkey").limit(50)


@query("TK12_fewest_issues", "SELECT l_partkey, arg_min(l_orderkey, l_discount * 1e9 + l_orderkey) AS best FROM lineitem GROUP BY l_partkey")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", C("l_discount") * 1e9 + C("l_orderkey")).alias("best"))


@query("TK13_recent_conversations", "SELECT conv_id, max(turn) AS turns FROM conversations GROUP BY conv_id ORDER BY turns DESC, conv_id LIMIT 100")
def _(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns")).orderBy(F.desc("turns"), "conv_id").limit(100)


@query("FN58_conversation_titles", r"""
WITH f AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(t) > 48 THEN substr(t, 1, 48) || '…' ELSE t END AS title FROM f""")
def _(spark, sf):
    from folio.functions.text import conversation_title

    first = table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", conversation_title(C("text")).alias("title"))


@query("SO01_uncovered", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("SO03_allowed_refs", "SELECT source AS ref FROM documents UNION SELECT lang FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(C("source").alias("ref")).unionByName(docs.select(C("lang").alias("ref"))).distinct()


@query("SO04_overlap", "SELECT p_partkey, CAST(len(list_intersect(string_split(p_name, ' '), ['red', 'blue', 'widget', 'bolt'])) AS BIGINT) AS overlap FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.size(F.array_intersect(F.split("p_name", " "), F.array(*map(F.lit, ["red", "blue", "widget", "bolt"])))).cast("long").alias("overlap"))


@query("SO07_carry_forward", "SELECT doc_id, 'fresh' AS state FROM labels UNION ALL SELECT doc_id, 'kept' FROM documents ANTI JOIN labels USING (doc_id)")
def _(spark, sf):
    fresh = table(spark, sf, "labels").select("doc_id")
    kept = R.anti(table(spark, sf, "documents").select("doc_id"), fresh, "doc_id")
    return fresh.withColumn("state", F.lit("fresh")).unionByName(kept.withColumn("state", F.lit("kept")))


@query("SO09_slot_dedupe", "SELECT l_partkey, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS first_place FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.min(C("l_orderkey") * 10 + C("l_linenumber")).alias("first_place"))


@query("SC14_table_defaults", "SELECT doc_id, CAST(coalesce(CASE WHEN doc_id % 2 = 0 THEN n_chars END, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS BIGINT) AS order_index FROM documents")
def _(spark, sf):
    scan = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.when(C("doc_id") % 2 == 0, C("n_chars")), scan).cast("long").alias("order_index"))


@query("SC15_point_lookup", "SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id = 7) ORDER BY page_id LIMIT 1")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.join(pages.where("page_id = 7").select("url"), "url", "left_semi").orderBy("page_id").limit(1).select("page_id", "url")


@query("SC12_changed_sources", "SELECT doc_id, sha256(text) AS print FROM documents WHERE doc_id % 3 = 0 OR sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 <> 0)")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("print"))
    known = docs.where("doc_id % 3 <> 0")
    return docs.where("doc_id % 3 = 0").unionByName(R.anti(known, known, "print"))


@query("XG01_chapter_order", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY nullif(s_nationkey, 3) ASC NULLS LAST, s_name) AS BIGINT) AS place FROM supplier")
def _(spark, sf):
    order = Window.orderBy(F.nullif(C("s_nationkey"), F.lit(3)).asc_nulls_last(), "s_name")
    return table(spark, sf, "supplier").select("s_suppkey", F.row_number().over(order).cast("long").alias("place"))
