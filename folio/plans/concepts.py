"""Queries of the concept family: glossary, alias map, registry fold, link audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import concepts as K
from folio.operators import reconcile as R
from folio.plans.registry import query
from folio.session import table

C = F.col
_KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"


def _names(spark, sf):
    name = F.when(C("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(C("p_name"))
    return table(spark, sf, "part").select("p_brand", "p_partkey", name.alias("name"), F.concat(F.lit("ch"), C("p_size").cast("string")).alias("chapter"))


_SQL_NAMES = "n AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, 'ch' || p_size AS chapter FROM part)"


@query("XA07_glossary", f"""WITH {_SQL_NAMES}, g AS (SELECT p_brand, {_KEY.format('name')} AS key, arg_min(name, p_partkey) AS canonical, arg_min(chapter, p_partkey) AS first_chapter, list(DISTINCT name) AS names FROM n GROUP BY ALL)
SELECT p_brand, key, canonical, array_to_string(list_sort(list_filter(names, lambda x: x <> canonical)), ',') AS aliases, first_chapter FROM g""")
def _(spark, sf):
    made = K.glossary(_names(spark, sf), "p_brand", "name", "chapter", "p_partkey")
    return made.withColumn("aliases", F.array_join("aliases", ","))


_SQL_VARIANTS = f"""v AS (SELECT s_name AS canonical, s_suppkey * 10 AS o, s_name AS variant FROM supplier UNION ALL SELECT s_name, s_suppkey * 10 + 1, {_KEY.format('s_name')} FROM supplier
  UNION ALL SELECT s_name, s_suppkey * 10 + 2, 'Nation ' || s_nationkey FROM supplier UNION ALL SELECT s_name, s_suppkey * 10 + 3, 'nation' || s_nationkey FROM supplier),
m AS (SELECT variant, arg_max(canonical, o) AS canonical FROM v GROUP BY variant)"""


def _variants(spark, sf):
    entries = table(spark, sf, "supplier").select(C("s_name").alias("canonical"), F.array(F.concat(F.lit("Nation "), C("s_nationkey").cast("string"))).alias("aliases"), C("s_suppkey").alias("ord"))
    return K.alias_map(entries, "ord")


@query("CH18_alias_map", f"WITH {_SQL_VARIANTS} SELECT variant, canonical FROM m")
def _(spark, sf):
    return _variants(spark, sf)


@query("CH15_known_and_new", f"WITH {_SQL_VARIANTS} SELECT c_custkey, coalesce(canonical, '+') AS canonical FROM customer LEFT JOIN m ON variant = 'nation' || c_nationkey")
def _(spark, sf):
    candidates = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("NATION-"), C("c_nationkey").cast("string")).alias("name"))
    return K.known_and_new(candidates, "name", _variants(spark, sf)).select("c_custkey", F.coalesce("canonical", F.lit("+")).alias("canonical"))


_CANDIDATES = """r AS (SELECT p_brand AS book, p_type, p_partkey % 5 AS k, (CASE p_partkey % 5 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END) * 1000000000 + p_partkey AS ord,
  CASE p_partkey % 5 WHEN 3 THEN 'b ' || p_type WHEN 4 THEN 'c ' || p_type ELSE CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_type END END AS name,
  CASE p_partkey % 5 WHEN 3 THEN [p_type] WHEN 4 THEN ['b ' || p_type] ELSE [] END AS aliases, 'ch' || p_size % 5 AS chapter FROM part)"""
_MERGED = f"""s AS (SELECT book, g, name, min(ord * 100 + i) AS o FROM (SELECT book, g, ord, unnest([name] || aliases) AS name, unnest(range(0, 1 + len(aliases))) AS i FROM grouped) GROUP BY ALL),
f AS (SELECT book, g, arg_min(name, ord) AS canonical FROM grouped GROUP BY ALL),
h AS (SELECT book, g, string_agg(chapter, ',' ORDER BY o) AS chapters FROM (SELECT book, g, chapter, min(ord) AS o FROM grouped WHERE chapter <> '' GROUP BY ALL) GROUP BY ALL),
merged AS (SELECT book, {_KEY.format('canonical')} AS key, canonical, coalesce((SELECT string_agg(s.name, ',' ORDER BY o) FROM s WHERE s.book = f.book AND s.g = f.g AND s.name <> canonical), '') AS aliases, chapters FROM f JOIN h USING (book, g))"""


def _candidates(spark, sf):
    k = C("p_partkey") % 5
    name = F.when(k == 3, F.concat(F.lit("b "), "p_type")).when(k == 4, F.concat(F.lit("c "), "p_type")).when(C("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(C("p_type"))
    aliases = F.when(k == 3, F.array("p_type")).when(k == 4, F.array(F.concat(F.lit("b "), "p_type"))).otherwise(F.array().cast("array<string>"))
    late = F.when(k == 3, 1).when(k == 4, 2).otherwise(0).cast("long")
    return table(spark, sf, "part").select(C("p_brand").alias("book"), (late * 1_000_000_000 + C("p_partkey")).alias("ord"), name.alias("name"), aliases.alias("aliases"), F.concat(F.lit("ch"), C("p_size") % 5).alias("chapter"))


def _listed(concepts):
    return concepts.select("book", "key", "canonical", F.array_join("aliases", ",").alias("aliases"), F.array_join("chapters", ",").alias("chapters"))


@query("CH17_reconciled", f"""WITH {_CANDIDATES}, grouped AS (SELECT *, p_type || CASE WHEN k = 4 AND NOT bool_or(k = 3) OVER (PARTITION BY book, p_type) THEN ' c' ELSE '' END AS g FROM r), {_MERGED}
SELECT book, key, canonical, aliases, chapters FROM merged""")
def _(spark, sf):
    """Chains of names (c knows b, b knows the type) are folded; types that no other name leads to are grouped."""
    return _listed(R.reconciled(_candidates(spark, sf)))


def _glossary(spark, sf):
    types = table(spark, sf, "part").where("p_type LIKE 'S%'").groupBy(C("p_brand").alias("book"), "p_type").agg(F.min("p_partkey").alias("ord"))
    canonical = F.concat(F.lit("Glossary "), "p_type")
    return types.select("book", "ord", canonical.alias("canonical"), F.array("p_type").alias("aliases"), F.lit("g").alias("first_chapter")), types.select("book", F.concat(F.lit("c "), "p_type").alias("variant"), canonical.alias("canonical"))


_BASED = _CANDIDATES + """, n AS (SELECT book, ord, name, aliases, chapter, p_type || CASE WHEN k = 4 AND p_type NOT LIKE 'S%' AND NOT bool_or(k = 3) OVER (PARTITION BY book, p_type) THEN ' c' ELSE '' END AS g FROM r),
grouped AS (SELECT book, ord, name, aliases, chapter, g FROM n UNION ALL SELECT DISTINCT p_brand, -1, 'Glossary ' || p_type, [p_type], 'g', p_type FROM part WHERE p_type LIKE 'S%'), """ + _MERGED


@query("CH16_merged_candidates", f"WITH {_BASED} SELECT book, key, canonical, aliases, chapters FROM merged")
def _(spark, sf):
    return _listed(R.reconciled(_candidates(spark, sf), *_glossary(spark, sf)))


@query("CH16_alias_map", f"""WITH {_BASED}, every AS (SELECT book, canonical, unnest([canonical] || CASE WHEN aliases = '' THEN [] ELSE string_split(aliases, ',') END) AS name FROM merged)
SELECT book, name AS variant, canonical FROM every UNION SELECT book, {_KEY.format('name')}, canonical FROM every UNION SELECT DISTINCT p_brand, 'c ' || p_type, 'Glossary ' || p_type FROM part WHERE p_type LIKE 'S%'""")
def _(spark, sf):
    entries, variants = _glossary(spark, sf)
    return R.alias_map(R.reconciled(_candidates(spark, sf), entries, variants), variants)


@query("CH13_registry_fold")
def _(spark, sf):
    parts = table(spark, sf, "part")
    op = F.element_at(F.array(*map(F.lit, ["add_concept", "add_concept", "add_alias", "rename_canonical", "merge", "add_concept"])), (C("p_partkey") % 6 + 1).cast("int"))
    chapter = F.concat(F.lit("ch"), C("p_size").cast("string"))
    into = F.expr("CAST(array() AS array<struct<canonical: string, aliases: array<string>>>)")
    edits = parts.select(C("p_brand").alias("book"), chapter.alias("chapter"), C("p_size").alias("chapter_ord"), C("p_partkey").alias("op_ord"), op.alias("op"), C("p_name").alias("name"), C("p_type").alias("other"), F.array("p_type").alias("aliases"), into.alias("into"))
    return K.fold_registry(edits)


_LINKED = "SELECT doc_id, lang, source FROM documents"


def _linked(spark, sf):
    text = F.concat(F.lit("[["), F.upper("lang"), F.lit("]] [[German]] <PreviewLink href={\"/docs/concepts/"), "source", F.lit("\"} /> <PreviewLink href=\"/docs/chapters/"), "lang", F.lit("\" />"), C("text"))
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


@query("XD01_term_drift", "SELECT doc_id, upper(lang) AS target, CASE lang WHEN 'de' THEN 'German' ELSE 'English' END AS canonical FROM documents WHERE lang IN ('de', 'en')")
def _(spark, sf):
    variants = spark.createDataFrame([("de", "German"), ("en", "English"), ("German", "German")], "variant string, canonical string")
    return K.term_drift(_linked(spark, sf), "doc_id", "text", variants)


@query("XD02_unresolved_links", """SELECT doc_id, source AS target FROM documents WHERE source NOT IN (SELECT 'src' || r_regionkey FROM region) UNION ALL SELECT doc_id, lang FROM documents WHERE lang <> 'de'
UNION ALL SELECT doc_id, '[[' || upper(lang) || ']]' FROM documents UNION ALL SELECT doc_id, '[[German]]' FROM documents""")
def _(spark, sf):
    known = table(spark, sf, "region").select(F.concat(F.lit("src"), C("r_regionkey").cast("string")).alias("slug"))
    return K.unresolved_links(_linked(spark, sf), "doc_id", "text", known, spark.createDataFrame([("de",)], "slug string"))
