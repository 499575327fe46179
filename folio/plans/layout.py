"""Queries of layout repair: a customer is a source, an order a page, of three blocks at most."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import layout
from folio.plans.registry import query
from folio.session import table

C, L = F.col, F.lit
#: Each page: a table or a text, a footer, and on some a chart, whose text is blank on a few.
_BLOCKS = """b AS (
  SELECT o_custkey AS source, o_orderkey AS page_idx, 1 AS block_index, CASE WHEN o_orderstatus = 'F' THEN 'table' ELSE 'text' END AS type, o_orderpriority AS text FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 2, 'footer', 'page' FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 3, 'chart', CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE o_orderpriority END FROM orders WHERE o_orderkey % 3 = 0),
p AS (SELECT source, page_idx, max(CASE WHEN block_index = 1 THEN type END) AS first, arg_max(type, block_index) FILTER (WHERE type <> 'footer' AND trim(text) <> '') AS last, max(block_index) FILTER (WHERE type <> 'footer' AND trim(text) <> '') AS place FROM b GROUP BY ALL),
w AS (SELECT *, lead(first) OVER (PARTITION BY source ORDER BY page_idx) AS next, lead(page_idx) OVER (PARTITION BY source ORDER BY page_idx) AS after FROM p),
c AS (SELECT source, page_idx, place, after, row_number() OVER (PARTITION BY source ORDER BY page_idx) AS n FROM w WHERE last IN ('table', 'chart') AND next = 'table'),
g AS (SELECT *, source || '-p' || page_idx || '-b' || place AS left_block, source || '-p' || after || '-b1' AS right_block FROM c)"""


def _blocks(spark, sf):
    orders = table(spark, sf, "orders")
    block = lambda i, kind, text: F.struct(L(i).alias("block_index"), kind.alias("type"), text.alias("text"))
    chart = F.when(C("o_orderkey") % 3 == 0, block(3, L("chart"), F.when(C("o_orderkey") % 7 == 0, "  ").otherwise(C("o_orderpriority"))))
    every = F.array_compact(F.array(block(1, F.when(C("o_orderstatus") == "F", "table").otherwise("text"), C("o_orderpriority")), block(2, L("footer"), L("page")), chart))
    rows = orders.select(C("o_custkey").alias("source"), C("o_orderkey").alias("page_idx"), F.explode(every).alias("b")).select("source", "page_idx", "b.*")
    ref = F.concat("source", L("-p"), "page_idx")
    return rows.withColumn("page_ref", ref).withColumn("block_id", F.concat(ref, L("-b"), "block_index"))


@query("JN19_continued_tables", f"WITH {_BLOCKS} SELECT source, CAST(n AS INTEGER) AS n, left_block || '-to-' || right_block AS candidate_id, 0.65::DOUBLE AS confidence FROM g WHERE n <= 2")
def _(spark, sf):
    return layout.continued_tables(_blocks(spark, sf), most=2).select("source", "n", "candidate_id", "confidence")


def _decide(candidates):
    """What a reader of the candidates might say: sure of every second page, unsure of the others, wrong about some blocks."""
    sure = F.when(C("n") % 2 == 1, 0.9).otherwise(0.5)
    patch = lambda k, action, source, target, c: F.struct((C("n") * 10 + k).alias("ord"), L(action).alias("action"), source.alias("source_block_id"), target.alias("target_block_id"), c.alias("confidence"), L("seen").alias("reason"))
    none = L(None).cast("string")
    every = F.array(
        patch(1, "link_table_parts", C("left_block"), C("right_block"), sure), patch(2, "promote_heading", C("left_block"), none, L(0.9)), patch(3, "demote_repeating_header_footer", C("left_block"), none, sure),
        patch(4, "attach_caption", C("right_block"), F.when(C("n") % 2 == 1, L("nowhere")).otherwise(C("left_block")), L(0.8)), patch(5, "promote_heading", L("gone"), none, L(0.95)), patch(6, "erase", C("left_block"), none, L(1.0)),
    )
    return candidates.select("source", F.explode(every).alias("p")).select("source", "p.*")


@query("XC07_repaired_tables", f"""WITH {_BLOCKS}, t AS (SELECT *, source || '-table-' || lpad(CAST((n + 1) // 2 AS VARCHAR), 3, '0') AS table_id FROM g WHERE n <= 20 AND n % 2 = 1)
SELECT source, table_id, source || '-p' || page_idx AS canonical_ref, left_block AS block_id, 'start' AS role FROM t UNION ALL SELECT source, table_id, source || '-p' || page_idx, right_block, 'continuation' FROM t""")
def _(spark, sf):
    return layout.repaired(_blocks(spark, sf), _decide).tables.select("source", "table_id", "canonical_ref", "block_id", "role")


@query("JN18_patches", f"""WITH {_BLOCKS}
SELECT source, CAST(n * 10 + 4 AS INTEGER) AS ord, 'unknown block id ''nowhere'' for action attach_caption' AS warning FROM g WHERE n <= 20 AND n % 2 = 1
UNION ALL SELECT source, CAST(n * 10 + 5 AS INTEGER), 'unknown block id ''gone'' for action promote_heading' FROM g WHERE n <= 20 UNION ALL SELECT source, CAST(n * 10 + 6 AS INTEGER), 'unsupported repair action ''erase''' FROM g WHERE n <= 20""")
def _(spark, sf):
    return layout.repaired(_blocks(spark, sf), _decide).warnings


@query("XC07_repaired_blocks", f"""WITH {_BLOCKS}, i AS (SELECT source, page_idx, block_index, type, source || '-p' || page_idx || '-b' || block_index AS block_id FROM b)
SELECT i.block_id, CASE WHEN l.n % 2 = 1 THEN 'header' WHEN l.n % 2 = 0 THEN 'title' ELSE i.type END AS type, coalesce(r.left_block, '') AS attached_to
FROM i LEFT JOIN (SELECT * FROM g WHERE n <= 20) l ON l.left_block = i.block_id LEFT JOIN (SELECT * FROM g WHERE n <= 20 AND n % 2 = 0) r ON r.right_block = i.block_id""")
def _(spark, sf):
    made = layout.repaired(_blocks(spark, sf), _decide).blocks
    return made.select("block_id", "type", F.coalesce("attached_to", L("")).alias("attached_to"))
