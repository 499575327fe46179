"""Layout repair of parsed sources: tables that go on over a page, patches of blocks as rows, two passes.

Blocks are rows (source, page_idx, block_index, block_id, page_ref, type, text). Patches are rows too, in an order; what
they change does not depend on each other, so the last one that names a block decides, and only numbers of tables follow
the order.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of blocks that are tables, that carry nothing, what a patch may do, how sure a candidate is.
TABLE_TYPES = ["table", "chart"]
NOISE_TYPES = ["header", "footer", "page_number"]
ACTIONS = ["link_table_parts", "attach_caption", "promote_heading", "demote_repeating_header_footer"]
CANDIDATE_CONFIDENCE, MIN_CONFIDENCE, MOST_CANDIDATES = 0.65, 0.8, 20


class Repaired(NamedTuple):
    """blocks with type and attached_to; tables (source, table_id, canonical_ref, confidence, reason, block_id, page_ref, role); warnings (source, ord, warning)."""

    blocks: DataFrame
    tables: DataFrame
    warnings: DataFrame


def continued_tables(blocks: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(source, n, candidate_id, left_block, right_block, left_ref, right_ref, confidence) of neighbouring pages that end and begin with tables.

    Blocks of noise and without text don't count; a page without others ends the table. At most ``most`` of a source, the
    first ones.
    """
    counts = ~F.col("type").isin(NOISE_TYPES) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    block = F.when(counts, F.struct("block_index", "block_id", "page_ref", "type"))
    pages = blocks.groupBy("source", "page_idx").agg(F.min(block).alias("first"), F.max(block).alias("last"))
    order = Window.partitionBy("source").orderBy("page_idx")
    both = pages.withColumn("next", F.lead("first").over(order)).where(F.col("last.type").isin(TABLE_TYPES) & F.col("next.type").isin(TABLE_TYPES))
    ranked = both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    left, right = F.col("last.block_id"), F.col("next.block_id")
    return ranked.select("source", "n", F.concat(left, F.lit("-to-"), right).alias("candidate_id"), left.alias("left_block"), right.alias("right_block"), F.col("last.page_ref").alias("left_ref"), F.col("next.page_ref").alias("right_ref"), F.lit(CANDIDATE_CONFIDENCE).alias("confidence"))


def patched(blocks: DataFrame, patches: DataFrame) -> Repaired:
    """The blocks after patches (source, ord, action, source_block_id, target_block_id, confidence, reason).

    A patch of an unknown action, or of a block that the source does not have, is a warning and changes nothing.
    """
    known = blocks.select("source", F.col("block_id").alias("source_block_id"), F.col("page_ref").alias("source_ref"))
    target = blocks.select("source", F.col("block_id").alias("target_block_id"), F.col("page_ref").alias("target_ref"))
    met = patches.join(known, ["source", "source_block_id"], "left").join(target, ["source", "target_block_id"], "left")
    pair = F.col("action").isin("link_table_parts", "attach_caption")
    unknown = lambda block: F.concat(F.lit("unknown block id '"), F.coalesce(block, F.lit("")), F.lit("' for action "), F.col("action"))
    warning = (
        F.when(~F.coalesce("action", F.lit("")).isin(ACTIONS), F.concat(F.lit("unsupported repair action '"), F.coalesce("action", F.lit("")), F.lit("'")))
        .when(F.col("source_ref").isNull(), unknown(F.col("source_block_id")))
        .when(pair & F.col("target_ref").isNull(), unknown(F.col("target_block_id")))
    )
    told = met.withColumn("warning", warning)
    good = told.where("warning IS NULL")
    kinds = good.where(F.col("action").isin("promote_heading", "demote_repeating_header_footer")).groupBy("source", F.col("source_block_id").alias("block_id")).agg(F.max_by("action", "ord").alias("action"))
    held = good.where("action = 'attach_caption'").groupBy("source", F.col("source_block_id").alias("block_id")).agg(F.max_by("target_block_id", "ord").alias("attached_to"))
    own = [c for c in blocks.columns if c != "type"]
    kind = F.when(F.col("action") == "promote_heading", "title").when(F.col("action") == "demote_repeating_header_footer", "header").otherwise(F.col("type"))
    made = blocks.join(kinds, ["source", "block_id"], "left").join(held, ["source", "block_id"], "left").select(*own, kind.alias("type"), "attached_to")
    number = F.row_number().over(Window.partitionBy("source").orderBy("ord"))
    linked = good.where("action = 'link_table_parts'").withColumn("table_id", F.concat(F.col("source").cast("string"), F.lit("-table-"), F.lpad(number.cast("string"), 3, "0")))
    part = lambda block, ref, role: F.struct(F.col(block).alias("block_id"), F.col(ref).alias("page_ref"), F.lit(role).alias("role"))
    parts = F.explode(F.array(part("source_block_id", "source_ref", "start"), part("target_block_id", "target_ref", "continuation")))
    tables = linked.select("source", "table_id", F.col("source_ref").alias("canonical_ref"), "confidence", "reason", parts.alias("p")).select("source", "table_id", "canonical_ref", "confidence", "reason", "p.*")
    return Repaired(made, tables, told.where("warning IS NOT NULL").select("source", "ord", "warning"))


def repaired(blocks: DataFrame, decide: Callable[[DataFrame], DataFrame], min_confidence: float = MIN_CONFIDENCE, most: int = MOST_CANDIDATES) -> Repaired:
    """Two passes: candidates of the first go to ``decide``, and its patches of enough confidence make the second."""
    return patched(blocks, decide(continued_tables(blocks, most)).where(F.col("confidence") >= min_confidence))


def marked(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(source, page_idx, block_index, line): a comment for each block that is part of a table over several pages."""
    line = F.concat(F.lit("<!-- logical_table: "), "table_id", F.lit(" part: "), "role", F.lit(" block: "), "block_id", F.lit(" -->"))
    # A block that is in several tables is told of in the last.
    last = tables.groupBy("source", "block_id").agg(F.max_by(F.struct("table_id", "role"), "table_id").alias("t")).select("source", "block_id", "t.*")
    return blocks.where(~F.col("type").isin(NOISE_TYPES)).join(last, ["source", "block_id"]).select("source", "page_idx", "block_index", line.alias("line"))
