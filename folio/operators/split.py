"""Splitting sources into chapters: fragments between reference marks, assignment to chapters, boundary pages, coverage.

Chapters are few and come from an approved structure, so their keywords enter the plan as literals; references are
joined by prefix and number range, and only the fragments' keys are shuffled for it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T

#: Fixed value: how a chapter's heading begins.
CHAPTER_HEADING = r"(?im)^#{0,6}\s*chapter\s+\d+"


@dataclass(frozen=True)
class Chapter:
    """One leaf of the approved structure; chapters are ordered."""

    chapter_id: str
    title: str
    topics: tuple[str, ...] = ()
    source_refs: tuple[str, ...] = field(default=())


def fragments(sources: DataFrame, path: str, text: str) -> DataFrame:
    """(path, pos, source_ref, body): the text behind each reference mark; a source without marks is one fragment.

    Blank fragments are left out; null texts are empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    refs = F.regexp_extract_all(whole, F.lit(T.SOURCE_REF), F.lit(1))
    bodies = F.slice(F.split(whole, T.SOURCE_REF, -1), F.lit(2), F.size(refs))
    marked = F.zip_with(refs, bodies, lambda r, b: F.struct(r.alias("source_ref"), T.strip(b).alias("body")))
    single = F.array(F.struct(F.concat(F.col(path), F.lit("-text")).alias("source_ref"), T.strip(whole).alias("body")))
    pieces = sources.select(F.col(path).alias("path"), F.posexplode(F.when(F.size(refs) > 0, marked).otherwise(single)).alias("pos", "f"))
    return pieces.select("path", "pos", "f.source_ref", "f.body").where("body <> ''")


def reference_ranges(specs: DataFrame) -> DataFrame:
    """(chapter_id, ord, exact, prefix, low, high) from (chapter_id, ord, source_refs); ``a-1..a-9`` is a range."""
    one = specs.select("chapter_id", "ord", F.explode("source_refs").alias("r"))
    low, high = F.trim(F.split_part("r", F.lit(".."), F.lit(1))), F.trim(F.split_part("r", F.lit(".."), F.lit(2)))
    ranged = F.contains("r", F.lit("..")) & T.ref_prefix(low).eqNullSafe(T.ref_prefix(high))
    return one.select(
        "chapter_id",
        "ord",
        F.trim("r").alias("exact"),
        F.when(ranged, T.ref_prefix(low)).alias("prefix"),
        F.when(ranged, T.ref_number(low)).alias("low"),
        F.when(ranged, T.ref_number(high)).alias("high"),
    )


def by_reference(rows: DataFrame, ref: str, specs: DataFrame) -> DataFrame:
    """(ref, chapter_id): the first chapter whose references name the row's or hold it in a range; each ref once."""
    refs = rows.select(F.col(ref).alias("ref")).distinct().select("ref", T.ref_prefix(F.col("ref")).alias("p"), T.ref_number(F.col("ref")).alias("n"))
    ranges = reference_ranges(specs)
    ranges = F.broadcast(ranges)  # one row per reference of the approved structure, which the driver holds
    exact = refs.join(ranges.select("chapter_id", "ord", "exact"), F.col("ref") == F.col("exact")).select("ref", "chapter_id", "ord")
    within = refs.join(ranges.where("prefix IS NOT NULL").select("chapter_id", "ord", "prefix", "low", "high"), (F.col("p") == F.col("prefix")) & F.col("n").between(F.col("low"), F.col("high")))
    return exact.unionByName(within.select("ref", "chapter_id", "ord")).groupBy("ref").agg(F.min_by("chapter_id", "ord").alias("chapter_id"))


def by_keywords(body: Column, chapters: list[Chapter]) -> Column:
    """(chapter_id, confidence) of the chapter most of whose keywords the body holds, the first on ties; null for none."""
    low, found = F.lower(body), []
    for at, c in enumerate(chapters):
        terms = T.keyword_list(" ".join([c.title, *c.topics]))
        n = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
        sure = F.least(F.lit(0.85), F.lit(0.35) + n * 0.1)
        found.append(F.when(n > 0, F.struct(sure.alias("confidence"), F.lit(-at).alias("ord"), F.lit(c.chapter_id).alias("chapter_id"))))
    best = found[0] if len(found) == 1 else F.greatest(*found)
    return F.when(best.isNotNull(), F.struct(best["chapter_id"].alias("chapter_id"), best["confidence"].alias("confidence")))


def referenced(ref: Column, chapters: list[Chapter]) -> Column:
    """The first chapter whose references name a reference or hold it in a range; null for none. The structure is small: literals of the plan."""
    prefix, number = T.ref_prefix(ref), T.ref_number(ref)
    found = F.lit(None).cast("string")
    for c in reversed(chapters):
        parts = [[x.strip() for x in r.split("..")] for r in c.source_refs]
        ranges = [(re.fullmatch(r"(.*?)(\d+)", x[0]), re.fullmatch(r"(.*?)(\d+)", x[1])) for x in parts if len(x) == 2]
        within = [(prefix == low[1]) & number.between(int(low[2]), int(high[2])) for low, high in ranges if low and high and low[1] == high[1]]
        named = ref.isin([r.strip() for r in c.source_refs]) if c.source_refs else F.lit(False)
        found = F.when(reduce(Column.__or__, within, named), F.lit(c.chapter_id)).otherwise(found)
    return found


def assign(parts: DataFrame, chapters: list[Chapter]) -> DataFrame:
    """Adds chapter_id, confidence and reason: by reference, else by keywords, else the appendix. A map over rows: no text is shuffled."""
    joined = parts.withColumn("by_ref", referenced(F.col("source_ref"), chapters))
    joined = joined.withColumn("kw", F.when(F.col("by_ref").isNull(), by_keywords(F.col("body"), chapters)))
    return joined.select(
        *parts.columns,
        F.coalesce("by_ref", F.col("kw.chapter_id"), F.lit("appendix")).alias("chapter_id"),
        F.when(F.col("by_ref").isNotNull(), 1.0).otherwise(F.coalesce(F.col("kw.confidence"), F.lit(0.0))).alias("confidence"),
        F.when(F.col("by_ref").isNotNull(), "source_ref").when(F.col("kw").isNotNull(), "keyword").otherwise("unassigned").alias("reason"),
    )


def is_boundary(body: Column) -> Column:
    """Whether a chapter's heading stands in the body with text before it."""
    at = F.regexp_instr(body, F.lit(CHAPTER_HEADING))
    return (at > 1) & (T.strip(F.substring(body, F.lit(1), at - 1)) != "")


def carry(assigned: DataFrame, chapters: list[Chapter]) -> DataFrame:
    """Boundary fragments once more under the chapter that follows theirs, with reason ``boundary``; no shuffle."""
    ids = [c.chapter_id for c in chapters]
    if len(ids) < 2:
        return assigned
    follows = F.create_map(*(F.lit(x) for pair in zip(ids, ids[1:]) for x in pair))
    after = F.when(is_boundary(F.col("body")), F.element_at(follows, F.col("chapter_id")))
    both = F.filter(F.array(F.struct("chapter_id", "reason"), F.when(after.isNotNull(), F.struct(after.alias("chapter_id"), F.lit("boundary").alias("reason")))), lambda x: x.isNotNull())
    rest = [c for c in assigned.columns if c not in ("chapter_id", "reason")]
    return assigned.select(*rest, F.explode(both).alias("to")).select(*rest, "to.chapter_id", "to.reason")


def chapter_texts(assigned: DataFrame, chapters: list[Chapter]) -> DataFrame:
    """(chapter_id, path, pos, block): the parts of all chapters' texts, each behind its reference mark, a heading before all of them.

    A chapter is its blocks in order of path and place. They stay rows: an appendix may hold most of a corpus, so files
    are written part by part (``write.partitionBy("chapter_id")``, sorted within partitions), never in one cell.
    """
    spark = assigned.sparkSession
    titles = [(c.chapter_id, "", -1, f"# {c.title}") for c in chapters] + [("appendix", "", -1, "# Appendix")]
    heads = spark.createDataFrame(titles, "chapter_id string, path string, pos int, block string")
    block = F.concat(F.lit("<!-- source_ref: "), "source_ref", F.lit(" -->\n\n"), "body")
    return heads.unionByName(assigned.select("chapter_id", "path", "pos", block.alias("block")))
