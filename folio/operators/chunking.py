"""Chunking of Markdown as projections: heading ancestry, paragraph packing, retrieval chunks, budgeted chunks.

Everything is an expression over one row's text, so no plan here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T

HEADING = r"(?m)^(?=#{1,6}\s+\S)"
_PARTS = "array<string>"


def slices(text: Column, width: int) -> Column:
    """Consecutive slices of at most ``width`` characters; one empty slice for an empty text."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / width)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * width + 1, F.lit(width)))


def packed(text: Column, most: int = 1200) -> Column:
    """Paragraphs packed greedily into parts of at most ``most`` characters; longer paragraphs are sliced; no blank parts."""
    start = F.struct(F.array().cast(_PARTS).alias("parts"), F.lit("").alias("now"))

    def add(acc: Column, paragraph: Column) -> Column:
        more = F.when(acc["now"] == "", paragraph).otherwise(T.strip(F.concat(acc["now"], F.lit("\n\n"), paragraph)))
        done = F.when(acc["now"] == "", acc["parts"]).otherwise(F.concat(acc["parts"], F.array(acc["now"])))
        long = F.length(paragraph) > most
        fresh = F.struct(F.when(long, F.concat(done, slices(paragraph, most))).otherwise(done).alias("parts"), F.when(long, F.lit("")).otherwise(paragraph).alias("now"))
        return F.when(F.length(more) <= most, F.struct(acc["parts"].alias("parts"), more.alias("now"))).otherwise(fresh)

    folded = F.aggregate(F.split(text, r"\n\s*\n", -1), start, add, lambda acc: F.concat(acc["parts"], F.array(acc["now"])))
    return F.filter(F.transform(F.when(F.length(text) <= most, F.array(text)).otherwise(folded), T.strip), lambda p: p != "")


def sections(body: Column) -> Column:
    """array<(heading_path, slug, raw)>: sections of a text by its headings; text before the first is ``intro``."""
    start = F.struct(F.array().cast(_PARTS).alias("stack"), F.array().cast("array<struct<heading_path: string, slug: string, raw: string>>").alias("found"))

    def one(path: Column, slug: Column, raw: Column) -> Column:
        return F.array(F.struct(path.alias("heading_path"), slug.alias("slug"), raw.alias("raw")))

    def add(acc: Column, piece: Column) -> Column:
        level = F.length(F.regexp_extract(piece, r"^(#{1,6})\s", 1))
        title = F.trim(F.regexp_extract(piece, r"(?m)^#{1,6}\s+(.+?)\s*$", 1))
        stack = F.concat(F.slice(acc["stack"], F.lit(1), F.greatest(level - 1, F.lit(0))), F.array(title))
        under = F.struct(stack.alias("stack"), F.concat(acc["found"], one(F.array_join(stack, " > "), T.section_slug(title), T.strip(piece))).alias("found"))
        intro = F.when(T.strip(piece) == "", acc["found"]).otherwise(F.concat(acc["found"], one(F.lit(None).cast("string"), F.lit("intro"), T.strip(piece))))
        return F.when(level > 0, under).otherwise(F.struct(acc["stack"].alias("stack"), intro.alias("found")))

    parted = F.aggregate(F.split(body, HEADING, -1), start, add, lambda acc: acc["found"])
    return F.when(body.rlike(HEADING), parted).otherwise(one(F.lit(None).cast("string"), F.lit(None).cast("string"), body))


def rag_chunks(pages: DataFrame, most: int = 1200) -> DataFrame:
    """Chunks of pages (id, title, chapter_id, summary, body, source_refs): chunk_id, page_id, chapter_id, section_id,
    chunk_index, heading_path, text, source_refs, token_count.

    A summary comes first; sections follow in order, without navigation and blank ones; a page without any chunk is one
    chunk. Null summaries and bodies are empty.
    """
    body, summary = F.coalesce("body", F.lit("")), T.strip(F.coalesce("summary", F.lit("")))
    kind = "array<struct<section_id: string, heading_path: string, text: string, source_refs: array<string>>>"

    def chunk(section: Column, path: Column, text: Column, refs: Column) -> Column:
        return F.struct(section.alias("section_id"), path.alias("heading_path"), text.alias("text"), refs.alias("source_refs"))

    shown = F.filter(sections(body), lambda s: F.coalesce(F.lower(F.trim(F.element_at(F.split(s["heading_path"], " > "), -1))) != "referenced by", F.lit(True)))
    cut = F.transform(shown, lambda s: F.struct(s.alias("s"), packed(T.plain_text(s["raw"]), most).alias("ps")))
    parts = F.flatten(F.transform(cut, lambda x: F.transform(x["ps"], lambda p: F.struct(x["s"].alias("s"), p.alias("p"), F.size(x["ps"]).alias("n")))))
    first = F.when(summary != "", F.array(chunk(F.lit("summary"), F.concat("title", F.lit(" > Summary")), summary, F.col("source_refs")))).otherwise(F.array().cast(kind))
    shift = F.size("folio_first")
    listed = pages.withColumn("folio_first", first).withColumn("folio_parts", parts)
    later = F.transform("folio_parts", lambda x, i: chunk(F.when(x["n"] > 1, F.concat(x["s"]["slug"], F.lit("-"), F.lpad((i + shift + 1).cast("string"), 2, "0"))).otherwise(x["s"]["slug"]), x["s"]["heading_path"], x["p"], T.source_refs(x["s"]["raw"])))
    listed = listed.withColumn("folio_all", F.concat("folio_first", later))
    lone = F.array(chunk(F.lit(None).cast("string"), F.col("title"), T.plain_text(body), F.col("source_refs")))
    rows = listed.select(F.col("id").alias("page_id"), "chapter_id", F.posexplode(F.when(F.size("folio_all") > 0, F.col("folio_all")).otherwise(lone)).alias("chunk_index", "c"))
    return rows.select(F.format_string("%s#chunk-%03d", F.col("page_id").cast("string"), F.col("chunk_index") + 1).alias("chunk_id"), "page_id", "chapter_id", "c.section_id", "chunk_index", "c.heading_path", "c.text", "c.source_refs", T.token_count(F.col("c.text")).alias("token_count"))


_HIDDEN = "\uE000"


def _masked(text: Column) -> Column:
    """Heading signs inside fenced code as a private character; the length stays."""
    blocks = F.split(text, r"(?m)^(?=[ \t]*(?:```|~~~))", -1)
    return F.array_join(F.transform(blocks, lambda b, i: F.when(i % 2 == 1, F.regexp_replace(b, "(?m)^#", _HIDDEN)).otherwise(b)), "")


def _windows(text: Column, budget: int, overlap: int) -> Column:
    """array<(start, piece)>: windows of nine tenths of the budget, cut behind a paragraph or line, with an overlap."""
    per = F.greatest(F.lit(1.0), F.length(text) / F.greatest(F.lit(1), F.floor(F.length(text) / 3)))
    width = F.greatest(F.lit(1), F.floor(per * budget * 0.9)).cast("int")
    back = F.least(width - 1, F.floor(per * overlap).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, piece: string>>").alias("found"))

    def add(acc: Column, _: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, width)
        last = acc["at"] + width >= F.length(text)
        kept = F.length(F.regexp_extract(piece, r"(?s)^(.+\n\n)", 1))
        line = F.length(F.regexp_extract(piece, r"(?s)^(.+\n)", 1))
        n = F.when(last, F.length(piece)).when(kept > 0, kept).when(line > 0, line).otherwise(F.length(piece))
        found = F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), F.substring(piece, F.lit(1), n).alias("piece"))))
        step = F.struct(F.when(last, F.length(text)).otherwise(F.greatest(acc["at"] + n - back, acc["at"] + 1)).alias("at"), found.alias("found"))
        return F.when(acc["at"] >= F.length(text), acc).otherwise(step)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), start, add, lambda acc: acc["found"])


def budgeted(docs: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, pos, heading_path, char_start, char_end, text, source_refs): pieces of at most ``budget`` tokens (three
    characters each), split at the shallowest headings first; a piece without finer headings is windowed.

    Headings inside fenced code don't count; blank pieces are left out. Offsets are those of the original text.
    """
    title = F.trim(F.regexp_extract("t", r"(?s)^\s*#{1,6}[ \t]+([^\n]*)", 1))
    opens = F.col("t").rlike(r"^\s*#{1,6}[ \t]+\S")
    over = F.floor(F.length("t") / 3) > budget
    pieces = docs.select(F.col(key).alias("key"), _masked(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.lit(0).alias("at"), F.array().cast(_PARTS).alias("outer"))
    for level in range(1, 7):
        cut = rf"(?m)^(?=#{{{level}}}[ \t]+\S)"
        path = F.when(opens, F.concat("outer", F.array(title))).otherwise(F.col("outer"))
        parts = pieces.withColumn("path", path).withColumn("parts", F.when(over, F.filter(F.split("t", cut, -1), lambda p: p != "")).otherwise(F.array("t")))
        parts = parts.select("key", "at", "outer", "path", "parts", F.posexplode("parts").alias("i", "p"))
        before = F.aggregate(F.slice("parts", F.lit(1), F.col("i")), F.lit(0), lambda n, p: n + F.length(p))
        pieces = parts.select("key", F.col("p").alias("t"), (F.col("at") + before).alias("at"), F.when(F.col("i") == 0, F.col("outer")).otherwise(F.col("path")).alias("outer"))
    overlap = min(1000, max(1, budget // 50))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("t").alias("piece")))
    path = F.when(opens, F.concat("outer", F.array(title))).otherwise(F.col("outer"))
    rows = pieces.select("key", "at", path.alias("heading_path"), F.explode(F.when(over, _windows(F.col("t"), budget, overlap)).otherwise(whole)).alias("w"))
    rows = rows.select("key", "heading_path", (F.col("at") + F.col("w.start")).alias("char_start"), F.replace("w.piece", F.lit(_HIDDEN), F.lit("#")).alias("text")).where(T.strip(F.col("text")) != "")
    return rows.select(F.col("key").alias(key), "heading_path", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "text", F.regexp_extract_all("text", F.lit(T.SOURCE_REF), F.lit(1)).alias("source_refs"))
