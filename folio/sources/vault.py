"""Readers of vaults, input folders and content lists, and the writers of exports and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T

_FRONT = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"
TEXT_KINDS = ["txt", "md", "markdown"]


def read_vault(spark: SparkSession, root: str, pattern: str = "*.mdx") -> DataFrame:
    """(path, slug, type, title, chapter_id, order_index, summary, body, source_refs): pages of a vault, one file each.

    Frontmatter is a block of ``key: value`` lines; values that are lists or maps stay as they are written. A block
    without an end is text.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("value"))
    front = F.regexp_extract("value", _FRONT, 1)
    field = lambda name: F.nullif(F.regexp_replace(F.trim(F.regexp_extract("front", rf"(?m)^{name}:[ \t]*(.*)$", 1)), "^[\"']|[\"']$", ""), F.lit(""))
    rows = rows.withColumn("front", front).withColumn("body", F.regexp_replace("value", _FRONT, ""))
    slug = F.regexp_replace(F.regexp_replace("path", r"^.*?/(?=(?:chapters|concepts)/)", ""), r"(?:/index)?\.mdx?$", "")
    heading = F.nullif(F.trim(F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1)), F.lit(""))
    kind = F.when(F.contains("path", F.lit("/chapters/")), "chapter").when(F.contains("path", F.lit("/concepts/")), "concept").otherwise("page")
    return rows.select("path", slug.alias("slug"), F.coalesce(field("type"), kind).alias("type"), F.coalesce(field("title"), heading, slug).alias("title"), field("chapter_id").alias("chapter_id"), field("order_index").try_cast("int").alias("order_index"), field("summary").alias("summary"), "body", T.source_refs(F.col("body")).alias("source_refs"))


def read_inputs(spark: SparkSession, root: str) -> DataFrame:
    """(path, source_id, kind, sha256, content): every file of an input folder; kind is text, document or unsupported."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.when(ext.isin(*TEXT_KINDS), "text").when(ext.isin("pdf", "pptx", "docx", "ppt", "doc"), "document").otherwise("unsupported")
    return files.select("path", T.source_id_from_stem(F.regexp_replace(name, r"\.[^.]+$", "")).alias("source_id"), kind.alias("kind"), F.sha2("content", 256).alias("sha256"), "content")


def text_sources(inputs: DataFrame) -> DataFrame:
    """(source_id, markdown): text inputs behind one reference mark."""
    body = T.clean_markdown(F.decode("content", "UTF-8"))
    return inputs.where("kind = 'text'").select("source_id", F.concat(F.lit("<!-- source_ref: "), "source_id", F.lit("-text -->\n\n"), body).alias("markdown"))


def content_blocks(lists: DataFrame, source: str, json: str) -> DataFrame:
    """(source_id, page_idx, block_id, type, text): blocks of content lists, flat with page_idx or as a list of pages.

    Block numbers go on over blocks that are left out as blank; unreadable lists give no rows.
    """
    block = "type: string, text: string, img_path: string, page_idx: int"
    flat = F.from_json(json, f"array<struct<{block}>>")
    paged = F.from_json(json, f"array<array<struct<{block}>>>")
    pages = F.flatten(F.transform(paged, lambda page, i: F.transform(page, lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"), b["img_path"].alias("img_path"), F.coalesce(b["page_idx"], i).alias("page_idx")))))
    nested = F.col(json).rlike(r"^\s*\[\s*\[")
    rows = lists.select(F.col(source).alias("source_id"), F.posexplode(F.when(nested, pages).otherwise(flat)).alias("at", "b")).where("b.type IS NOT NULL")
    rows = rows.select("source_id", F.coalesce("b.page_idx", F.lit(0)).alias("page_idx"), "at", "b.type", F.coalesce("b.text", F.lit("")).alias("text"))
    first = rows.groupBy("source_id", "page_idx").agg(F.min("at").alias("first"))
    numbered = rows.join(first, ["source_id", "page_idx"])
    return numbered.where((T.strip(F.col("text")) != "") | F.col("type").isin("image", "table")).select("source_id", "page_idx", F.format_string("%s-p%03d-b%03d", "source_id", F.col("page_idx") + 1, F.col("at") - F.col("first") + 1).alias("block_id"), "type", "text")


def fallback_pages(sources: DataFrame, source: str, text: str) -> DataFrame:
    """(source_id, page_idx, body): pages by form feeds; a text without any is one page."""
    return sources.select(F.col(source).alias("source_id"), F.posexplode(F.split(text, "\f", -1)).alias("page_idx", "body")).select("source_id", "page_idx", T.strip(F.col("body")).alias("body")).where("body <> ''")


def flashcard_lines(cards: DataFrame, front: str, back: str, tags: str) -> DataFrame:
    """Cards with column ``line``: quoted fields joined by commas; cards without either face are left out."""
    face = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    return cards.where((face(front) != "") | (face(back) != "")).withColumn("line", F.concat_ws(",", T.csv_field(face(front)), T.csv_field(face(back)), T.csv_field(F.array_join(F.array_distinct(F.transform(tags, lambda t: F.regexp_replace(F.trim(t), r"\s+", "_"))), " "))))


def write_flashcards(cards: DataFrame, to: str, deck: str, order: list[str]) -> None:
    """Text files of the lines in order, partition by partition, the directives first in a file of their own."""
    spark = cards.sparkSession
    # The directives that flashcard programs read.
    head = ["#separator:Comma", "#html:true", f"#deck:{deck}", "#tags column:3", "#columns:Front,Back,Tags"]
    spark.createDataFrame([(h,) for h in head], "line string").coalesce(1).write.mode("overwrite").text(f"{to}/head")
    cards.orderBy(*order).select("line").write.mode("overwrite").text(f"{to}/cards")


def snapshot(rows: DataFrame) -> DataFrame:
    """(line): every row as JSON, ordered by all columns."""
    return rows.orderBy(*rows.columns).select(F.to_json(F.struct("*")).alias("line"))


def replace_table(rows: DataFrame, root: str, name: str) -> str:
    """Write a full new version of a table, then add a pointer to it: readers see the old one or the new one, whole.

    Pointers are only ever added, one file each, and a file appears at once or not at all; the latest one holds.
    """
    import time
    import uuid

    version = f"{root}/{name}/version-{uuid.uuid4().hex}"
    rows.write.parquet(version)
    rows.sparkSession.createDataFrame([(time.time_ns(), version)], "at long, path string").coalesce(1).write.mode("append").json(f"{root}/{name}/pointers")
    return version


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    pointers = spark.read.schema("at long, path string").json(f"{root}/{name}/pointers")
    return spark.read.parquet(pointers.orderBy(F.desc("at"), "path").first().path)
