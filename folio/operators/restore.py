"""State of a run found again: chapters on disk against the order that was kept, and the stage to start from."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Concepts of a section, and the part of embedded images that get a caption.
CONCEPTS_PER_SECTION, CAPTIONED = 3.5, 0.114


class SplitState(NamedTuple):
    """chapters: (book, place, chapter_id, path); faults: (book, chapter_id, fault). A book with faults has no chapters."""

    chapters: DataFrame
    faults: DataFrame


def split_state(folders: DataFrame, order: DataFrame, titles: DataFrame | None = None) -> SplitState:
    """The chapters of each book as they were split, in the order that was kept.

    ``folders``: (book, chapter_id, path), what is on disk. ``order``: (book, ord, chapter_id); where a book has none,
    that of its ``titles``. Chapters of the order that are not on disk are passed over. A folder that the order does not
    name is stale, and a book without any order can't be read: both are faults, never guessed.
    """
    named = order.where(F.coalesce("chapter_id", F.lit("")) != "").select("book", "ord", "chapter_id")
    if titles is not None:
        named = named.unionByName(titles.join(named.select("book").distinct(), "book", "left_anti").select("book", "ord", "chapter_id"))
    first = named.groupBy("book", "chapter_id").agg(F.min("ord").alias("ord"))
    met = folders.join(first, ["book", "chapter_id"], "left")
    known = met.groupBy("book").agg(F.count("ord").alias("known"))
    whole = met.join(known, "book").join(named.select("book", F.lit(True).alias("ordered")).distinct(), "book", "left")
    lost = whole.where("ordered IS NULL").select("book", F.lit("").alias("chapter_id"), F.lit("no chapter order, run the split again").alias("fault")).distinct()
    stale = whole.where("ordered AND ord IS NULL").select("book", "chapter_id", F.lit("not in the chapter order, run the split again").alias("fault"))
    faults = lost.unionByName(stale)
    good = met.where("ord IS NOT NULL").join(faults.select("book").distinct(), "book", "left_anti")
    place = F.row_number().over(Window.partitionBy("book").orderBy("ord"))
    return SplitState(good.select("book", place.alias("place"), "chapter_id", "path"), faults)


def restart_stage(has_sources: Column, stop_after: Column, has_manifests: Column) -> Column:
    """Where a run whose configuration changed starts again: behind the conversion if its results are whole and wanted."""
    return F.when(has_sources & ~F.coalesce(stop_after == "convert", F.lit(False)) & has_manifests, "caption").otherwise("convert")


def scale(sections: Column, concepts: Column, images: Column, pages: Column, slides: Column, pages_a_section: float = 21.6, slides_a_section: float = 3.2) -> Column:
    """(sections, concepts, images, basis): what was counted where there is a structure, else what the input promises."""
    guessed = F.round(pages / pages_a_section + slides / slides_a_section).cast("int")
    all_ = F.coalesce(sections, guessed)
    known = F.coalesce(F.nullif(concepts, F.lit(0)), F.bround(all_ * CONCEPTS_PER_SECTION).cast("int"))
    shown = F.when(sections.isNotNull(), known).otherwise(F.bround(all_ * CONCEPTS_PER_SECTION).cast("int"))
    return F.struct(all_.alias("sections"), shown.alias("concepts"), F.bround(images * CAPTIONED).cast("int").alias("images"), F.when(sections.isNotNull(), "structure").otherwise("input scan").alias("basis"))


def recorded_uses(uses: DataFrame, variants: DataFrame) -> DataFrame:
    """(book, chapter_id, place, canonical): the concepts that a chapter names, each once, in the order it names them.

    ``uses``: (book, chapter_id, ord, name), ``variants``: (book, variant, canonical) with names and keys. Of repeated
    records of a chapter the names of all count; a name that no concept has is left out.
    """
    from folio.functions import text as T

    keyed = uses.withColumn("variant", T.concept_key(F.col("name")))
    met = keyed.join(variants.select("book", "variant", "canonical"), ["book", "variant"])
    first = met.groupBy("book", "chapter_id", "canonical").agg(F.min("ord").alias("ord"))
    return first.select("book", "chapter_id", F.row_number().over(Window.partitionBy("book", "chapter_id").orderBy("ord", "canonical")).alias("place"), "canonical")
