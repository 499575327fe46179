"""Assembling books: slugs, figures, assets, detected chapters, glossaries, registry edits, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.functions import text as T

# Which fields an edit of the registry needs, of all that it may not have.
EDIT_FIELDS = {
    "add_concept": (["canonical"], ["aliases"]),
    "add_alias": (["canonical", "alias"], []),
    "rename_canonical": (["from_canonical", "to_canonical"], []),
    "merge": (["winner", "loser"], []),
    "split": (["canonical", "into"], []),
}
ALL_FIELDS = ["canonical", "aliases", "alias", "from_canonical", "to_canonical", "winner", "loser", "into"]


#: What slugs that can meet have in common: all but the numbers at the end.
FAMILY = r"(?:-\d+)+\z"


def _numbered(rows: DataFrame, taken: DataFrame, book: str, place: str) -> DataFrame:
    """(book, place, slug) for (book, place, base): -2, -3 … where a slug is taken, whatever its case, in order.

    ``taken``: (book, slug) that are not to be had. Slugs meet within their family only. A family whose slugs are all
    one is numbered by a window; one with numbers of its own, or with more taken than its own name, is gone through once:
    its taken slugs, then its places in order. Families lie one behind the other in their partition.
    """
    family = lambda c: F.lower(F.regexp_replace(c, FAMILY, ""))
    given = rows.select(book, place, "base", family(F.col("base")).alias("family"))
    gone = taken.select(book, F.lower("slug").alias("slug")).distinct().withColumn("family", family(F.col("slug")))
    held = gone.groupBy(book, "family").agg(F.count("*").alias("held"), F.bool_and(F.col("slug") == F.col("family")).alias("bare"))
    own = given.groupBy(book, "family").agg(F.max((F.lower("base") != F.col("family")).cast("int")).alias("numbers"))
    plain = (F.col("numbers") == 0) & (F.col("held").isNull() | (F.col("held") == 1) & F.col("bare"))
    kinds = own.join(held, [book, "family"], "left").select(book, "family", "held", plain.alias("plain"))
    told = given.join(kinds, [book, "family"])
    number = F.row_number().over(Window.partitionBy(book, "family").orderBy(place)) + F.when(F.col("held").isNull(), 0).otherwise(1)
    by_window = told.where("plain").select(book, place, "base", number.alias("n")).select(book, place, F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string"))).alias("slug"))

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, after = None, set(), {}
        for batch in batches:
            made = []
            for of, name, free, at, base in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (of, name) != now:
                    now, used, after = (of, name), set(), {}
                if free:
                    slug, n = base, after.get(base.lower(), 2)
                    while slug.lower() in used:
                        slug, n = f"{base}-{n}", n + 1
                    after[base.lower()] = n
                    made.append((of, at, slug))
                    base = slug
                used.add(base.lower())
            columns = zip(*made) if made else [()] * 3
            kinds = [batch.schema.field(0).type, batch.schema.field(3).type, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [book, place, "slug"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    odd = gone.join(kinds.where("NOT plain").select(book, "family"), [book, "family"], "left_semi")
    steps = odd.select(book, "family", F.lit(False).alias("free"), F.lit(None).cast(kind[place]).alias(place), F.col("slug").alias("base")).unionByName(told.where("NOT plain").select(book, "family", F.lit(True).alias("free"), place, "base"))
    # Both parts may already lie by book and family, each in partitions of its own number, and Spark leaves out a repartition by the
    # columns that they lie by; one by a column made here is always done, so a family's taken slugs and places come into one task.
    dealt = steps.withColumn("_deal", F.xxhash64(book, "family")).repartition("_deal").drop("_deal")
    mended = dealt.sortWithinPartitions(book, "family", "free", place).mapInArrow(through, f"`{book}` {kind[book]}, `{place}` {kind[place]}, slug string")
    return by_window.unionByName(mended)


def slugs_of(chapters: DataFrame, book: str, place: str, title: str, reserved: list[str] | None = None) -> DataFrame:
    """(book, place, slug) of each chapter, unique within its book."""
    taken = F.explode(F.array(*map(F.lit, reserved or ["appendix"])))
    rows = chapters.select(book, place, T.path_segment(F.col(title), "chapter").alias("base"))
    return _numbered(rows, chapters.select(book).distinct().select(book, taken.alias("slug")), book, place)


def pinned_slugs(chapters: DataFrame, registry: DataFrame, book: str, place: str) -> DataFrame:
    """(book, place, slug): slugs that the registry has for a fingerprint stay; new chapters take theirs if no pin has it.

    ``chapters``: book, place, print, slug (unique within the book); ``registry``: book, print, pin. Chapters without a
    book meet no others: they have their pin or their own slug; one without a slug has none.
    """
    first = Window.partitionBy(book, F.lower("pin")).orderBy(place)
    pins = registry.select(F.col(book).alias("_book"), F.col("print").alias("_print"), "pin")
    pinned = chapters.join(pins, F.col(book).eqNullSafe(F.col("_book")) & (F.col("print") == F.col("_print")), "left").drop("_book", "_print")
    rows = pinned.withColumn("holds", F.col("pin").isNotNull() & (F.col(book).isNull() | (F.row_number().over(first) == 1)))
    alone = F.col(book).isNull() | F.col("slug").isNull()
    held = rows.where(F.col("holds") | alone).select(book, place, F.when(F.col("holds"), F.col("pin")).otherwise(F.col("slug")).alias("slug"))
    taken = held.where("slug IS NOT NULL").select(book, "slug").unionByName(chapters.select(book).distinct().withColumn("slug", F.lit("appendix")))
    return held.unionByName(_numbered(rows.where(~F.col("holds") & ~alone).select(book, place, F.col("slug").alias("base")), taken, book, place))


def file_stems(names: DataFrame, group: str, place: str, name: str) -> DataFrame:
    """(group, place, stem): a repeated stem gets 8 hex digits of its name's hash, and a number from 2 on where those repeat."""
    stem = T.path_segment(F.col(name))
    rows = names.select(group, place, name, stem.alias("stem"))
    again = F.row_number().over(Window.partitionBy(group, "stem").orderBy(place))
    rows = rows.withColumn("again", again)
    like = F.row_number().over(Window.partitionBy(group, "stem", name, F.col("again") > 1).orderBy(place))
    tail = F.concat(F.lit("-"), F.substring(F.sha2(name, 256), 1, 8), F.when(like > 1, F.concat(F.lit("-"), like.cast("string"))).otherwise(""))
    return rows.select(group, place, F.when(F.col("again") == 1, F.col("stem")).otherwise(F.concat("stem", tail)).alias("stem"))


def attached_assets(wanted: DataFrame, assets: DataFrame, raw: str, path: str) -> DataFrame:
    """``wanted`` with the asset of each raw path: equal paths first, then equal file names, the first asset by path."""
    clean = lambda c: F.regexp_replace(F.lower(F.replace(c, F.lit("\\"), F.lit("/"))), "^/+", "")
    base = lambda c: F.substring_index(c, "/", -1)
    rows = wanted.withColumn("folio_raw", clean(F.col(raw))).withColumn("folio_base", base(F.col("folio_raw")))
    known = assets.select(F.col(path).alias("asset"), clean(F.col(path)).alias("folio_raw"))
    whole = known.groupBy("folio_raw").agg(F.min("asset").alias("same_path"))
    named = known.groupBy(base(F.col("folio_raw")).alias("folio_base")).agg(F.min("asset").alias("same_name"))
    found = rows.join(whole, "folio_raw", "left").join(named, "folio_base", "left")
    return found.select(*wanted.columns, F.coalesce("same_path", "same_name").alias("asset"))


def chapter_figures(sources: DataFrame, chapter: str, text: str, generated: DataFrame) -> DataFrame:
    """(chapter, id, src, caption) of each figure with an image: those of the source first, then generated ones, the first of each id."""
    own = sources.select(chapter, F.posexplode(M.figure_tags(F.col(text))).alias("place", "figure")).select(chapter, F.lit(0).alias("rank"), "place", "figure.*")
    both = own.unionByName(generated.select(chapter, F.lit(1).alias("rank"), F.col("place"), "id", "src", "caption"))
    first = Window.partitionBy(chapter, "id").orderBy("rank", "place")
    return both.withColumn("n", F.row_number().over(first)).where("n = 1 AND trim(src) <> '' AND id <> ''").select(chapter, "id", "src", "caption")


def figure_window(text: Column, figure: Column) -> Column:
    """The section around a figure: from the heading before it to the next one; null where the text has no such figure."""
    at = F.instr(text, figure) - 1
    starts = F.transform(M.headings(text), lambda h: h["start"])
    low = F.coalesce(F.array_max(F.filter(starts, lambda s: s <= at)), F.lit(0))
    high = F.coalesce(F.array_min(F.filter(starts, lambda s: s > at)), F.length(text))
    return F.when(at >= 0, T.strip(F.substring(text, low + 1, high - low)))


def caption_candidates(blocks: DataFrame, page: str, place: str) -> DataFrame:
    """Figures with an asset and without a caption seen by a model, with the page's other texts: blocks have type, text, asset, seen."""
    figure = F.col("type").isin("image", "chart")
    nearby = blocks.where(~figure).groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col("text").alias("text")))), lambda b: b["text"]), " ").alias("nearby"))
    wanted = blocks.where(figure & (F.coalesce("asset", F.lit("")) != "") & ~F.coalesce(F.col("seen"), F.lit(False)))
    return wanted.join(nearby, page, "left").select(page, place, "asset", F.coalesce("nearby", F.lit("")).alias("nearby"))


def detected_chapters(summaries: DataFrame, book: str, place: str) -> DataFrame:
    """One row per detected chapter of summaries (refs, title, detected_id, chapters with title and refs), numbered in order.

    A summary's only chapter keeps the summary's references and id; of several each has its own, or the summary's.
    """
    rows = summaries.select("*", F.posexplode("chapters").alias("number", "chapter"))
    alone = F.size("chapters") == 1
    numbered = F.row_number().over(Window.partitionBy(book).orderBy(place, "number"))
    refs = F.when(alone | F.col("chapter.refs").isNull() | (F.size("chapter.refs") == 0), F.col("refs")).otherwise(F.col("chapter.refs"))
    named = F.coalesce(F.when(alone, F.col("detected_id")), F.concat(F.lit("ch"), F.lpad(numbered.cast("string"), F.greatest(F.lit(2), F.length(numbered.cast("string"))), F.lit("0"))))
    return rows.select(book, place, named.alias("chapter_id"), F.coalesce("chapter.title", "title").alias("title"), refs.alias("refs"))


def glossary_order(concepts: DataFrame, chapters: DataFrame, book: str) -> DataFrame:
    """Concepts (name, first_chapter) with their place: by their first chapter's number, unknown ones last, then by key."""
    known = concepts.join(chapters.select(book, F.col("chapter_id").alias("first_chapter"), "number"), [book, "first_chapter"], "left")
    order = Window.partitionBy(book).orderBy(F.coalesce("number", F.lit(1 << 30)), T.concept_key(F.col("name")), "name")
    return known.select(book, "name", F.row_number().over(order).alias("place"))


def edit_faults() -> Column:
    """Why an edit of the registry (op and the fields of ``ALL_FIELDS``) is none: needed fields that are blank, others that are not."""
    filled = lambda c: F.coalesce((F.size(c) > 0) if c in ("aliases", "into") else (F.trim(c) != ""), F.lit(False))
    faults = F.when(F.col("op").isNull() | ~F.col("op").isin(list(EDIT_FIELDS)), F.array(F.lit("unknown op")))
    for op, (needed, allowed) in EDIT_FIELDS.items():
        blank = [F.when(~filled(c), F.lit(f"needs {c}")) for c in needed]
        spare = [F.when(filled(c), F.lit(f"must not set {c}")) for c in ALL_FIELDS if c not in needed + allowed]
        faults = faults.when(F.col("op") == op, F.array_compact(F.array(*blank, *spare)))
    return faults


def report(issues: DataFrame, book: str, place: str) -> DataFrame:
    """(book, report): a book's check report in Markdown; its issues are as many as its pages have."""
    line = F.concat(F.lit("- `"), "severity", F.lit("` `"), "code", F.lit("` owner `"), "owner", F.lit("`: "), "message")
    rows = issues.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), line.alias("line")))).alias("all"), F.max((F.col("severity") == "error").cast("int")).alias("bad"))
    status = F.when(F.col("bad") == 1, "failed").otherwise("passed")
    return rows.select(book, F.concat(F.lit("# Check Report\n\nStatus: `"), status, F.lit("`\n\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("\n")).alias("report"))


def cited_sources(sources: DataFrame, text: DataFrame, pages: DataFrame, answer: str) -> DataFrame:
    """(answer, ref, kind): of the sources given with an answer those that it cites, each once, then the pages that it cites and that exist.

    ``sources``: answer, place, ref; ``text``: answer, refs, slugs (arrays); ``pages``: slug.
    """
    cited = sources.join(text, answer).where(F.array_contains("refs", F.col("ref"))).groupBy(answer, "ref").agg(F.min("place").alias("place"))
    linked = text.select(answer, F.explode(F.array_distinct("slugs")).alias("slug")).join(pages.select("slug").distinct(), "slug")
    return cited.select(answer, "ref", F.lit("source").alias("kind")).unionByName(linked.select(answer, F.concat(F.lit("page:"), "slug").alias("ref"), F.lit("page").alias("kind")))
