"""Concepts: the glossary, the ordered registry of edits, alias maps, and the audit of links between pages.

What does not depend on order is grouped and joined. The registry's edits do depend on it: they are folded per book,
so that books run side by side; a book's edits are few (hundreds of concepts).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T


def glossary(names: DataFrame, book: str, name: str, chapter: str, order: str) -> DataFrame:
    """(book, key, canonical, aliases, first_chapter): one concept per key; the first spelling is canonical, others are aliases."""
    keyed = names.withColumn("key", T.concept_key(F.col(name))).where("key <> ''")
    rows = keyed.groupBy(book, "key").agg(F.min_by(F.struct(name, chapter), F.struct(order, name)).alias("first"), F.collect_set(name).alias("spellings"))
    return rows.select(book, "key", F.col(f"first.{name}").alias("canonical"), F.array_sort(F.array_except("spellings", F.array(f"first.{name}"))).alias("aliases"), F.col(f"first.{chapter}").alias("first_chapter"))


def alias_map(entries: DataFrame, order: str) -> DataFrame:
    """(variant, canonical): each name and its key; where two concepts claim a variant, the later one by ``order`` has it."""
    names = entries.select("canonical", order, F.posexplode(F.concat(F.array("canonical"), "aliases")).alias("at", "name"))
    both = names.select("canonical", order, "at", F.posexplode(F.array(F.col("name"), T.concept_key(F.col("name")))).alias("kind", "variant")).where("variant <> ''")
    return both.groupBy("variant").agg(F.max_by("canonical", F.struct(order, "at", "kind")).alias("canonical"))


def known_and_new(candidates: DataFrame, name: str, variants: DataFrame) -> DataFrame:
    """Candidates with the canonical name that their key has, or null: those are to be added."""
    keys = variants.select(F.col("variant").alias("folio_key"), "canonical")
    return candidates.join(keys, T.concept_key(F.col(name)) == F.col("folio_key"), "left").drop("folio_key")


#: Rows of finished books that are handed on at once.
FOLDED = 10_000


def _key(name: str | None) -> str:
    return "".join(c for c in (name or "").casefold() if c.isalnum())


class _Book:
    """The concepts of one book while its edits are applied: by key, with the chapter that owns each spelling."""

    def __init__(self) -> None:
        self.concepts: dict[str, dict] = {}
        self.owners: dict[str, str] = {}
        self.chapters: dict[str, int] = {}

    def age(self, chapter: str) -> int:
        return self.chapters.get(chapter, 1 << 30)

    def find(self, name: str | None) -> str | None:
        key = _key(name)
        if key in self.concepts or not key:
            return key or None
        return next((k for k, c in reversed(self.concepts.items()) if key in map(_key, c["aliases"])), None)

    def own(self, name: str, chapter: str) -> None:
        if _key(name) and chapter:
            self.owners[_key(name)] = chapter  # the latest edit that names a spelling says whose it is

    def call(self, concept: dict, alias: str | None, chapter: str) -> None:
        alias = (alias or "").strip()
        if alias and _key(alias) != _key(concept["canonical"]):
            concept["aliases"] += [] if alias in concept["aliases"] else [alias]
            self.own(alias, chapter)

    def put(self, name: str, aliases: list[str], chapter: str) -> dict:
        self.concepts[_key(name)] = made = {"canonical": name, "aliases": [], "chapter": chapter}
        self.own(name, chapter)
        for alias in aliases:
            self.call(made, alias, chapter)
        return made

    def apply(self, edit, chapter: str) -> None:
        at = self.find(edit.name)
        at = at if at in self.concepts else None
        other = (edit.other or "").strip()
        if edit.op == "add_concept":
            if at is None and _key(edit.name):
                self.put(edit.name.strip(), list(edit.aliases), chapter)
            elif at is not None:
                for alias in edit.aliases:
                    self.call(self.concepts[at], alias, self.concepts[at]["chapter"])
        elif at is None:
            return
        elif edit.op == "add_alias":
            self.call(self.concepts[at], other, self.concepts[at]["chapter"])
        elif edit.op == "rename_canonical" and _key(other):
            moved = self.concepts.pop(at)
            old, moved["canonical"] = moved["canonical"], other
            moved["aliases"] = [a for a in moved["aliases"] if _key(a) != _key(other)]
            self.call(moved, old, moved["chapter"])
            self.concepts[_key(other)] = moved
        elif edit.op == "merge":
            loser = self.find(other)
            if loser in self.concepts and loser != at:
                gone, winner = self.concepts.pop(loser), self.concepts[at]
                for name in (gone["canonical"], *gone["aliases"]):
                    self.call(winner, name, gone["chapter"])
                winner["chapter"] = min(winner["chapter"], gone["chapter"], key=self.age)
        elif edit.op == "split" and len(edit.into):
            gone = self.concepts.pop(at)
            for target in edit.into:
                names = [target["canonical"], *target["aliases"]]
                if _key(target["canonical"]):
                    owners = [self.owners[_key(n)] for n in names if _key(n) in self.owners]
                    self.put(target["canonical"].strip(), list(target["aliases"]), min(owners, key=self.age, default=gone["chapter"]))


def fold_registry(edits: DataFrame, book: str = "book") -> DataFrame:
    """(book, ord, canonical, aliases, first_chapter): a book's glossary after its edits, in order.

    ``edits``: (book, chapter, chapter_ord, op_ord, op, name, other, aliases, into): op is add_concept, add_alias,
    rename_canonical, merge (name wins over other) or split; what resolves to no concept changes nothing. The concepts
    are ordered by the age of their chapter, then by key.
    """

    names = ["book", "ord", "canonical", "aliases", "first_chapter"]

    def told(name: str, state: _Book) -> list[tuple]:
        found = sorted(state.concepts.values(), key=lambda c: (state.age(c["chapter"]), _key(c["canonical"])))
        return [(name, i, c["canonical"], c["aliases"], c["chapter"]) for i, c in enumerate(found)]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, name, made = None, None, []
        for batch in batches:
            for edit in batch.itertuples():
                if state is None or edit.book != name:
                    made += [] if state is None else told(name, state)
                    state, name = _Book(), edit.book
                state.chapters.setdefault(edit.chapter, len(state.chapters))
                state.apply(edit, edit.chapter)
                if len(made) >= FOLDED:
                    yield pd.DataFrame(made, columns=names)
                    made = []
        made += [] if state is None else told(name, state)
        yield pd.DataFrame(made, columns=names)

    # Books lie one behind the other in their partition; a task holds the state of one at a time.
    fields = [F.col(book).cast("string").alias("book"), *(c for c in ["chapter", "chapter_ord", "op_ord", "op", "name", "other", "aliases", "into"])]
    sorted_edits = edits.select(*fields).repartition("book").sortWithinPartitions("book", "chapter_ord", "op_ord")
    return sorted_edits.mapInPandas(fold, "book string, ord int, canonical string, aliases array<string>, first_chapter string")


WIKILINK = r"\[\[([^\]]+)\]\]"


def _targets(pages: DataFrame, page: str, text: str, pattern: str) -> DataFrame:
    return pages.select(page, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("target")).withColumn("target", F.trim("target")).where("target <> ''")


def term_drift(pages: DataFrame, page: str, text: str, variants: DataFrame) -> DataFrame:
    """(page, target, canonical): wikilinks left over whose canonical name is another."""
    raw = variants.select(F.col("variant").alias("v1"), F.col("canonical").alias("c1"))
    keyed = variants.select(F.col("variant").alias("v2"), F.col("canonical").alias("c2"))
    links = _targets(pages, page, text, WIKILINK)
    found = links.join(raw, F.col("target") == F.col("v1"), "left").join(keyed, T.concept_key(F.col("target")) == F.col("v2"), "left")
    return found.select(page, "target", F.coalesce("c1", "c2").alias("canonical")).where("canonical <> target")


def unresolved_links(pages: DataFrame, page: str, text: str, concepts: DataFrame, chapters: DataFrame) -> DataFrame:
    """(page, target): links to concepts and chapters (one column ``slug`` each) that don't exist, and any wikilink."""
    href = r'href=\{?"[^"]*?%s/([^"]+?)"\}?'
    gone = lambda kind, slugs: _targets(pages, page, text, href % kind).join(slugs.select(F.col("slug").alias("target")), "target", "left_anti").select(page, "target")
    bare = _targets(pages, page, text, WIKILINK).select(page, F.concat(F.lit("[["), "target", F.lit("]]")).alias("target"))
    return gone("concepts", concepts).unionByName(gone("chapters", chapters)).unionByName(bare)


def exam_pools(questions: DataFrame, question: str, names: Column, chapters: DataFrame) -> DataFrame:
    """(question, chapter_id): the chapter (chapter_id, ord, concepts) that shares most concepts, the first on ties, or ``_unmapped``."""
    asked = questions.select(question, F.explode(F.array_distinct(F.transform(names, lambda n: F.lower(F.trim(n))))).alias("c"))
    owned = chapters.select("chapter_id", "ord", F.explode(F.array_distinct(F.transform("concepts", lambda n: F.lower(F.trim(n))))).alias("c"))
    shared = asked.join(owned, "c").groupBy(question, "chapter_id", "ord").agg(F.count("*").alias("n"))
    best = shared.groupBy(question).agg(F.max_by("chapter_id", F.struct("n", -F.col("ord"))).alias("chapter_id"))
    return questions.select(question).join(best, question, "left").select(question, F.coalesce("chapter_id", F.lit("_unmapped")).alias("chapter_id"))
