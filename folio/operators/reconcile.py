"""Candidates of concepts merged: the first of a candidate's names that is known decides which concept it joins.

The rule depends on order, so it is a fold; but only candidates that are connected by names can touch each other. Names
(by key) and candidates make a graph whose connected components are worked on side by side. A component in which every
row has the first row's name is one concept, whatever the order: it is grouped, and may be as large as the table. Only
components where names compete are folded, each in one task, in the order of their rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.graphs import components
from folio.session import written

_CONCEPT = "book string, ord long, key string, canonical string, aliases array<string>, chapters array<string>"


def _names(canonical: Column, aliases: Column) -> Column:
    kept = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.trim(a) != "")
    return F.concat(F.array(F.trim(canonical)), kept)


def _rows(candidates: DataFrame, entries: DataFrame | None, variants: DataFrame | None) -> DataFrame:
    """(book, kind, ord, names, keys, chapter) in the order of the fold: entries, then variants, then candidates."""
    chapter = F.trim(F.coalesce("chapter", F.lit("")))
    said = F.when(chapter == "", F.raise_error(F.concat(F.lit("candidate without a chapter: "), "name"))).otherwise(chapter)
    rows = candidates.where(F.trim(F.coalesce("name", F.lit(""))) != "").select("book", F.lit(2).alias("kind"), F.col("ord").cast("long").alias("ord"), _names(F.col("name"), F.col("aliases")).alias("names"), said.alias("chapter"))
    if entries is not None:
        base = entries.where(F.trim(F.coalesce("canonical", F.lit(""))) != "").select("book", F.lit(0).alias("kind"), F.col("ord").cast("long").alias("ord"), _names(F.col("canonical"), F.col("aliases")).alias("names"), F.trim(F.coalesce("first_chapter", F.lit(""))).alias("chapter"))
        rows = base.unionByName(rows)
        if variants is not None:
            known = base.select("book", T.concept_key(F.col("names")[0]).alias("key")).distinct()
            said = variants.withColumn("key", T.concept_key(F.col("canonical"))).join(known, ["book", "key"], "left_semi")
            rows = rows.unionByName(said.select("book", F.lit(1).alias("kind"), F.xxhash64("variant").alias("ord"), F.array("canonical", "variant").alias("names"), F.lit("").alias("chapter")))
    keyed = rows.withColumn("keys", F.transform("names", T.concept_key)).withColumn("book", F.col("book").cast("string"))
    return keyed.withColumn("row", F.concat_ws("/", F.lit("r"), "book", "kind", "ord"))


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    """The rule itself, over the rows of one component in their order."""
    concepts, known = {}, {}
    for r in rows.sort_values(["kind", "ord"]).itertuples():
        keys, names = list(r.keys), list(r.names)
        if r.kind == 1:
            known[keys[1]] = keys[0]
            continue
        found = next((known[k] for k in keys if k in known), None) if r.kind == 2 else None
        at = found if found is not None else keys[0]
        if r.kind == 0:
            concepts[at] = {"ord": concepts[at]["ord"] if at in concepts else (r.kind, r.ord), "canonical": names[0], "aliases": names[1:], "chapters": [r.chapter] if r.chapter else []}
        else:
            own = concepts.setdefault(at, {"ord": (r.kind, r.ord), "canonical": names[0], "aliases": [], "chapters": []})
            own["chapters"] += [r.chapter] if r.chapter not in own["chapters"] else []
            for name in names:
                own["aliases"] += [name] if name != own["canonical"] and name not in own["aliases"] else []
        known.update(dict.fromkeys(keys, at))
    made = [(rows["book"].iat[0], c["ord"][0] * (1 << 60) + c["ord"][1], k, c["canonical"], c["aliases"], c["chapters"]) for k, c in concepts.items()]
    return pd.DataFrame(made, columns=["book", "ord", "key", "canonical", "aliases", "chapters"])


def _grouped(rows: DataFrame) -> DataFrame:
    """Concepts of components with one: spellings and chapters each once, by their first place; pre-aggregated."""
    by = ["book", "root"]
    first = rows.groupBy(*by).agg(F.min_by(F.struct("kind", "ord", "names", "keys"), F.struct("kind", "ord")).alias("f"))
    spelled = rows.where("kind = 2").select(*by, F.struct("kind", "ord").alias("o"), F.posexplode("names").alias("at", "name")).groupBy(*by, "name").agg(F.min(F.struct("o", "at")).alias("at"))
    spelled = spelled.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: s["name"]).alias("spellings"))
    told = rows.where("kind <> 1 AND chapter <> ''").groupBy(*by, "chapter").agg(F.min(F.struct("kind", "ord")).alias("o")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "chapter"))), lambda c: c["chapter"]).alias("chapters"))
    both = first.join(spelled, by, "left").join(told, by, "left")
    none = F.array().cast("array<string>")
    canonical, given = F.col("f.names")[0], F.when(F.col("f.kind") == 0, F.slice("f.names", F.lit(2), F.size("f.names"))).otherwise(none)
    more = F.array_except(F.coalesce("spellings", none), F.concat(given, F.array(canonical)))
    return both.select("book", (F.col("f.kind") * F.lit(1 << 60) + F.col("f.ord")).alias("ord"), F.col("f.keys")[0].alias("key"), canonical.alias("canonical"), F.concat(given, more).alias("aliases"), F.coalesce("chapters", none).alias("chapters"))


def reconciled(candidates: DataFrame, entries: DataFrame | None = None, variants: DataFrame | None = None) -> DataFrame:
    """(book, ord, key, canonical, aliases, chapters): the concepts of each book, ``ord`` in the order they came up.

    ``candidates``: (book, ord, name, aliases, chapter), merged in the order of ``ord``, which is unique in a book; one
    without a name is left out, one without a chapter is an error. ``entries``: (book, ord, canonical, aliases,
    first_chapter), a glossary that comes first; ``variants``: (book, variant, canonical), further names of its entries.
    """
    rows = written(_rows(candidates, entries, variants), "reconcile-rows")
    edges = rows.select(F.col("row").alias("a"), F.explode(F.transform("keys", lambda k: F.concat_ws("/", F.lit("k"), "book", k))).alias("b")).distinct()
    placed = rows.join(components(edges).select(F.col("node").alias("row"), "root"), "row")
    placed = written(placed, "reconcile-placed")
    by = ["book", "root"]
    first = placed.groupBy(*by).agg(F.min_by(F.col("keys")[0], F.struct("kind", "ord")).alias("lead"))
    held = placed.join(first, by).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.array_contains("keys", F.col("lead"))).alias("with_lead"), F.count_if(F.col("kind") == 0).alias("entries"))
    kinds = written(held.select(*by, ((F.col("n") == F.col("with_lead")) & (F.col("entries") <= 1)).alias("plain")), "reconcile-kinds")
    told = placed.join(kinds, by)
    folded = told.where("NOT plain").select("book", "root", "kind", "ord", "names", "keys", "chapter").groupBy(*by).applyInPandas(_folded, _CONCEPT)
    return _grouped(told.where("plain")).unionByName(folded)


def alias_map(concepts: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """(book, variant, canonical): names and keys of all concepts; where two claim one, the concept that came up later."""
    every = concepts.select("book", "ord", "canonical", F.posexplode(F.concat(F.array("canonical"), "aliases")).alias("at", "name"))
    both = every.select("book", F.struct("ord", "at", F.lit(0)).alias("o"), "canonical", "name", T.concept_key(F.col("name")).alias("key"))
    rows = both.select("book", "canonical", F.col("name").alias("variant"), "o").unionByName(both.select("book", "canonical", F.col("key").alias("variant"), "o"))
    if variants is not None:
        base = F.struct(F.lit(-1).cast("long").alias("ord"), F.lit(0).alias("at"), F.lit(0))
        rows = variants.select(F.col("book").cast("string").alias("book"), "canonical", "variant", base.alias("o")).unionByName(rows)
    return rows.groupBy("book", "variant").agg(F.max_by("canonical", "o").alias("canonical"))


def concept_order(concepts: DataFrame) -> DataFrame:
    """``concepts`` with their place in the book, from 1."""
    return concepts.withColumn("place", F.row_number().over(Window.partitionBy("book").orderBy("ord")))
