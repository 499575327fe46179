"""Source divergence audit: how far each source of a language departs from the others and from the language, by its words.

Two-dimensional group-block tiling. The sources of a language are dealt to blocks of ``BLOCK_GROUPS``; the packed count
vectors of a block go to every task (block, block, stripe), which runs over the successive vocabulary chunks of its
stripe, one in memory at a time, and adds up the submatrix of its pairs of sources. A stripe is ``STRIPE_CHUNKS`` chunks,
so a language of any vocabulary is shared by many tasks; the submatrices of its stripes are added by a last aggregate.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with only A-Z lowered. A language keeps the terms of ``LEAST_DOCS`` documents
or more. A group (lang, source), and a language as a whole, gives each kept term p = 1 + floor(10^9 (count + 1) / (N + V));
the divergence of p from q is the sum of floor((p - q)^2 / q). All arithmetic is on whole numbers.

Defined results: null text, lang and source are ''. A group without kept terms takes part with all counts 0; where a
language keeps no term, all its pairs have the value 0. Repeated rows and rows with a null id count as documents of their
own. A table without rows gives none. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import discard, join_small, spool

SCALE = 10**9
LEAST_DOCS = 3
TOP_TERMS = 200
#: Terms of a chunk (on average), chunks of a stripe, sources of a block.
CHUNK_TERMS, STRIPE_CHUNKS, BLOCK_GROUPS = 4096, 32, 32
#: Terms that a task holds before it passes their counts on.
HELD_TERMS = 200_000
#: Bytes of terms, A-Z lowered; all others become spaces. Bytes of signs beyond ASCII belong to terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, source, text): occurrences and documents of terms, added up over what a task holds."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            terms = list(counts)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.string()), pa.array([counts[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3))):
            terms = text.as_buffer().to_pybytes().translate(TERM_BYTES).split()
            counts, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before = len(counts)
            counts.update(terms)
            docs.update(set(terms))
            size += len(counts) - before
            if size > HELD_TERMS:
                yield from told()
                size = 0
    yield from told()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents with it."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, of: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (of + terms)), exact at any count: decimals until the quotient, which is small."""
    return F.lit(1) + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE), (of + terms).cast("decimal(20,0)"))


def kept_terms(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term, total, chunk, idx) and languages (lang, lang_n, terms, chunks), both written."""
    kept = spool(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("terms")).withColumn("chunks", F.ceil(F.col("terms") / CHUNK_TERMS).cast("int"))
    langs = spool(langs, "divergence-langs")
    dealt = join_small(kept, langs.select("lang", "chunks"), ["lang"]).withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")).drop("chunks")
    placed = dealt.withColumn("idx", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    placed = spool(placed, "divergence-placed")
    discard(kept)
    return placed, langs


def _submatrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a stripe for all pairs of sources of two blocks, from rows sorted by (lang, block_a, block_b, stripe, chunk).

    The first rows of a task (chunk -1) name its sources; terms that none of them has add a constant.
    """
    key, task, chunk, part = None, None, None, []

    def shares(task, counts):
        if counts.size and int(counts.max()) >= 2**63 // SCALE - 1:  # beyond 64 bits: Python's whole numbers
            counts = counts.astype(object)
        return (1 + (counts + 1) * SCALE // task["of"][:, None]).astype(np.int64)

    def add(task, p, times):
        for i, q in enumerate(p):
            others = task["block"] == (task["b"] if task["block"][i] == task["a"] else task["a"])
            d = p[others] - q
            task["sums"][others, i] += (d * d // q).sum(axis=1) * times

    def finish_chunk():
        if part:
            union = np.unique(np.concatenate([idx for _, idx, _ in part]))
            counts = np.zeros((len(task["sources"]), len(union)), np.int64)
            for member, idx, n in part:
                counts[task["row"][member], np.searchsorted(union, idx)] = n
            add(task, shares(task, counts), 1)
            task["unseen"] -= len(union)
            part.clear()

    def finish_task():
        finish_chunk()
        if task and task["unseen"]:
            add(task, shares(task, np.zeros((len(task["sources"]), 1), np.int64)), task["unseen"])
        if task:
            g, h = np.nonzero(~np.eye(len(task["sources"]), dtype=bool) if task["a"] == task["b"] else task["block"][:, None] != task["block"])
            names = pa.array(task["sources"], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(g), pa.string()), names.take(pa.array(g)), names.take(pa.array(h)), pa.array(task["sums"][g, h])], ["lang", "source", "item", "value"])

    def begin(heads):
        of = np.array([max(1, h["n"] + h["terms"]) for h in heads], np.int64)
        return {
            "a": heads[0]["block_a"], "b": heads[0]["block_b"], "sources": [h["source"] for h in heads], "row": {h["member"]: i for i, h in enumerate(heads)},
            "block": np.array([h["block"] for h in heads]), "of": of, "unseen": heads[0]["stripe_terms"], "sums": np.zeros((len(heads), len(heads)), np.int64),
        }

    heads: list[dict] = []
    for batch in batches:
        told = [batch.column(batch.schema.get_field_index(c)) for c in ("lang", "block_a", "block_b", "stripe")]
        for i in range(batch.num_rows):
            new = tuple(c[i].as_py() for c in told)
            at = batch.column("chunk")[i].as_py()
            if new != key:
                if heads:
                    task = begin(heads)
                    heads = []
                yield from finish_task()
                key, task, chunk = new, None, None
            if at < 0:
                heads.append({c: batch.column(c)[i].as_py() for c in ("block_a", "block_b", "block", "member", "source", "n", "terms", "stripe_terms")})
                continue
            if heads:
                task = begin(heads)
                heads = []
            if at != chunk:
                finish_chunk()
                chunk = at
            entries = batch.column("entries")[i].values
            part.append((batch.column("member")[i].as_py(), entries.field("idx").to_numpy(), entries.field("n").to_numpy()))
    if heads:
        task = begin(heads)
    yield from finish_task()


def _met(rows: DataFrame) -> DataFrame:
    """Each row once for each block of its language that its own block meets."""
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")}).drop("other", "blocks")


def pairs(entries: DataFrame, groups: DataFrame, stripes: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language.

    ``entries``: (lang, source, n, chunk, idx), ``groups``: (lang, source, n, terms, chunks), ``stripes``: (lang, stripe, stripe_terms).
    """
    member = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    numbered = groups.withColumn("member", member).withColumn("block", F.floor(F.col("member") / BLOCK_GROUPS).cast("int"))
    numbered = numbered.withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1)
    numbered = spool(numbered, "divergence-groups")
    heads = numbered.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("chunks") - 1) / STRIPE_CHUNKS).cast("int")))))
    heads = heads.join(stripes, ["lang", "stripe"], "left").select("lang", "blocks", "block", "stripe", F.lit(-1).alias("chunk"), "member", "source", "n", "terms", F.coalesce("stripe_terms", F.lit(0)).alias("stripe_terms"), F.lit(None).cast("array<struct<idx:int,n:long>>").alias("entries"))
    packed = entries.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("idx", "n")).alias("entries"))
    packed = join_small(packed, numbered.select("lang", "source", "member", "block", "blocks"), ["lang", "source"])
    unknown = F.lit(None).cast("long")
    vectors = packed.select("lang", "blocks", "block", F.floor(F.col("chunk") / STRIPE_CHUNKS).cast("int").alias("stripe"), "chunk", "member", F.lit("").alias("source"), unknown.alias("n"), unknown.alias("terms"), unknown.alias("stripe_terms"), "entries")
    task = ["lang", "block_a", "block_b", "stripe"]
    dealt = _met(heads.unionByName(vectors)).repartition(*task).sortWithinPartitions(*task, "chunk", "member")
    return dealt.mapInArrow(_submatrices, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def characteristic(entries: DataFrame, groups: DataFrame, langs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group gives more than its language does, the strongest ``top``."""
    sized = join_small(join_small(entries, groups.select("lang", "source", F.col("n").alias("group_n")), ["lang", "source"]), langs.select("lang", "lang_n", "terms"), ["lang"])
    p, q = F.col("p"), F.col("q")
    both = sized.select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("group_n"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("lang_n"), F.col("terms")).alias("q")).where(p > q)
    valued = both.select("lang", "source", "item", F.call_function("div", (p - q) * (p - q), q).alias("value"))
    return _ranked(valued).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has all other sources, part ``term`` the strongest terms."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]).distinct()
    counts = spool(term_counts(docs, text, lang, source), "divergence-counts")
    kept, langs = kept_terms(counts)
    entries = spool(counts.drop("docs").join(kept, ["lang", "term"]), "divergence-entries")
    discard(counts)
    stripes = spool(kept.groupBy("lang", F.floor(F.col("chunk") / STRIPE_CHUNKS).cast("int").alias("stripe")).agg(F.count("*").alias("stripe_terms")), "divergence-stripes")
    own = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs.select("lang", "terms", "chunks"), "lang", "left")
    sized = spool(own.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "terms", "chunks")]), "divergence-sized")
    both = _ranked(pairs(entries, sized, stripes)).withColumn("part", F.lit("pair"))
    terms = characteristic(entries, sized, langs).withColumn("part", F.lit("term"))
    return both.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
