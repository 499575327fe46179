"""Filter interaction audit: what each of five document filters removes in each of the 120 orders of applying them.

Direct relational replay. A document's failures are one small mask; each mask meets the 120 orders, a broadcast table of
that fixed size, finds the step of its first failure in each, and is exploded to the five steps. One conditional
aggregate, combined on the map side, makes the counts, so a shuffle carries 600 rows a part and task whatever the table.

The filters, by the condition under which a document fails: A fewer than 100 words; B distinct words under 80 % of its
words; C letters A-Z over 10 % of its code points; D any of ``#$%&*|``; E a text that a row of a smaller doc_id has too.

Defined results: a null text is empty (it fails A, and E where a smaller doc_id has an empty text). A null lang is ''.
A null doc_id is neither smaller than another nor larger, and has no labels; rows of one doc_id are each counted and
don't make each other fail E. A document is good (toxic) if any of its label rows says quality = 1 (toxic = 1). A table
without rows gives none. Further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import discard, spool

LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"


def failures(text: Column, words: Column) -> list[Column]:
    """The conditions A to D; E takes other rows."""
    n, capitals = F.size(words), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals.cast("long") > 10 * F.length(text), text.rlike("[#$%&*|]")]


def mask(conditions: list[Column], first: int = 0) -> Column:
    """Bit i is set if condition i holds."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions, first)]
    return sum(bits[1:], bits[0])


def flagged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, fails, good, toxic) for each document: the mask of its failures A to E and its labels."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("text"))
    read = read.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    marked = spool(read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), mask(failures(F.col("text"), F.col("words"))).alias("fails")), "filters-marked")
    # Both are written, so that adaptive execution can split a text or a doc_id that a large part of all rows have.
    least = spool(marked.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1").drop("n"), "filters-least")
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    told = spool(told.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "filters-labels")
    both = marked.join(least, "sha", "left").withColumn("fails", F.col("fails") + mask([F.col("doc_id") > F.col("least")], 4)).select("doc_id", "part", "fails")
    known = both.where("doc_id IS NOT NULL").join(told, "doc_id", "left").select("part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return known.unionByName(both.where("doc_id IS NULL").select("part", "fails", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def orders(spark, letters: str = LETTERS) -> DataFrame:
    """(filter_order, bits): each order of the letters, and the mask bits of its filters in that order."""
    rows = [("".join(o), [1 << letters.index(x) for x in o]) for o in permutations(letters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replay(marked: DataFrame, letters: str = LETTERS) -> DataFrame:
    """From (part, fails, good, toxic): counts by part, filter_order and step."""
    every = F.broadcast(orders(marked.sparkSession, letters))
    steps = range(1, len(letters) + 1)
    fails_at = [F.col("fails").bitwiseAND(F.col("bits")[i - 1]) != 0 for i in steps]
    first = F.coalesce(*[F.when(c, F.lit(i)) for i, c in zip(steps, fails_at)], F.lit(len(letters) + 1))
    met = marked.crossJoin(every).withColumn("first", first)
    each = met.select("part", "filter_order", "fails", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    removed, own = F.col("first") == F.col("step"), F.col("fails").bitwiseAND(F.col("bit")) != 0
    counted = {
        "kept": F.col("first") > F.col("step"),
        "removed": removed,
        "redundant": own & (F.col("first") < F.col("step")),
        "unique_fails": F.col("fails") == F.col("bit"),
        "good_lost": removed & (F.col("good") == 1),
        "toxic_lost": removed & (F.col("toxic") == 1),
    }
    return each.groupBy("part", "filter_order", "step").agg(*[F.count_if(c).alias(name) for name, c in counted.items()])


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    shapley: what the step's filter removes, summed over all orders at any step; a part has 120 rows of each filter.
    """
    marked = spool(flagged(docs, labels, doc_id, text, part), "filters-flagged")
    counts = spool(replay(marked), "filters-counts")
    discard(marked)
    by_filter = counts.groupBy("part", F.expr("substr(filter_order, step, 1)").alias("letter")).agg(F.sum("removed").alias("shapley"))
    return counts.withColumn("letter", F.expr("substr(filter_order, step, 1)")).join(by_filter, ["part", "letter"]).drop("letter")
