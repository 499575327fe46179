"""Checks of pages and items as issue rows, and deterministic repair by dropping what can't be verified.

``items``: (item_id, owner, kind, question, options, answer, citations), citations an array of (ref_id, quote).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T


def issues_of(rows: DataFrame, owner: str, rules: dict[str, tuple[str, Column, Column]]) -> DataFrame:
    """(owner, severity, code, message) for each rule (severity, holds, message) that a row breaks; one pass, no shuffle."""
    found = [F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))) for code, (severity, bad, message) in rules.items()]
    some = F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return rows.select(F.col(owner).cast("string").alias("owner"), some.alias("i")).select("owner", "i.severity", "i.code", "i.message")


def page_issues(pages: DataFrame, owner: str, text: str) -> DataFrame:
    """Missing frontmatter, quiz, cards and sources; phrases that instruct the reader."""
    t = F.coalesce(F.col(text), F.lit(""))
    phrases = T.suspicious_phrases(t)
    return issues_of(pages, owner, {
        "missing_frontmatter": ("error", ~F.startswith(t, F.lit("---")), F.lit("no frontmatter")),
        "missing_quiz": ("warning", ~F.contains(t, F.lit("<QuizBlock")), F.lit("no quiz")),
        "missing_cards": ("warning", ~F.contains(t, F.lit("<AnkiDeck")), F.lit("no cards")),
        "missing_sources": ("error", F.size(T.source_refs(t)) == 0, F.lit("no source reference")),
        "suspicious_instruction": ("critical", F.size(phrases) > 0, F.array_join(phrases, ", ")),
    })


def answer_valid(options: Column, answer: Column, single: Column) -> Column:
    """All answers are options, at least one; exactly one where a single choice is asked for."""
    inside = (F.size(answer) > 0) & (F.size(F.array_except(answer, options)) == 0)
    return F.coalesce(inside & (~single | (F.size(answer) == 1)), F.lit(False))


def blanks_valid(blanks: Column) -> Column:
    return F.coalesce((F.size(blanks) > 0) & F.forall(blanks, lambda b: F.size(b) > 0), F.lit(False))


def grounded(citations: Column, allowed: Column) -> Column:
    """Citations with a reference that is allowed and a quote, trimmed; the others drop out."""
    trimmed = F.transform(citations, lambda c: F.struct(F.trim(c["ref_id"]).alias("ref_id"), F.trim(c["quote"]).alias("quote")))
    return F.array_distinct(F.filter(trimmed, lambda c: (c["ref_id"] != "") & (c["quote"] != "") & F.array_contains(allowed, c["ref_id"])))


def drop_unverified(items: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, audit): items with valid answers and their grounded citations; what was dropped and why.

    ``allowed``: (owner, refs), one row per owner. Items of unknown owners have no allowed references.
    """
    none = F.array().cast("array<string>")
    joined = items.join(allowed, "owner", "left").withColumn("ok", answer_valid(F.col("options"), F.col("answer"), F.col("kind") == "single_choice"))
    joined = joined.withColumn("good", grounded(F.coalesce("citations", F.expr("CAST(array() AS array<struct<ref_id: string, quote: string>>)")), F.coalesce("refs", none)))
    kept = joined.where("ok").select(*[F.col("good").alias(c) if c == "citations" else F.col(c) for c in items.columns])
    dropped_items = joined.where("NOT ok").select("owner", "item_id", F.lit("invalid_answer").alias("reason"), F.lit(1).alias("n"))
    lost = F.size("citations") - F.size("good")
    dropped_citations = joined.where("ok").where(lost > 0).select("owner", "item_id", F.lit("ungrounded_citation").alias("reason"), lost.alias("n"))
    return kept, dropped_items.unionByName(dropped_citations)


def repair_targets(issues: DataFrame) -> DataFrame:
    """(owner, codes): owners with errors or critical issues."""
    return issues.where(F.col("severity").isin("error", "critical")).groupBy("owner").agg(F.array_sort(F.collect_set("code")).alias("codes"))
