"""Pages of components (MDX): tokens, elements with their places, faults, and edits by place.

A text is cut into tokens by one regular expression, each token a row. What a parser keeps on its stack is the running
sum of opened and closed elements over a page's tokens, so a window finds the depth of each tag, and the next tag of the
same depth is its partner. All places are code points from 0; the time is that of sorting a page's tokens.

Known limits: braces nest up to ``NESTED`` deep, and an element may begin and end in different paragraphs. Broken TeX is
not reported.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.session import large

NESTED = 6
#: Elements that a page must not hold, props that it must not set.
RAW_ELEMENTS = ["script", "iframe", "object", "embed", "style", "link", "meta", "base"]
UNSAFE_PROPS = ["ref", "dangerouslySetInnerHTML"]
_STRINGS = r"\"(?:\\.|[^\"\\])*+\"|'(?:\\.|[^'\\])*+'|`(?:\\.|[^`\\])*+`"


def _braces(depth: int) -> str:
    inner = rf"|{_braces(depth - 1)}" if depth else ""
    return rf"\{{(?:{_STRINGS}|[^{{}}\"'`]{inner})*+\}}"


BRACES = _braces(NESTED)
_NAME = r"[A-Za-z_$][\w.$-]*+(?::[A-Za-z_$][\w.$-]*+)?"
OPEN_TAG = rf"<{_NAME}(?=[\s/>{{])(?:\"[^\"]*\"|'[^']*'|{BRACES}|[^<>\"'{{}}/]|/(?!>))*+/?>"
CLOSE_TAG = rf"</{_NAME}\s*+>"
#: Front matter, fences, code, formulas, escaped signs, tags, expressions, then plain text; at last any sign alone.
TOKEN = "|".join(f"(?:{p})" for p in (r"\A---\n[\s\S]*?\n---(?=\n|\z)", M.FENCE, r"`[^`\n]*`", r"\$\$[\s\S]*?\$\$|\$[^$\n]*\$", r"\\[\s\S]", CLOSE_TAG, OPEN_TAG, BRACES, r"(?:[^<{`$\\\n]++|\n(?![ \t]*(?:```|~~~)))++", r"[\s\S]"))


def tokens(pages: DataFrame, page: str, body: str) -> DataFrame:
    """(page, at, raw, kind, name, start, end, depth, line, column) of each token of each text.

    Kinds: open, close, whole (an element in one tag), expression, fault (a sign that begins nothing), other. The depth of
    a tag counts the elements that are open inside it, itself included.
    """
    cut = pages.select(page, F.posexplode(M.matches(F.col(body), TOKEN)).alias("at", "raw"))
    raw = F.col("raw")
    # The first sign says which pattern can fit; most tokens begin with another and meet none.
    kind = F.when(raw.startswith("</") & raw.rlike(rf"\A(?:{CLOSE_TAG})\z"), "close").when(raw.startswith("<") & raw.rlike(rf"\A(?:{OPEN_TAG})\z"), F.when(raw.endswith("/>"), "whole").otherwise("open"))
    kind = kind.when(raw.startswith("{") & raw.rlike(rf"\A{BRACES}\z"), "expression").when(raw.isin("<", "{"), "fault").otherwise("other")
    marked = cut.withColumn("kind", kind).withColumn("name", F.when(F.col("kind").isin("open", "close", "whole"), F.regexp_extract(raw, _NAME, 0)))
    so_far = Window.partitionBy(page).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(page).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.sum(F.length(raw)).over(so_far), F.lit(0)).cast("int")
    placed = marked.withColumn("start", start).withColumn("end", (F.col("start") + F.length(raw)).cast("int"))
    opened = F.sum(F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0))
    breaks = F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit("")))
    line_start = F.max(F.when(breaks > 0, F.col("end") - F.length(F.substring_index(raw, "\n", -1)))).over(so_far)
    depth = opened.over(through) + F.when(F.col("kind").isin("close", "whole"), 1).otherwise(0)
    return placed.withColumns({"depth": depth.cast("int"), "line": (F.coalesce(F.sum(breaks).over(so_far), F.lit(0)) + 1).cast("int"), "column": (F.col("start") - F.coalesce(line_start, F.lit(0)) + 1).cast("int")})


def _paired(found: DataFrame, page: str) -> DataFrame:
    """Tags with the tag of the same depth that comes next and the one before."""
    level = Window.partitionBy(page, "depth").orderBy("at")
    tag = F.struct("kind", "name", "start", "end")
    return found.where(F.col("kind").isin("open", "close", "whole")).withColumns({"next": F.lead(tag).over(level), "last": F.lag(tag).over(level)})


def elements(found: DataFrame, page: str) -> DataFrame:
    """(page, name, tag, start, end, inner_start, inner_end, depth) of each element that is closed by its own end tag."""
    # All tags of a page go to one task, where the windows by depth and those over the page find them.
    tags = _paired(found.where(F.col("kind").isin("open", "close", "whole")).repartition(page), page)
    closed = (F.col("kind") == "open") & (F.col("next.kind") == "close") & (F.col("next.name") == F.col("name"))
    whole = F.col("kind") == "whole"
    end, inner = F.when(whole, F.col("end")).otherwise(F.col("next.end")), F.when(whole, F.col("end")).otherwise(F.col("next.start"))
    return tags.where(whole | closed).select(page, "name", F.col("raw").alias("tag"), "start", end.alias("end"), F.col("end").alias("inner_start"), inner.alias("inner_end"), "depth")


def prop_names(tag: Column) -> Column:
    """The names of a tag's props, in order, without what stands in their values."""
    bare = F.regexp_replace(F.regexp_replace(tag, rf"\A<{_NAME}|/?>\z", " "), rf"\"[^\"]*\"|'[^']*'|{BRACES}", "")
    return F.filter(F.transform(F.split(bare, r"=|\s+"), lambda n: F.trim(n)), lambda n: n != "")


def faults(found: DataFrame, page: str) -> DataFrame:
    """(page, line, column, rule, value): what keeps a page from being built.

    A text that can't be parsed has one row, mdx-syntax, at its first fault; others have a row for each expression
    outside code and formulas, each raw element and each unsafe prop.
    """
    tags = _paired(found, page)
    closes = (F.col("kind") == "close") & ~F.coalesce((F.col("last.kind") == "open") & (F.col("last.name") == F.col("name")) & (F.col("depth") > 0), F.lit(False))
    never = (F.col("kind") == "open") & F.col("next").isNull()
    # A parser notices an end tag that fits nothing where it stands, an element without one at the end of the text.
    odd = tags.where(closes | never).select(page, "at", never.alias("late"), "line", "column", F.concat_ws(" ", F.when(never, "unclosed").otherwise("unopened"), "name").alias("value"))
    signs = found.where("kind = 'fault'").select(page, "at", F.lit(False).alias("late"), "line", "column", F.concat(F.lit("bare "), "raw").alias("value"))
    first = Window.partitionBy(page).orderBy("late", "at")
    syntax = odd.unionByName(signs).withColumn("n", F.row_number().over(first)).where("n = 1").select(page, "line", "column", F.lit("mdx-syntax").alias("rule"), "value")
    inner = F.regexp_replace(F.substring(F.col("raw"), F.lit(2), F.length("raw") - 2), r"\s+", " ")
    bare = found.where("kind = 'expression'").select(page, "line", "column", F.lit("no-bare-expression").alias("rule"), F.substring(inner, 1, 40).alias("value"))
    elements_ = found.where(F.col("kind").isin("open", "whole"))
    raw = elements_.where(F.col("name").isin(RAW_ELEMENTS)).select(page, "line", "column", F.lit("no-raw-html-element").alias("rule"), F.col("name").alias("value"))
    named = elements_.select(page, "line", "column", F.explode(prop_names(F.col("raw"))).alias("value"))
    props = named.where(F.col("value").isin(UNSAFE_PROPS) | F.col("value").rlike("^on[A-Z]")).select(page, "line", "column", F.lit("no-unsafe-jsx-prop").alias("rule"), "value")
    return syntax.unionByName(bare.unionByName(raw).unionByName(props).join(large(syntax.select(page)), page, "left_anti"))


def quiz_children(found: DataFrame, page: str) -> DataFrame:
    """(page, block_start, block_end, kind, name, start, end) of what stands directly inside quiz blocks.

    Kinds: item, slot, unknown; a block without elements has one row of kind empty; a slot outside all blocks has the
    kind stray and no block. Blocks inside blocks are unknown children.
    """
    every = elements(found, page)
    before = Window.partitionBy(page).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(page).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    is_block = F.col("name") == "QuizBlock"
    reach = F.coalesce(F.max(F.when(is_block, F.col("end"))).over(before), F.lit(0))
    marked = every.withColumn("outer", is_block & (reach <= F.col("start")))
    block = F.last(F.when(F.col("outer"), F.struct("start", "end", "depth")), ignorenulls=True).over(through)
    inside = marked.withColumn("block", block).withColumn("block", F.when(F.col("start") < F.col("block.end"), F.col("block")))
    parted = inside.withColumns({"block_start": F.col("block.start"), "direct": F.coalesce(~F.col("outer") & (F.col("depth") == F.col("block.depth") + 1), F.lit(False))})
    held = F.count_if(F.col("direct")).over(Window.partitionBy(page, "block_start"))
    child = F.when(F.col("name") == "QuizItem", "item").when(F.col("name") == "QuizItemSlot", "slot").otherwise("unknown")
    kind = F.when(F.col("direct"), child).when(F.col("outer") & (F.col("held") == 0), "empty").when((F.col("name") == "QuizItemSlot") & F.col("block").isNull(), "stray")
    return parted.withColumn("held", held).withColumn("kind", kind).where("kind IS NOT NULL").select(page, "block_start", F.col("block.end").alias("block_end"), "kind", "name", "start", "end")


def overlapping(edits: DataFrame, page: str) -> DataFrame:
    """``edits`` (page, start, length, new) with a column clash: whether one begins before an earlier one ends."""
    before = Window.partitionBy(page).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("clash", F.coalesce(F.max(F.col("start") + F.col("length")).over(before) > F.col("start"), F.lit(False)))


def applied(text: Column, edits: Column) -> Column:
    """A text with sorted edits (start, length, new), from the right to the left: each part is cut once."""

    def one(value, changes):
        if value is None or changes is None:
            return value
        parts, end = [], len(value)
        for e in reversed(list(changes)):
            parts += [value[e["start"] + e["length"] : end], e["new"]]
            end = e["start"]
        return "".join(reversed([*parts, value[:end]]))

    @F.pandas_udf("string")
    def made(texts: pd.Series, edits: pd.Series) -> pd.Series:
        return pd.Series([one(t, e) for t, e in zip(texts, edits)], dtype=object)

    return made(text, edits)


def edited(pages: DataFrame, edits: DataFrame, page: str, body: str) -> DataFrame:
    """``pages`` with their edits made; an edit that clashes with an earlier one is left out."""
    fit = overlapping(edits, page).where("NOT clash")
    gathered = fit.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("start", "length", "new"))).alias("folio_edits"))
    return pages.join(large(gathered), page, "left").withColumn(body, applied(F.col(body), F.col("folio_edits"))).drop("folio_edits")
