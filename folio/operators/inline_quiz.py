"""Quizzes that stand in the prose of sections: checked, grounded, numbered and rendered anew; slots for later ones filled.

Children of quiz blocks come from ``mdx.quiz_children`` as rows. Which of them stay depends on what stayed before (a cap
for each block and section, slots once each), so a section's children are gathered and folded in order; the state of the
fold is as small as the caps. All changes are edits by place, gathered as rows and made in one pass a text. A section
that can't be parsed keeps its items, and its slots are found by a pattern.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.functions import maths
from folio.functions.text import let
from folio.operators import mdx
from folio.operators.items import CITATIONS, grounded, item_valid
from folio.session import large, written

#: Items and slots of a block, of a section; characters of a slot's topic.
PER_BLOCK, PER_SECTION, TOPIC = 6, 8, 200
_REFS = r"sourceRefs=\{\s*\[([^\]]*)\]\s*\}"


class Sanitised(NamedTuple):
    """bodies: (key, body); slots: (key, slot_id, topic, concept, kind, refs); warnings: (key, start, warning)."""

    bodies: DataFrame
    slots: DataFrame
    warnings: DataFrame


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def _unescaped(text: Column) -> Column:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def escaped(text: Column) -> Column:
    """A text for a quoted prop."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def _json(value: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1)


def _attribute(tag: Column, name: str) -> Column:
    return _unescaped(F.coalesce(M.prop(tag, name), F.lit("")))


def _inner(body: Column, component: str) -> Column:
    return F.coalesce(F.get(M.blocks(body, component), F.lit(0))["body"], F.lit(""))


def markdown(text: Column) -> Column:
    return _trimmed(M.escape_text(maths.normalised(text)))


def citations_json(citations: Column) -> Column:
    """Citations as indented JSON."""
    one = lambda c: F.concat(F.lit('  {\n    "ref_id": '), _json(c["ref_id"]), F.lit(',\n    "quote": '), _json(F.coalesce(c["quote"], F.lit(""))), F.lit("\n  }"))
    return F.when(F.size(citations) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[\n"), F.array_join(F.transform(citations, one), ",\n"), F.lit("\n]")))


def item_mdx(item_id: Column, question: Column, choices: Column, answer: Column, explanation: Column, citations: Column, figure: Column) -> Column:
    """A quiz item; ``choices`` are (id, text), ``answer`` is the number of the right one, from 1."""
    each = F.transform(choices, lambda c, i: F.concat(F.lit('<QuizChoice id="choice-'), (i + 1).cast("string"), F.lit('">\n'), markdown(c["text"]), F.lit("\n</QuizChoice>")))
    return F.concat(
        F.lit('<QuizItem id="'), escaped(item_id), F.lit('" answer="choice-'), answer.cast("string"), F.lit('" citations={'), citations_json(citations), F.lit("}>\n<QuizQuestion>\n"), markdown(question), F.lit("\n</QuizQuestion>\n"),
        F.when(figure == "", F.lit("")).otherwise(F.concat(F.lit('<BookFigure id="'), escaped(figure), F.lit('" />\n'))),
        F.lit("<QuizChoices>\n"), F.array_join(each, "\n"), F.lit("\n</QuizChoices>\n<QuizCheck />\n<QuizExplanation>\n"), markdown(explanation), F.lit("\n</QuizExplanation>\n</QuizItem>"),
    )


def slot_mdx(slot_id: Column, topic: Column, concept: Column, kind: Column, refs: Column) -> Column:
    """A slot; the concept is left out where it is blank, the kind where it is mcq."""
    said = lambda name, value, when: F.when(when, F.concat(F.lit(f' {name}="'), escaped(value), F.lit('"'))).otherwise("")
    listed = F.concat(F.lit("["), F.array_join(F.transform(refs, _json), ", "), F.lit("]"))
    return F.concat(F.lit('<QuizItemSlot id="'), escaped(slot_id), F.lit('" topic="'), escaped(topic), F.lit('"'), said("concept", concept, concept != ""), said("kind", kind, kind != "mcq"), F.lit(" sourceRefs={"), listed, F.lit("} />"))


def _slot_columns(rows: DataFrame, tag: Column, refs: Column) -> DataFrame:
    """topic, concept, slot_kind, refs, valid and same (what makes two slots one) of slots."""
    kind = let(_trimmed(_attribute(tag, "kind")), lambda k: F.when(k.isin("mcq", "worked"), k).otherwise("mcq"))
    made = rows.withColumns({"topic": _trimmed(_attribute(tag, "topic")), "concept": _trimmed(_attribute(tag, "concept")), "slot_kind": kind, "refs": F.filter(refs, lambda r: F.array_contains("allowed", r))})
    valid = F.length("topic").between(1, TOPIC) & (F.size("refs") > 0)
    return made.withColumns({"slot_valid": F.coalesce(valid, F.lit(False)), "same": F.to_json(F.struct("slot_kind", "topic", "concept", F.array_sort("refs").alias("refs")))})


def _item_columns(rows: DataFrame) -> DataFrame:
    tag, raw = (F.when(F.col("kind") == "item", F.col(c)) for c in ("tag", "raw"))
    choices = F.transform(M.blocks(_inner(raw, "QuizChoices"), "QuizChoice"), lambda c: F.struct(_attribute(c["attrs"], "id").alias("id"), _trimmed(c["body"]).alias("text")))
    made = rows.withColumns({"question": _trimmed(_inner(raw, "QuizQuestion")), "explanation": _trimmed(_inner(raw, "QuizExplanation")), "choices": F.filter(choices, lambda c: c["text"] != ""), "answer": _attribute(tag, "answer")})
    figure = F.get(M.matches(raw, rf"<BookFigure\b{M.ATTRIBUTES}>"), F.lit(0))
    number = F.array_position(F.transform("choices", lambda c: c["id"]), F.col("answer"))
    cited = F.coalesce(M.prop_json(tag, "citations", CITATIONS), F.array().cast(CITATIONS))
    return made.withColumns({"number_of_answer": number, "figure": _trimmed(_attribute(figure, "id")), "cited": grounded(cited, F.col("allowed")), "item_valid": item_valid(F.col("question"), F.col("explanation"), F.col("choices"), F.col("answer"))})


def kept_places(children: Column, per_block: int = PER_BLOCK, per_section: int = PER_SECTION) -> Column:
    """The starts of the children that stay, from an ordered array of (start, block, valid, same)."""
    empty = F.struct(F.lit(-1).alias("block"), F.lit(0).alias("inside"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, c: Column) -> Column:
        inside = F.when(acc["block"] == c["block"], acc["inside"]).otherwise(0)
        taken = (F.size(acc["kept"]) < per_section) & (inside < per_block) & c["valid"] & ~F.coalesce(F.array_contains(acc["seen"], c["same"]), F.lit(False))
        return F.struct(
            c["block"].alias("block"), (inside + taken.cast("int")).alias("inside"),
            F.when(taken & c["same"].isNotNull(), F.array_append(acc["seen"], c["same"])).otherwise(acc["seen"]).alias("seen"),
            F.when(taken, F.array_append(acc["kept"], c["start"])).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(children, empty, step, lambda acc: acc["kept"])


def _decided(children: DataFrame, key: str, per_block: int, per_section: int) -> DataFrame:
    """``children`` with kept, and how many were kept before in the block and in the section, slots apart too."""
    rest = [c for c in children.columns if c not in (key, "start")]
    listed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", *rest))).alias("all"))
    facts = F.transform("all", lambda c: F.struct(c["start"].alias("start"), F.coalesce(c["block_start"], F.lit(0)).alias("block"), c["valid"].alias("valid"), F.when(c["kind"] == "slot", c["same"]).alias("same")))
    stay = let(kept_places(facts, per_block, per_section), lambda kept: F.transform(F.filter("all", lambda c: F.array_contains(kept, c["start"])), lambda c: F.struct(c["start"].alias("start"), c["block_start"].alias("block_start"), (c["kind"] == "slot").alias("slot"))))
    each = listed.withColumn("stay", stay).select(key, "stay", F.explode("all").alias("c")).select(key, "stay", "c.*")
    before = lambda fits: F.size(F.filter("stay", lambda s: (s["start"] < F.col("start")) & fits(s)))
    counted = {"in_section": before(lambda s: F.lit(True)), "in_block": before(lambda s: s["block_start"].eqNullSafe(F.col("block_start"))), "ordinal": before(lambda s: s["slot"])}
    return each.withColumns({"kept": F.exists("stay", lambda s: s["start"] == F.col("start")), **counted}).drop("stay")


def sanitised(sections: DataFrame, key: str, body: str = "body", allowed: str = "allowed", chapter: str = "chapter_id", number: str = "section_index") -> Sanitised:
    """The quizzes of sections: (key, body, allowed references, chapter, number of the section in it)."""
    given = sections.select(key, F.col(body).alias("body"), F.coalesce(F.col(allowed), F.array().cast("array<string>")).alias("allowed"), F.col(chapter).alias("chapter"), F.col(number).alias("number"))
    # Pages go to their tasks before they are cut: a small file is read by few tasks, and tokens needn't be shuffled.
    found = written(mdx.tokens(given.repartition(key), key, "body"), "quiz-tokens")
    broken = written(mdx.faults(found, key).where("rule = 'mdx-syntax'").select(key), "quiz-broken")

    # Children of blocks, each with its own source.
    listed = mdx.quiz_children(found, key).where("kind <> 'stray'").join(large(broken), key, "left_anti").groupBy(key).agg(F.collect_list(F.struct("start", "end", "block_start", "block_end", "kind", "name")).alias("all"))
    each = listed.join(large(given), key).select(key, "body", "allowed", "chapter", "number", F.explode("all").alias("c")).select(key, "allowed", "chapter", "number", "c.*", F.expr("substring(body, c.start + 1, c.end - c.start)").alias("raw"))
    each = written(each.withColumn("tag", F.regexp_extract("raw", mdx.OPEN_TAG, 0)), "quiz-children")
    tag = F.when(F.col("kind") == "slot", F.col("tag"))
    refs = F.coalesce(M.prop_json(tag, "sourceRefs", "array<string>"), F.array().cast("array<string>"))
    parsed = _item_columns(_slot_columns(each, tag, refs)).withColumn("valid", F.when(F.col("kind") == "item", F.col("item_valid")).otherwise((F.col("kind") == "slot") & F.col("slot_valid")))
    decided = written(_decided(written(parsed, "quiz-parsed"), key, PER_BLOCK, PER_SECTION), "quiz-decided")
    slot_id = F.concat("chapter", F.lit(":s"), F.col("number").cast("string"), F.lit(":slot-"), F.lpad(F.col("ordinal").cast("string"), 3, "0"))
    item_id = F.concat(F.lit("quiz-"), "chapter", F.lit("-s"), F.lpad(F.col("number").cast("string"), 3, "0"), F.lit("-"), F.lpad((F.col("in_section") + 1).cast("string"), 2, "0"))
    as_slot = slot_mdx(slot_id, F.col("topic"), F.col("concept"), F.col("slot_kind"), F.col("refs"))
    as_item = item_mdx(item_id, F.col("question"), F.col("choices"), F.col("number_of_answer"), F.col("explanation"), F.col("cited"), F.col("figure"))
    rendered = decided.withColumn("new", F.when(~F.col("kept"), None).when(F.col("kind") == "slot", as_slot).otherwise(as_item))
    blocks = rendered.groupBy(key, F.col("block_start").alias("start"), (F.col("block_end") - F.col("block_start")).alias("length")).agg(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("start", "new")))).alias("stay"))
    edits = blocks.select(key, "start", "length", F.when(F.size("stay") == 0, "").otherwise(F.concat(F.lit("<QuizBlock>\n"), F.array_join(F.transform("stay", lambda s: s["new"]), "\n\n"), F.lit("\n</QuizBlock>"))).alias("new"))

    # Slots of sections that can't be parsed.
    tags = given.join(large(broken), key, "left_semi").select(key, "allowed", "chapter", "number", F.explode(F.arrays_zip(M.places(F.col("body"), F.lit(M.SLOT)).alias("p"), M.matches(F.col("body"), M.SLOT).alias("raw"))).alias("m"))
    loose = tags.select(key, "allowed", "chapter", "number", F.col("m.p.start").alias("start"), F.col("m.p.size").alias("length"), F.lit(None).cast("int").alias("block_start"), F.lit("slot").alias("kind"), F.col("m.raw").alias("raw"))
    quoted = M.matches(F.regexp_extract("raw", _REFS, 1), "\"([^\"]*)\"", 1)
    loose = written(_slot_columns(written(loose, "quiz-loose"), F.col("raw"), quoted).withColumn("valid", F.col("slot_valid")), "quiz-slots")
    rescued = written(_decided(loose, key, PER_SECTION, PER_SECTION), "quiz-rescued")
    edits = edits.unionByName(rescued.select(key, "start", "length", F.when(F.col("kept"), as_slot).otherwise("").alias("new")))

    tidy = F.concat(_trimmed(F.regexp_replace("body", r"\n{3,}", "\n\n")), F.lit("\n"))
    changed = mdx.edited(given, edits, key, "body").join(large(broken.withColumn("broken", F.lit(True))), key, "left").join(large(rescued.select(key).distinct().withColumn("rescued", F.lit(True))), key, "left")
    bodies = changed.select(key, F.when(F.col("broken").isNull() | F.col("rescued"), tidy).otherwise(F.col("body")).alias("body"))
    specs = ["topic", "concept", F.col("slot_kind").alias("kind"), "refs"]
    slots = decided.where("kept AND kind = 'slot'").select(key, slot_id.alias("slot_id"), *specs).unionByName(rescued.where("kept").select(key, slot_id.alias("slot_id"), *specs))
    return Sanitised(bodies, slots, _warnings(decided, rescued, key))


def _warnings(decided: DataFrame, rescued: DataFrame, key: str) -> DataFrame:
    """Why children went. Behind a cap a block has one warning and nothing else; slots found by pattern have one each."""
    full = (F.col("in_section") >= PER_SECTION) | (F.col("in_block") >= PER_BLOCK)
    invalid = F.concat(F.lit("dropped invalid quiz "), "kind")
    reason = F.when(F.col("kind") == "unknown", F.concat(F.lit("dropped stray <"), "name", F.lit(">"))).when(~F.col("valid"), invalid).otherwise("dropped duplicate quiz slot")
    cap = F.lit("quiz cap reached, dropped extra")
    gone = decided.where("NOT kept AND kind <> 'empty'").withColumn("full", full)
    nth = F.row_number().over(Window.partitionBy(key, "block_start", "full").orderBy("start"))
    told = gone.withColumn("nth", nth).where("NOT full OR nth = 1").select(key, "start", F.when(F.col("full"), cap).otherwise(reason).alias("warning"))
    seen = F.max("kept").over(Window.partitionBy(key, "same").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    loose = rescued.withColumn("seen", seen).where("NOT kept")
    return told.unionByName(loose.select(key, "start", F.when(~F.col("valid"), invalid).when(F.col("seen"), "dropped duplicate quiz slot").otherwise(cap).alias("warning")))


def resolved(pages: DataFrame, fills: DataFrame, key: str, body: str = "body") -> DataFrame:
    """``pages`` whose slots are replaced by what fills them: rows (key, slot_id, mdx).

    A slot that nothing fills goes, and with the last of them its block, unless that holds items or other elements. A
    slot outside all blocks is filled in a block of its own. Pages that can't be parsed have their slots found by pattern.
    """
    found = written(mdx.tokens(pages.repartition(key), key, body), "quiz-tokens")
    broken = written(mdx.faults(found, key).where("rule = 'mdx-syntax'").select(key), "quiz-broken")
    children = mdx.quiz_children(found, key).join(large(broken), key, "left_anti")
    # A slot is one tag or an empty element; its id stands in the tag that begins it.
    tags = found.where("name = 'QuizItemSlot' AND kind IN ('whole', 'open')").select(key, "start", _attribute(F.col("raw"), "id").alias("slot_id"))
    filled = children.join(large(tags), [key, "start"], "left").join(large(fills.select(key, "slot_id", F.col("mdx").alias("fill"))), [key, "slot_id"], "left")
    whole = Window.partitionBy(key, "block_start")
    stays = F.max((F.col("kind").isin("item", "unknown") | F.col("fill").isNotNull()).cast("int")).over(whole) == 1
    marked = filled.withColumn("stays", stays)
    dropped = marked.where("kind <> 'stray' AND NOT stays").select(key, F.col("block_start").alias("start"), (F.col("block_end") - F.col("block_start")).alias("length"), F.lit("").alias("new")).distinct()
    inside = marked.where("kind = 'slot' AND stays").select(key, "start", (F.col("end") - F.col("start")).alias("length"), F.coalesce("fill", F.lit("")).alias("new"))
    alone = F.coalesce(F.concat(F.lit("<QuizBlock>\n"), "fill", F.lit("\n</QuizBlock>")), F.lit(""))
    stray = marked.where("kind = 'stray'").select(key, "start", (F.col("end") - F.col("start")).alias("length"), alone.alias("new"))
    loose = pages.join(large(broken), key, "left_semi").select(key, F.explode(F.arrays_zip(M.places(F.col(body), F.lit(M.SLOT)).alias("p"), M.matches(F.col(body), M.SLOT).alias("raw"))).alias("m"))
    loose = loose.select(key, F.col("m.p.start").alias("start"), F.col("m.p.size").alias("length"), _attribute(F.col("m.raw"), "id").alias("slot_id")).join(large(fills.select(key, "slot_id", F.col("mdx").alias("fill"))), [key, "slot_id"], "left")
    edits = dropped.unionByName(inside).unionByName(stray).unionByName(loose.select(key, "start", "length", F.coalesce("fill", F.lit("")).alias("new")))
    made = mdx.edited(pages, edits, key, body).join(large(broken.withColumn("folio_broken", F.lit(True))), key, "left")
    return made.withColumn(body, F.when(F.col(body).isNull(), None).when(F.col("folio_broken"), F.regexp_replace(body, r"<QuizBlock>\s*</QuizBlock>\n*", "")).otherwise(M.blank_runs(F.col(body)))).drop("folio_broken")
