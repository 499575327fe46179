"""Learning items in pages: quizzes, exams, worked problems and cards as rows, their references, validity and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import markup as M

CITATIONS = "array<struct<ref_id: string, quote: string>>"
#: The columns of an item besides its page: place, id, kind, texts, choices, answers, references.
FIELDS = ["place", "item_id", "type", "question", "choices", "answer", "explanation", "citations"]


def _items(pages: DataFrame, page: str, body: Column, component: str, inside: str | None = None) -> DataFrame:
    """(page, place, attrs, body) of each element of a component, numbered within the page."""
    found = M.blocks(body, component) if inside is None else F.flatten(F.transform(M.blocks(body, inside), lambda b: M.blocks(b["body"], component)))
    return pages.select(page, F.posexplode(found).alias("place", "item")).select(page, "place", "item.attrs", "item.body")


def _choices(component: str) -> Column:
    return F.transform(M.blocks(F.col("body"), component), lambda c: F.struct(F.coalesce(M.prop(c["attrs"], "id"), F.lit("")).alias("id"), M.child_text(c["body"]).alias("text")))


def _cited() -> Column:
    return F.coalesce(M.prop_json(F.col("attrs"), "citations", CITATIONS), F.array().cast(CITATIONS))


def _id() -> Column:
    return F.coalesce(M.prop(F.col("attrs"), "id"), F.lit("")).alias("item_id")


def _texts(choices: Column) -> Column:
    return F.transform(choices, lambda c: c["text"])


def quiz_items(pages: DataFrame, page: str, body: str) -> DataFrame:
    """Items of quiz blocks; the answer is the text of the choice that it names, or the name where no choice has it."""
    rows = _items(pages, page, F.col(body), "QuizItem", "QuizBlock").withColumn("all", _choices("QuizChoice")).withColumn("named", F.coalesce(M.prop(F.col("attrs"), "answer"), F.lit("")))
    right = F.get(F.filter("all", lambda c: (c["id"] != "") & (c["id"] == F.col("named"))), F.lit(0))["text"]
    return rows.select(
        page, "place", _id(), F.lit("multiple_choice").alias("type"), M.first_child(F.col("body"), "QuizQuestion").alias("question"), _texts(F.col("all")).alias("choices"),
        F.coalesce(right, "named").alias("answer"), M.first_child(F.col("body"), "QuizExplanation").alias("explanation"), _cited().alias("citations"),
    )


def exam_items(pages: DataFrame, page: str, body: str) -> DataFrame:
    """Items of exam blocks: choices by their ids, blanks without an answer, worked ones with their reference answer."""
    rows = _items(pages, page, F.col(body), "ExamItem", "ExamBlock").withColumn("all", _choices("ExamChoice"))
    kind = F.coalesce(M.prop(F.col("attrs"), "type"), F.lit("single_choice"))
    named = F.coalesce(M.prop_json(F.col("attrs"), "answer", "array<string>"), F.array().cast("array<string>"))
    right = _texts(F.filter("all", lambda c: F.array_contains(named, c["id"])))
    chosen = kind.isin("single_choice", "multiple_choice")
    answer = F.when(chosen, F.array_join(right, ", ")).when(kind == "worked", F.coalesce(M.prop(F.col("attrs"), "referenceAnswer"), F.lit(""))).otherwise("")
    return rows.select(
        page, "place", _id(), kind.alias("type"), M.first_child(F.col("body"), "ExamQuestion").alias("question"), F.when(chosen, _texts(F.col("all"))).otherwise(F.array().cast("array<string>")).alias("choices"),
        answer.alias("answer"), M.first_child(F.col("body"), "ExamExplanation").alias("explanation"), _cited().alias("citations"),
    )


def worked_items(pages: DataFrame, page: str, body: str) -> DataFrame:
    """Worked problems; all their texts are props."""
    value = lambda name: F.coalesce(M.prop(F.col("attrs"), name), F.lit(""))
    rows = _items(pages, page, F.col(body), "WorkedProblem")
    return rows.select(
        page, "place", _id(), F.lit("worked").alias("type"), value("question").alias("question"), F.array().cast("array<string>").alias("choices"),
        value("referenceAnswer").alias("answer"), value("explanation").alias("explanation"), _cited().alias("citations"),
    )


def cards(pages: DataFrame, page: str, body: str) -> DataFrame:
    """(page, place, item_id, front, back, citations) of the cards of all decks."""
    rows = _items(pages, page, F.col(body), "AnkiCard", "AnkiDeck")
    return rows.select(page, "place", _id(), M.first_child(F.col("body"), "AnkiFront").alias("front"), M.first_child(F.col("body"), "AnkiBack").alias("back"), _cited().alias("citations"))


def learning_items(pages: DataFrame, page: str, body: str, chapter: str | None = None) -> DataFrame:
    """All items of all kinds with their defaults: a chapter (the page itself where it has none) and references."""
    all_items = quiz_items(pages, page, body).unionByName(exam_items(pages, page, body)).unionByName(worked_items(pages, page, body))
    chapters = pages.select(page, (F.coalesce(F.col(chapter), F.col(page).cast("string")) if chapter else F.col(page).cast("string")).alias("chapter_id"))
    rows = all_items.join(chapters, page)
    return rows.select(page, "chapter_id", *FIELDS, item_refs(F.array().cast("array<string>"), F.col("citations")).alias("source_refs"))


def item_refs(own: Column, citations: Column) -> Column:
    """References of an item: its own, then those of its citations; each once, none blank."""
    cited = F.transform(citations, lambda c: c["ref_id"])
    return F.array_distinct(F.filter(F.transform(F.concat(own, F.coalesce(cited, F.array().cast("array<string>"))), lambda r: F.trim(r)), lambda r: r.isNotNull() & (r != "")))


def grounded(citations: Column, allowed: Column) -> Column:
    """The citations of allowed references; an item keeps its place without the others."""
    return F.filter(citations, lambda c: F.array_contains(allowed, c["ref_id"]))


def item_valid(question: Column, explanation: Column, choices: Column, answer: Column) -> Column:
    """Whether an item has both texts, two choices with texts, and an answer among them."""
    filled = F.filter(choices, lambda c: F.trim(c["text"]) != "")
    return F.coalesce((F.trim(question) != "") & (F.trim(explanation) != "") & (F.size(filled) >= 2) & F.exists(filled, lambda c: c["id"] == answer), F.lit(False))


def slots(pages: DataFrame, page: str, body: str) -> DataFrame:
    """(page, place, topic, concept, kind, refs) of the quiz slots of each page; kinds that are unknown are mcq."""
    found = pages.select(page, F.posexplode(M.matches(F.col(body), M.SLOT)).alias("place", "tag"))
    value = lambda name: F.trim(F.coalesce(M.prop(F.col("tag"), name), F.lit("")))
    kind = F.when(value("kind").isin("mcq", "worked"), value("kind")).otherwise("mcq")
    refs = F.coalesce(M.prop_json(F.col("tag"), "sourceRefs", "array<string>"), F.array().cast("array<string>"))
    return found.select(page, "place", value("topic").alias("topic"), value("concept").alias("concept"), kind.alias("kind"), refs.alias("refs"))


def valid_slots(found: DataFrame, allowed: Column, page: str, most: int = 8, longest: int = 200) -> DataFrame:
    """Slots with a topic of 1 to ``longest`` characters and an allowed reference: each once, ``most`` a page, numbered."""
    rows = found.withColumn("refs", F.filter("refs", lambda r: F.array_contains(allowed, r))).where(F.length("topic").between(1, longest) & (F.size("refs") > 0))
    same = Window.partitionBy(page, "kind", "topic", "concept", F.array_sort("refs")).orderBy("place")
    once = rows.withColumn("again", F.row_number().over(same)).where("again = 1").drop("again")
    return once.withColumn("slot", F.row_number().over(Window.partitionBy(page).orderBy("place"))).where(F.col("slot") <= most)


def answers_unknown(items: DataFrame, page: str) -> DataFrame:
    """(page, item_id) of items with choices whose answer is none of them."""
    return items.where((F.size("choices") > 0) & ~F.array_contains("choices", F.col("answer"))).select(page, "item_id")


def distinct_citations(citations: Column) -> Column:
    """Citations in order, each (ref_id, quote) once."""
    return F.array_distinct(F.transform(citations, lambda c: F.struct(F.trim(c["ref_id"]).alias("ref_id"), F.trim(c["quote"]).alias("quote"))))


def highlights(rows: DataFrame, page: str, time: str, text: str) -> DataFrame:
    """(page, texts): a page's highlights in order of time; a reader's highlights of one page are few."""
    return rows.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(time), F.col(text)))), lambda h: h[text]).alias("texts"))
