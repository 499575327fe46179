"""JSON values of any depth as rows: one row for each value, with its place, and values put together from rows again.

Where levels depend on each other, a value is taken apart level by level, all rows of a level at once, so the number of
rounds is the depth of the deepest value and no recursion runs inside a row. Types come from VARIANT; the order of an object's keys, which VARIANT does not
keep, comes from the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.text import let
from folio.session import written

#: The keys of a block that may hold its text, of a content object, of a nested span, and kinds of formulas.
TEXT_KEYS = ["content", "text", "md", "markdown", "html", "table_body", "code_body", "latex"]
CONTENT_KEYS = ["paragraph_content", "title_content", "math_content", "html", "list_items", "content", "table_caption", "table_footnote", "image_caption", "image_footnote", "chart_caption", "chart_footnote"]
SPAN_KEYS, PRIMARY_KEYS = ["text", "content", "value", "latex", "html"], ["content", "text", "latex", "value"]
MATH_SPANS, MATH_BLOCKS = ["inline_equation", "interline_equation"], ["equation", "interline_equation", "equation_interline"]
INLINE_KINDS, DISPLAY_KINDS = ["inline", "inline_equation"], ["display", "interline", "block", "equation", "interline_equation", "equation_interline"]


def _typed(level: DataFrame) -> DataFrame:
    """Adds kind and, for scalars, their text: strings decoded, others as they are written."""
    shown = F.to_json(F.col("v"))
    first = F.substring(shown, 1, 1)
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(shown == "null", "null").when(shown.isin("true", "false"), "boolean").otherwise("number")
    return level.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == "string", F.col("v").cast("string")).when(F.col("kind").isin("number", "boolean"), shown))


def levels(rows: DataFrame, key: str, json: str) -> list[DataFrame]:
    """For each depth, from 0, the values there: (key, place, name, kind, text), written.

    ``place`` are the positions from the top, so rows of a key sort by it as a reader meets them; ``name`` is the key in
    an object. Texts that are no JSON have no rows.
    """
    now = rows.select(key, F.array().cast("array<int>").alias("place"), F.lit(None).cast("string").alias("name"), F.col(json).alias("raw"), F.try_parse_json(json).alias("v")).where("v IS NOT NULL")
    found = []
    while True:
        level = written(_typed(now), "nested-level")
        if found and level.isEmpty():
            return found
        found.append(level.select(key, "place", "name", "kind", "text"))
        in_object = F.arrays_zip(F.map_keys(F.from_json("raw", "map<string,string>")).alias("k"), F.map_values(F.from_json("raw", "map<string,string>")).alias("r"), F.map_values(F.from_json("raw", "map<string,variant>")).alias("w"))
        in_array = F.arrays_zip(F.from_json("raw", "array<string>").alias("r"), F.from_json("raw", "array<variant>").alias("w"))
        below = lambda kind, inner: level.where(F.col("kind") == kind).select(key, "place", F.posexplode(inner).alias("at", "c"))
        member = below("object", in_object).select(key, F.array_append("place", F.col("at")).alias("place"), F.col("c.k").alias("name"), F.col("c.r").alias("raw"), F.col("c.w").alias("v"))
        item = below("array", in_array).select(key, F.array_append("place", F.col("at")).alias("place"), F.lit(None).cast("string").alias("name"), F.col("c.r").alias("raw"), F.col("c.w").alias("v"))
        # A null has no variant in an array or a map; it counts as one.
        now = member.unionByName(item).withColumn("v", F.coalesce("v", F.parse_json(F.lit("null"))))


def nodes(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, place, name, kind, text) of all values at all depths."""
    every = levels(rows, key, json)
    out = every[0]
    for level in every[1:]:
        out = out.unionByName(level)
    return out


def parent(place: Column) -> Column:
    return F.slice(place, F.lit(1), F.size(place) - 1)


def _cited_below(found: DataFrame, key: str) -> DataFrame:
    """One level further down: references stay as they are, containers give way to what they hold.

    Rows are (key, place, cited, text, raw, v): a reference that is cited, or a container with its raw and v, or both.
    """
    maps = lambda of: F.from_json("raw", f"map<string,{of}>")
    lists = lambda of: F.from_json("raw", f"array<{of}>")
    placed = lambda cited: lambda c, i: F.struct(F.array_append("place", i).alias("place"), cited(c).alias("cited"), F.lit(None).cast("string").alias("text"), c["raw"].alias("raw"), F.coalesce(c["v"], F.parse_json(F.lit("null"))).alias("v"))
    zipped = lambda m, q: F.transform(F.arrays_zip(F.map_keys(m).alias("name"), F.map_values(m).alias("raw"), F.map_values(maps("variant")).alias("v")), placed(lambda c: (c["name"] == "ref_id") & q))
    members = let(maps("string"), lambda m: let(F.map_contains_key(m, "quote"), lambda q: zipped(m, q)))
    items = F.transform(F.arrays_zip(lists("string").alias("raw"), lists("variant").alias("v")), placed(lambda c: F.lit(False)))
    itself = F.array(F.struct("place", "cited", "text", F.lit(None).cast("string").alias("raw"), F.lit(None).cast("variant").alias("v")))
    none = F.slice(itself, 1, 0)
    held = F.when(F.col("kind") == "object", members).when(F.col("kind") == "array", items).otherwise(none)
    below = found.withColumn("held", F.concat(F.when(F.col("cited"), itself).otherwise(none), held)).select(key, F.explode("held").alias("c")).select(key, "c.*")
    return _kept_of(below, key)


def _kept_of(rows: DataFrame, key: str) -> DataFrame:
    """Of (key, place, cited, text, raw, v) the containers and the references; texts of these, raw and v of those."""
    def read(shown: Column) -> Column:
        first = F.substring(shown, 1, 1)
        kind = F.when(first == "{", "object").when(first == "[", "array")
        text = F.when(first == '"', F.col("v").cast("string")).when(kind.isNull() & (shown != "null"), shown)
        return F.struct(kind.alias("kind"), F.when(F.col("cited"), F.coalesce("text", text, F.lit(""))).alias("text"))

    typed = rows.withColumn("is", let(F.to_json("v"), read)).where("cited OR is.kind IS NOT NULL")
    inner = F.col("is.kind").isNotNull()
    return typed.select(key, "place", "cited", F.col("is.text").alias("text"), *(F.when(inner, F.col(c)).alias(c) for c in ("raw", "v")), F.col("is.kind").alias("kind"))


#: Levels that are taken apart in one pass before what is left of them is written.
AT_ONCE = 4


def cited_refs(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, n, ref_id): the ref_id of every object that has a quote too, as a reader meets them, repeats included.

    Levels follow each other inside the tasks; only references, and what lies deeper than ``AT_ONCE`` levels, are written.
    """
    top = rows.select(key, F.array().cast("array<int>").alias("place"), F.lit(False).alias("cited"), F.lit(None).cast("string").alias("text"), F.col(json).alias("raw"), F.try_parse_json(json).alias("v")).where("v IS NOT NULL")
    left, refs = _kept_of(top, key), None
    while True:
        for _ in range(AT_ONCE):
            left = _cited_below(left, key)
        left = written(left, "nested-cited")
        found = left.where("cited").select(key, parent(F.col("place")).alias("of"), F.col("text").alias("ref_id"))
        refs = found if refs is None else refs.unionByName(found)
        left = left.where("kind IS NOT NULL").withColumn("cited", F.lit(False))
        if left.isEmpty():
            break
    listed = refs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("of", "ref_id"))).alias("all"))
    return listed.select(key, F.posexplode(F.transform("all", lambda r: r["ref_id"])).alias("n", "ref_id"))


def folded(every: list[DataFrame], key: str, leaf: Column, branch: Column) -> DataFrame:
    """(key, value, children) of the top values, put together from the deepest level up.

    ``leaf`` makes the value of a scalar row. ``branch`` makes that of an object or array from ``children``, an array of
    (at, name, kind, value), empty where there are none.
    """
    kind = every[0].select(leaf.alias("v")).schema["v"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<at:int,name:string,kind:string,value:{kind}>>")
    below = None
    for level in reversed(every):
        if below is None:
            rows = level.withColumn("children", empty)
        else:
            kids = below.groupBy(key, parent(F.col("place")).alias("place")).agg(F.array_sort(F.collect_list(F.struct(F.element_at("place", -1).alias("at"), "name", "kind", "value"))).alias("children"))
            rows = level.join(kids, [key, "place"], "left").withColumn("children", F.coalesce(F.col("children"), empty))
        below = written(rows.withColumn("value", F.when(F.col("kind").isin("object", "array"), branch).otherwise(leaf)), "nested-folded")
    return below.select(key, "value", "children")


def _quoted(value: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1)


def cut_text(text: Column, most: int, per: int = 3) -> Column:
    """A text of more than ``most`` tokens, a token being ``per`` characters, cut in proportion and marked."""
    tokens = T.token_count(text, per)
    keep = F.greatest(F.lit(1), F.floor(F.length(text) * F.lit(most) / tokens * 0.97).cast("int"))
    return F.lit("") if most <= 0 else F.when(tokens <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), keep), F.lit("\n\n[truncated]")))


#: The tokens of a JSON text: strings, numbers and words, signs. White space is none.
JSON_TOKEN = r'(?s)"(?:[^"\\]++|\\.)*+"|[^"\[\]{}:, \t\n\r]++|[\[\]{}:,]'


def _first_value(tokens: Column) -> Column:
    """The tokens of the first value: what stands behind it is not read, as VARIANT doesn't."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(at: Column, token: Column) -> Column:
        depth = at["depth"] + F.when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)
        return F.when(at["done"], at).otherwise(F.struct(depth.alias("depth"), (at["n"] + 1).alias("n"), (depth == 0).alias("done")))

    return let(tokens, lambda all: F.slice(all, F.lit(1), F.aggregate(all, start, step)["n"]))


def compacted(rows: DataFrame, key: str, json: str, most: int) -> DataFrame:
    """(key, json): the value with every string in it cut to ``most`` tokens; names, order and all else stay.

    A string is cut alike at any depth, so the text is read token by token inside the task and nothing is written. Texts
    that are no JSON have no rows.
    """
    decoded = lambda token: F.parse_json(token).cast("string")

    def told(token: Column, after: Column) -> Column:
        name, text = _quoted(decoded(token)), let(decoded(token), lambda t: _quoted(cut_text(t, most)))
        string = token.startswith('"')
        return F.when(string & (after == ":"), name).when(string, text).when(token.isin(*"{}[]:,"), token).otherwise(F.to_json(F.parse_json(token)))

    tokens = _first_value(F.regexp_extract_all(json, F.lit(JSON_TOKEN), F.lit(0)))
    made = let(tokens, lambda all: F.array_join(F.transform(all, lambda token, i: told(token, F.coalesce(F.get(all, i + 1), F.lit("")))), ""))
    return rows.where(F.try_parse_json(json).isNotNull()).select(key, made.alias("json"))


def bare_math(text: Column) -> Column:
    """A formula without the dollar signs or brackets around it."""
    body = T.clean_markdown(text)
    inside = lambda n: T.clean_markdown(F.substring(body, F.lit(n + 1), F.length(body) - 2 * n))
    around = lambda a, b, n: body.startswith(a) & body.endswith(b) & (F.length(body) >= 2 * n)
    return F.when(around("$$", "$$", 2), inside(2)).when(around("\\[", "\\]", 2), inside(2)).when(around("$", "$", 1), inside(1)).when(around("\\(", "\\)", 2), inside(2)).otherwise(body)


def math_text(text: Column, kind: Column, block: Column) -> Column:
    """A formula with its signs, in the line or on lines of its own, as its kind, its block or its line breaks ask."""
    body = bare_math(text)
    inline, display = F.concat(F.lit("$"), body, F.lit("$")), F.concat(F.lit("$$\n"), body, F.lit("\n$$"))
    said = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    shown = F.when(said.isin(INLINE_KINDS), inline).when(said.isin(DISPLAY_KINDS) | block.isin(MATH_BLOCKS) | F.contains(T.clean_markdown(text), F.lit("\n")), display).otherwise(inline)
    return F.when(body == "", "").otherwise(shown)


def block_text(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, text): the text of a parser's block, an object of nested spans, lists and formulas.

    The first key of ``TEXT_KEYS`` with a text decides; list items become a list. Each value has two readings, made from
    the deepest level up: as part of another text, and as content of a block.
    """
    type_of = F.lower(F.trim(F.coalesce(F.get_json_object(json, "$.type"), F.get_json_object(json, "$.category"), F.lit("text"))))
    given = rows.select(key, json, type_of.alias("block")).withColumn("block", F.when(F.col("block") == "", "text").otherwise(F.col("block")))
    every = [level.join(given.select(key, "block"), key) for level in levels(given, key, json)]
    none = F.array().cast("array<string>")
    read = lambda part, content, items=none: F.struct(part.alias("part"), content.alias("content"), F.col("text").alias("text"), items.alias("items"))
    scalar = F.when(F.col("kind").isin("string", "number"), F.col("text")).when(F.col("kind") == "boolean", F.initcap("text")).otherwise("")
    children = F.col("children")
    child = lambda name: F.get(F.filter(children, lambda c: c["name"] == name), F.lit(0))
    part = lambda name: F.coalesce(child(name)["value"]["part"], F.lit(""))
    kind, block = F.lower(F.trim(F.coalesce(child("type")["value"]["text"], F.lit("")))), F.col("block")
    is_span = kind.isin(MATH_SPANS)
    primary = F.coalesce(*(F.when(child(k).isNotNull(), part(k)) for k in PRIMARY_KEYS), F.lit(""))
    formula = F.when(block.isin(MATH_BLOCKS), part("math_content")).otherwise(math_text(part("math_content"), child("math_type")["value"]["text"], block))
    pieces = F.array(*(F.when(part(k) == "", None).otherwise(formula if k == "math_content" else part(k)) for k in CONTENT_KEYS))
    content = F.when(is_span, math_text(primary, kind, block)).otherwise(T.clean_markdown(F.array_join(pieces, "\n")))
    known = F.coalesce(*(F.when(child(k).isNotNull() & (child(k)["kind"] != "null"), part(k)) for k in SPAN_KEYS))
    as_part = F.when(known.isNull(), content).when(is_span, math_text(known, kind, block)).otherwise(known)
    listed = T.clean_markdown(F.array_join(F.transform(children, lambda c: F.coalesce(c["value"]["part"], F.lit(""))), ""))
    branch = F.when(F.col("kind") == "array", read(listed, listed, F.transform(children, lambda c: c["value"]["text"]))).otherwise(read(as_part, content))
    top = folded(every, key, read(scalar, scalar), branch)
    own = lambda name: F.get(F.filter("children", lambda c: c["name"] == name), F.lit(0))
    items = F.transform(own("list_items")["value"]["items"], lambda i: F.concat(F.lit("- "), F.coalesce(i, F.lit(""))))
    told = F.coalesce(*(F.when(own(k)["kind"] == "string", T.clean_markdown(own(k)["value"]["text"])).when(own(k)["kind"].isin("object", "array") & (own(k)["value"]["content"] != ""), own(k)["value"]["content"]) for k in TEXT_KEYS), F.lit(""))
    return top.select(key, F.when(own("list_items")["kind"] == "array", F.array_join(items, "\n")).otherwise(told).alias("text"))
