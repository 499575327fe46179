"""Markup functions as Column expressions: components and their props, protected spans, links, headings, formulas.

Everything here stays inside the JVM: a text is cut once by a pattern into what stands between matches and the matches
themselves, each side is changed by an expression, and both are woven together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import let

# The spans that rewrites leave alone, and the patterns of links, fences, slots and formulas.
CODE = r"```[\s\S]*?```|`[^`\n]*`"
FENCE = r"(?m)^[ \t]*(?:```[^\n]*\n(?s:.*?)^[ \t]*```[ \t]*$|~~~[^\n]*\n(?s:.*?)^[ \t]*~~~[ \t]*$)"
MATH = r"\$\$[\s\S]*?\$\$|\$[^$\n]*\$"
HEADING_LINE = r"(?m:^[ \t]*#{1,6}[^\n]*)"
PREVIEW = r"<PreviewLink\b[\s\S]*?</PreviewLink>"
QUIZ_BLOCK = r"<QuizBlock\b[\s\S]*?</QuizBlock>"
MARKDOWN_LINK = r"\[[^\]\n]+\]\([^)]+\)"
TAG = r"<[^>\n]+>"
WIKILINK = r"\[\[([^\]]+)\]\]"
PROSE_GUARD = "|".join(f"(?:{p})" for p in (HEADING_LINE, PREVIEW, QUIZ_BLOCK, CODE, MATH, MARKDOWN_LINK, TAG))
ATTRIBUTES = r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+"
SLOT = rf"<QuizItemSlot\b{ATTRIBUTES}(?<=/)>"


def _text(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(group))


def weave(gaps: Column, between: Column) -> Column:
    """What stands between matches and what takes their place, one after the other."""
    return F.array_join(F.zip_with(gaps, between, lambda gap, new: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(new, F.lit("")))), "")


def replaced(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """A text with each match of a pattern changed by an expression of the match."""
    return let(text, lambda t: weave(F.split(t, pattern, -1), F.transform(matches(t, pattern), change)))


def outside(text: Column, spans: str, change: Callable[[Column], Column]) -> Column:
    """A text with all that stands outside the spans changed by an expression."""
    return let(text, lambda t: weave(F.transform(F.split(t, spans, -1), change), matches(t, spans)))


def masked(text: Column, spans: str) -> Column:
    """A text of the same length whose spans are blank."""
    return replaced(text, spans, lambda span: F.repeat(F.lit("\u0001"), F.length(span)))


def places(text: Column, pattern: Column) -> Column:
    """(start, size) of each match, starts from 0."""
    found, gaps = F.transform(matches(text, pattern), lambda m: F.length(m)), F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start: int, size: int>>)").alias("found"))
    both = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("size")))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
        F.when(x["size"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["size"].alias("size"))))).alias("found"),
    )
    return F.aggregate(both, start, step, lambda acc: acc["found"])


# Components


def blocks(text: Column, component: str) -> Column:
    """(attrs, body) of each element of a component; a > inside quotes does not end its tag, the first end tag ends it."""
    whole = rf"<{component}(\s(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)?>([\s\S]*?)</{component}>"
    return F.zip_with(matches(text, whole, 1), matches(text, whole, 2), lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("attrs"), b.alias("body")))


#: What braces hold, piece by piece: quoted texts, braces, all else; a quote that nothing ends takes the rest.
BRACED = r"\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'|[{}]|[^{}\"']++|[\"'][\s\S]*+"


def braced(attrs: Column, prop: str) -> Column:
    """What stands in the braces of prop={...}, which may hold braces and quoted texts at any depth; null without one."""
    at = F.locate(f"{prop}={{", attrs)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part == "{", 1).when(part == "}", -1).otherwise(0)
        return F.when(acc["depth"] == 0, acc).otherwise(F.struct(depth.alias("depth"), (acc["size"] + F.when(depth > 0, F.length(part)).otherwise(0)).alias("size")))

    read = lambda rest: let(F.aggregate(matches(rest, BRACED), start, step), lambda end: F.when(end["depth"] == 0, F.trim(F.substring(rest, F.lit(1), end["size"]))))
    return F.when(at > 0, let(F.substring(attrs, at + len(prop) + 2, F.length(attrs)), read))


def _json_text(value: Column) -> Column:
    return F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"}), F.lit(0))


def prop(attrs: Column, name: str) -> Column:
    """The value of a prop: braced JSON as text, what is no JSON as it stands, or a quoted string; null without one."""
    plain = rf"(?<!\w){name}=(?:\"([^\"]*)\"|'([^']*)')"
    quoted = F.when(attrs.rlike(plain), F.concat(F.regexp_extract(attrs, plain, 1), F.regexp_extract(attrs, plain, 2)))
    return let(braced(attrs, name), lambda inner: F.when(inner.isNotNull(), F.coalesce(_json_text(inner), inner)).otherwise(quoted))


def prop_json(attrs: Column, name: str, schema: str) -> Column:
    """A braced prop read as JSON of a schema; null where it is missing or no such JSON."""
    return F.from_json(braced(attrs, name), schema, {"allowSingleQuotes": "false"})


def child_text(body: Column) -> Column:
    """The text of an element without the indentation that its lines have in common, and without space around it."""
    filled = lambda lines: F.filter(lines, lambda line: line.rlike(r"\S"))
    indent = lambda lines: F.coalesce(F.array_min(F.transform(filled(lines), lambda line: F.length(F.regexp_extract(line, r"^[ \t]*", 0)))), F.lit(0))
    even = lambda lines, n: F.transform(lines, lambda line: F.when(line.rlike(r"\S"), F.substring(line, n + 1, F.length(line))).otherwise(""))
    return let(F.split(body, "\n"), lambda lines: let(indent(lines), lambda n: F.regexp_replace(F.array_join(even(lines, n), "\n"), r"^\s+|\s+$", "")))


def first_child(body: Column, component: str) -> Column:
    return F.coalesce(child_text(F.get(blocks(body, component), F.lit(0))["body"]), F.lit(""))


def source_ref_ids(text: Column) -> Column:
    """The ids of SourceRef elements, quotes peeled, in order."""
    tags = F.transform(matches(text, rf"<SourceRef\b{ATTRIBUTES}>"), lambda tag: prop(tag, "id"))
    return F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.regexp_replace(t, r"^([\"'])(.*)\1$", "$2"))


# Rewrites


def escape_text(text: Column) -> Column:
    """Signs that markup would read, as entities, outside formulas and code."""

    def entities(part: Column) -> Column:
        for sign, entity in (("&", "&amp;"), ("\\{", "&#123;"), ("\\}", "&#125;"), ("<", "&lt;"), (">", "&gt;"), ("{", "&#123;"), ("}", "&#125;")):
            part = F.replace(part, F.lit(sign), F.lit(entity))
        return part

    return outside(_text(text), f"{MATH}|{CODE}", entities)


def dollar_delimiters(text: Column) -> Column:
    r"""\[ \] and \( \) as dollar signs, outside code and outside string and array props."""
    props = r"=\{\s*\"(?:\\.|[^\"\\])*\"\s*\}|=\{\s*\[[\s\S]*?\]\s*\}"

    def change(part: Column) -> Column:
        part = F.regexp_replace(part, r"(?m)^[ \t]*\\[\[\]][ \t]*$", r"\$\$")
        part = F.regexp_replace(part, r"\s*\\\[\s*([\s\S]*?)\s*\\\]\s*[.,;:]?", "\n\n\\$\\$\n$1\n\\$\\$\n\n")
        return F.regexp_replace(part, r"\\\(\s*([\s\S]*?)\s*\\\)", r"\$$1\$")

    return outside(_text(text), f"{CODE}|{props}", change)


def cites_as_refs(text: Column) -> Column:
    """<cite ref=…> and <Citation ref_id=…> as SourceRef elements, outside code."""
    whole = r"(?i)<(?:cite|citation)\s+(?:ref|ref_id)=[\"']([^\"']*)[\"']\s*(?:/\s*>|>[\s\S]*?</(?:cite|citation)\s*>)"
    return outside(_text(text), CODE, lambda part: F.regexp_replace(part, whole, '<SourceRef id="$1" />'))


def style_objects(text: Column) -> Column:
    """style="a-b: c" as style={{'aB': 'c'}}, outside code; what is no declaration is left out."""

    def declaration(given: Column) -> Column:
        name, value = F.trim(F.substring_index(given, ":", 1)), F.trim(F.regexp_replace(given, r"^[^:]*:", ""))
        words = F.split(name, "-")
        camel = F.array_join(F.transform(words, lambda w, i: F.when((i == 0) | (words[0] == "") & (i == 1) & ~name.startswith("-"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))), "")
        escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        return F.when(F.contains(given, F.lit(":")) & (name != "") & (value != ""), F.concat(F.lit("'"), camel, F.lit("': '"), escaped, F.lit("'")))

    def change(attribute: Column) -> Column:
        css = F.substring(attribute, F.lit(8), F.length(attribute) - 8)
        pairs = F.array_compact(F.transform(F.split(css, ";"), declaration))
        return F.concat(F.lit("style={{"), F.array_join(pairs, ", "), F.lit("}}"))

    return outside(_text(text), CODE, lambda part: replaced(part, r"style=(?:\"[^\"]*\"|'[^']*')", change))


def asset_images(text: Column, folder: str = "public-assets") -> Column:
    """Markdown images of public assets with a leading slash, outside code."""
    return outside(_text(text), CODE, lambda part: F.regexp_replace(part, rf"(!\[[^\]\n]*\]\()(?:\./|public/)?({folder}/[^)\s]+)", "$1/$2"))


def without_slots(text: Column) -> Column:
    """Quiz slots that nothing filled go, and the blocks that they leave empty."""
    bare = F.regexp_replace(_text(text), SLOT, "")
    return F.when(bare == text, text).otherwise(F.regexp_replace(bare, r"<QuizBlock>\s*</QuizBlock>\n*", ""))


def without_quizzes(text: Column) -> Column:
    """Prose without quiz blocks and slots, no blank lines in a row."""
    bare = F.regexp_replace(F.regexp_replace(_text(text), QUIZ_BLOCK, ""), SLOT, "")
    return F.concat(F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""), F.lit("\n"))


def blank_runs(text: Column) -> Column:
    """At most one blank line in a row, outside fenced code."""
    return outside(_text(text), FENCE, lambda part: F.regexp_replace(part, r"\n{3,}", "\n\n"))


def headings(text: Column) -> Column:
    """(level, title, start) of each heading outside fenced code; start counts characters from 0."""
    clear = masked(_text(text), FENCE)
    line = r"(?m)^(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$"
    whole = F.zip_with(matches(clear, line, 1), matches(clear, line, 2), lambda a, b: F.struct(F.length(a).alias("level"), b.alias("title")))
    return F.zip_with(whole, places(clear, F.lit(line)), lambda h, p: F.struct(h["level"].alias("level"), h["title"].alias("title"), p["start"].alias("start")))


def local_links(text: Column, known: Column) -> Column:
    """Links to local targets that are not among the known ones become their labels, outside code; images stay."""
    link = r"(?<!!)\[([^\]\n]+)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"

    def change(found: Column) -> Column:
        label, target = F.regexp_extract(found, link, 1), F.regexp_extract(found, link, 2)
        stays = target.rlike(r"^(?:https?://|mailto:|#)") | F.array_contains(known, F.regexp_replace(target, "#.*$", ""))
        return F.when(stays, found).otherwise(label)

    return outside(_text(text), CODE, lambda part: replaced(part, link, change))


def figure_tag(figure_id: Column, src: Column, caption: Column) -> Column:
    """A figure element; signs that attributes can't hold are entities."""

    def attribute(value: Column) -> Column:
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            value = F.replace(value, F.lit(sign), F.lit(entity))
        return value

    return F.concat(F.lit('<BookFigure id="'), attribute(figure_id), F.lit('" src="'), attribute(src), F.lit('" caption="'), attribute(caption), F.lit('" />'))


def figure_tags(text: Column) -> Column:
    """(id, src, caption) of each figure element of a text, entities resolved."""

    def value(tag: Column, name: str) -> Column:
        found = F.coalesce(prop(tag, name), F.lit(""))
        for sign, entity in (("'", "&#x27;"), ('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
            found = F.replace(found, F.lit(entity), F.lit(sign))
        return found.alias(name)

    return F.transform(matches(_text(text), rf"<BookFigure\b{ATTRIBUTES}>"), lambda tag: F.struct(value(tag, "id"), value(tag, "src"), value(tag, "caption")))


def known_figures(text: Column, allowed: Column) -> Column:
    """A text without figure elements whose id is not allowed."""
    return replaced(_text(text), rf"<BookFigure\b{ATTRIBUTES}>", lambda tag: F.when(F.array_contains(allowed, F.coalesce(prop(tag, "id"), F.lit(""))), tag).otherwise(""))


def card_html(text: Column) -> Column:
    """A card's face as HTML: formulas in their delimiters, no foreign tags, bold, italic, code, line breaks."""

    def prose(part: Column) -> Column:
        for pattern, new in ((r"<[^>]*>", ""), (r"\*\*([^*\n]+)\*\*", "<b>$1</b>"), (r"\*([^*\n]+)\*", "<i>$1</i>"), (r"`([^`\n]+)`", "<code>$1</code>"), (r"\r?\n", "<br>")):
            part = F.regexp_replace(part, pattern, new)
        return part

    def formula(span: Column) -> Column:
        shown = span.startswith("$$")
        inner = F.when(shown, F.regexp_replace(span, r"^\$\$|\$\$$", "")).otherwise(F.regexp_replace(span, r"^\$|\$$", ""))
        safe = F.replace(F.replace(F.replace(F.trim(inner), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.when(shown, F.concat(F.lit("\\["), safe, F.lit("\\]"))).otherwise(F.concat(F.lit("\\("), safe, F.lit("\\)")))

    body = F.regexp_replace(_text(text), r"^\s+|\s+$", "")
    return weave(F.transform(F.split(body, MATH, -1), prose), F.transform(matches(body, MATH), formula))


# Links between concepts


def quoted(term: Column) -> Column:
    """A pattern for a term: words of ASCII letters and digits stand alone, letters match in either case."""
    literal = F.regexp_replace(term, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    guarded = F.when(term.rlike("[A-Za-z0-9]"), F.concat(F.lit("(?<![A-Za-z0-9_])"), literal, F.lit("(?![A-Za-z0-9_])"))).otherwise(literal)
    return F.when(term.rlike("[A-Za-z]"), F.concat(F.lit("(?i)"), guarded)).otherwise(guarded)


def preview_link(href: Column, title: Column, summary: Column, label: Column) -> Column:
    text = lambda value: F.concat(F.lit('{"'), F.regexp_replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), "\n", "\\\\n"), F.lit('"}'))
    return F.concat(F.lit("<PreviewLink href="), text(href), F.lit(" title="), text(title), F.lit(" summary="), text(summary), F.lit(">"), F.trim(escape_text(label)), F.lit("</PreviewLink>"))


def wikilinks(text: Column, names: Column, previews: Column) -> Column:
    """[[name]] as a link to what the name stands for; in headings as plain text; unknown ones keep their canonical name.

    ``names``: map of a name to its canonical name; ``previews``: map of canonical names to (href, title, summary).
    """

    def link(found: Column, heading: bool) -> Column:
        label = F.trim(F.regexp_extract(found, WIKILINK, 1))
        canonical = F.coalesce(F.try_element_at(names, label), label)
        preview = F.try_element_at(previews, canonical)
        if heading:
            return canonical
        return F.when(preview.isNull(), F.concat(F.lit("[["), canonical, F.lit("]]"))).otherwise(preview_link(preview["href"], preview["title"], preview["summary"], canonical))

    prose = lambda part: weave(
        F.transform(F.split(part, HEADING_LINE, -1), lambda x: replaced(x, WIKILINK, lambda m: link(m, False))), F.transform(matches(part, HEADING_LINE), lambda x: replaced(x, WIKILINK, lambda m: link(m, True)))
    )
    return outside(_text(text), f"{FENCE}|{QUIZ_BLOCK}", prose)


def concept_links(text: Column, terms: Column, suppressed: Column) -> Column:
    """The first mention of each concept in the prose of a text as a link.

    ``terms``: (term, canonical, href, title, summary). From left to right, of terms that begin at one place the longest,
    a concept that has no link yet is linked; headings, code, formulas, links, tags and quiz blocks are no prose;
    ``suppressed`` are canonical names that are never linked.
    """
    text = _text(text)
    prose = masked(text, f"{FENCE}|{PROSE_GUARD}")
    near = F.filter(terms, lambda t: F.contains(F.lower(prose), F.lower(t["term"])))
    return linked_at(text, F.flatten(F.transform(near, lambda t: F.transform(places(prose, quoted(t["term"])), lambda p: F.struct(p["start"].alias("start"), (-p["size"]).alias("order"), t["canonical"].alias("canonical"), t.alias("of"))))), suppressed)


def linked_at(text: Column, found: Column, suppressed: Column) -> Column:
    """A text with links at the mentions ``found``: (start, order: minus the size, canonical, of: href, title, summary).

    From left to right, of mentions that begin at one place the longest; a concept is linked once.
    """
    start = F.struct(F.lit(0).alias("end"), F.coalesce(suppressed, F.array()).cast("array<string>").alias("linked"), F.lit("").alias("text"))

    def step(acc: Column, m: Column) -> Column:
        size = -m["order"]
        t = m["of"]
        link = preview_link(t["href"], t["title"], t["summary"], F.substring(text, m["start"] + 1, size))
        grown = F.struct(
            (m["start"] + size).alias("end"),
            F.array_append(acc["linked"], m["canonical"]).alias("linked"),
            F.concat(acc["text"], F.substring(text, acc["end"] + 1, m["start"] - acc["end"]), link).alias("text"),
        )
        return F.when((m["start"] < acc["end"]) | F.array_contains(acc["linked"], m["canonical"]), acc).otherwise(grown)

    return F.aggregate(F.array_sort(found), start, step, lambda acc: F.concat(acc["text"], F.substring(text, acc["end"] + 1, F.length(text))))


def resolved_figures(text: Column, index: Column) -> Column:
    """Figure elements as the map ``index`` of ids has them; elements of unknown ids go."""
    return replaced(_text(text), rf"<BookFigure\b{ATTRIBUTES}>", lambda tag: F.try_element_at(index, F.coalesce(prop(tag, "id"), F.lit(""))))


def features(text: Column | str) -> Column:
    """What a page has: frontmatter, quiz, cards, sources, a source reference."""
    text = _text(text)
    return F.struct(
        text.startswith("---\n").alias("frontmatter"), F.contains(text, F.lit("<QuizBlock")).alias("quiz"), F.contains(text, F.lit("<AnkiDeck")).alias("cards"),
        text.rlike(r"(?m)^##\s+Sources\b").alias("sources"), (F.contains(text, F.lit("<SourceRef")) | text.rlike(r"<!--\s*source_ref:")).alias("refs"),
    )


def first_paragraph(text: Column | str) -> Column:
    """The first paragraph that is no heading, on one line."""
    parts = F.filter(F.split(_text(text), r"\n\s*\n"), lambda p: p.rlike(r"\S") & ~p.rlike(r"^\s*#"))
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), r"\s+", " "), r"^ | $", "")
