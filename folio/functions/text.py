"""Text functions as Column expressions: identity keys, slugs, references, Markdown clean-up, scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns by which sources are referred to, and the phrases that instruct instead of inform.
SOURCE_REF = r"<!--\s*source_ref:\s*([A-Za-z0-9_.:/-]+)\s*-->"
INSTRUCTIONS = ["ignore previous instructions", "system prompt", "developer message"]
STOP_WORDS = ["and", "the", "with", "from", "chapter", "search"]
CJK = r"[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it: lambdas share no common expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def concept_key(name: Column) -> Column:
    """Letters and digits of a name without their case; '' for names without any."""
    return F.regexp_replace(F.translate(F.replace(F.lower(name), F.lit("ß"), F.lit("ss")), "ς", "σ"), r"[^\p{L}\p{N}]+", "")


def clean_markdown(text: Column) -> Column:
    unified = F.replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\f"), F.lit("\n\n"))
    return strip(F.regexp_replace(F.regexp_replace(unified, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def brief(title: Column, topics: Column) -> Column:
    """Title and its first three topics, at most 80 characters."""
    some = F.array_join(F.slice(topics, 1, 3), "、")
    return F.substring(F.when(some == "", title).otherwise(F.concat(title, F.lit("："), some)), 1, 80)


def section_slug(title: Column) -> Column:
    """ASCII slug of a heading, 'section' where nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", "section").otherwise(slug)


def source_id_from_stem(stem: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_.-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("source"))


def ref_source(ref: Column) -> Column:
    paged = F.regexp_extract(ref, r"^(.+?)-p\d+$", 1)
    slide = F.regexp_extract(ref, r"^(.+?)-slide\d+$", 1)
    return F.when(paged != "", paged).when(slide != "", slide).when(F.contains(ref, F.lit(".")), F.split_part(ref, F.lit("."), F.lit(1))).otherwise(F.split_part(ref, F.lit("-"), F.lit(1)))


def ref_page(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(ref, r"^.+?-p(\d+)$", 1), F.lit("")).try_cast("int")


def ref_slide(ref: Column) -> Column:
    return F.when(ref_page(ref).isNull(), F.nullif(F.regexp_extract(ref, r"^.+?-slide(\d+)$", 1), F.lit("")).try_cast("int"))


def ref_prefix(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(ref, r"^(.*?)(\d+)$", 1), F.lit(""))


def ref_number(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(ref, r"^(.*?)(\d+)$", 2), F.lit("")).try_cast("long")


def source_refs(text: Column) -> Column:
    """References of a text in order of kind and place, each once: comment marks, components, list items."""
    marks = F.regexp_extract_all(text, F.lit(SOURCE_REF), F.lit(1))
    components = F.regexp_extract_all(text, F.lit(r"<SourceRef\b[^>]*?\bid=[{]?[\"']([^\"']+)[\"'][}]?[^>]*>"), F.lit(1))
    items = F.regexp_extract_all(text, F.lit(r"(?m)^\s*-\s*`([^`]+)`\s*:"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.concat(marks, components, items), lambda r: F.trim(r)), lambda r: r != ""))


def plain_text(text: Column) -> Column:
    """Text without quiz and card blocks, component tags, reference marks and rules; children and formulas stay."""
    attributes = r"(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+"
    for pattern, new in (
        (r"<(QuizBlock|AnkiDeck)\b[\s\S]*?</\1>", ""),
        (rf"<(?:QuizBlock|AnkiDeck)\b{attributes}(?<=/)>\s*", ""),
        (rf"</?[A-Z]\w*{attributes}>", ""),
        (r"<!--\s*source_ref:\s*[^>]+-->", ""),
        (r"(?m)^\s*---\s*$", ""),
        (r"\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, new)
    return strip(text)


def keywords(text: Column) -> Column:
    """ASCII words of four characters or more, lower-cased, each once, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_-]{3,}"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS))))


def keyword_list(text: str) -> list[str]:
    """``keywords`` of a literal."""
    import re

    return sorted(set(re.findall("[a-z][a-z0-9_-]{3,}", text.lower())) - set(STOP_WORDS))


def token_count(text: Column, per: int = 4) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / per)).cast("long")


def estimated_tokens(text: Column) -> Column:
    """One token for each CJK character, a quarter for any other, rounded up."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, CJK, ""))
    return F.ceil(cjk + (F.length(text) - cjk) / 4).cast("long")


def suspicious_phrases(text: Column, phrases: list[str] = INSTRUCTIONS) -> Column:
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(text), p))


def decoded(segment: Column) -> Column:
    """Percent-decoded; what can't be decoded stays. A plus is a plus."""
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def csv_field(text: Column) -> Column:
    """Quoted where a comma, quote or line break asks for it."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def blank_answer(text: Column) -> Column:
    """An answer to a blank as it is compared: lower case, no spaces, full-width signs as ASCII."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    return F.regexp_replace(F.translate(F.lower(F.trim(text)), wide.lower(), "".join(chr(0x21 + i) for i in range(94)).lower()), r"\s+", "")


def summary(text: Column, most: int = 180) -> Column:
    """First paragraph without markup, cut to ``most`` characters with dots."""
    first = F.split(strip(text), r"\n\s*\n")[0]
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(first, r"<[^>]+>", " "), r"[*_`#>]", ""), r"\s+", " ")
    bare = F.trim(bare)
    return F.when(F.length(bare) > most, F.concat(F.rtrim(F.substring(bare, 1, most - 3)), F.lit("..."))).otherwise(bare)


def conversation_title(text: Column, most: int = 48) -> Column:
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("…"))).otherwise(one)


def fingerprint(*fields: Column) -> Column:
    """16 hex digits over the NUL-joined fields."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *fields), 256), 1, 16)


def string_array(json: Column) -> Column:
    """The strings of a JSON array; anything else is an empty array."""
    items = F.try_parse_json(json).try_cast("array<variant>")
    texts = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def match_query(text: Column) -> Column:
    """Words of three characters or more as quoted phrases, any of which may match."""
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) >= 3)
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def graph_summary(text: Column, most: int = 140) -> Column:
    """One line that keeps its formulas; a cut never falls between two dollar signs."""
    line = F.replace(F.replace(F.regexp_replace(strip(text), r"\s+", " "), F.lit("**"), F.lit("")), F.lit("`"), F.lit(""))
    cut = F.substring(line, 1, most)
    inside = (F.length(cut) - F.length(F.replace(cut, F.lit("$"), F.lit("")))) % 2 == 1
    whole = F.when(inside, F.regexp_replace(cut, r"\$[^$]*$", "")).otherwise(cut)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(whole), F.lit("…")))


def task_key(*fields: str) -> Column:
    """24 hex digits over the JSON of the fields in order of name."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(fields))), 256), 1, 24)


def heading_topic(heading: Column) -> Column:
    """What a chapter heading is about; '' for less than four characters."""
    bare = F.regexp_replace(F.regexp_replace(heading, r"(?i)^chapter\s+\d+\s+", ""), r"\([^)]*\)", "")
    topic = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ :-]+|[ :-]+$", "")
    topic = F.regexp_replace(topic, r"(?i)^the ", "")
    return F.when(F.length(topic) < 4, "").otherwise(topic)


def numbered_questions(text: Column, least: int = 8) -> Column:
    """All numbered lines of a text, without their numbers; short ones are none."""
    lead = r"^\s*(?:\d+|[一二三四五六七八九十]+)\s*[.、．)]\s*"
    lines = F.filter(F.split(text, r"\r\n?|\n"), lambda line: line.rlike(lead))
    return F.filter(F.transform(lines, lambda line: strip(F.regexp_replace(line, lead, ""))), lambda q: F.length(q) >= least)


def graded(checks: list[Column]) -> tuple[Column, Column]:
    """Share of answers that are right, and the verdict."""
    right = sum((c.cast("int") for c in checks), F.lit(0))
    return right / F.lit(float(len(checks))), F.when(right == len(checks), "correct").when(right == 0, "incorrect").otherwise("partial")


def paged(text: Column) -> Column:
    """Form feeds as page marks, counted from 1."""
    pages = F.transform(F.split(text, "\f"), lambda page, i: F.concat(F.lit("<!-- page "), (i + 1).cast("string"), F.lit(" -->\n"), page))
    return F.array_join(pages, "\n\n")


# How prose names the document it was made from, names no file may have, and JSON's escapes.
NARRATION = "|".join([
    "源材料",
    "源文档",
    "源文本",
    "源文(?=[中里所的提指写给说表最])",
    "原文(?=[中里所的提指写给说表最明])",
    "文档中(?=对此|有|的描述|描述|提到|给出|写道|指出|说明)",
    "书中(?=提到|描述|写道|指出|给出|有清晰|清晰)",
    "教材中",
    "课本中",
    "原书(?=[中里的指提写给])",
    "如(?:源材料|源文|原文)所(?:述|示|说|写)",
    "根据(?:源材料|源文|原文|教材|课本|原书)",
    "源中(?=对此|有|提到|描述|给出)",
])
RESERVED_NAMES = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]
JSON_ESCAPE = r"\\(?![\"\\/bfnrtu])"


def path_segment(name: Column, fallback: str = "item", most: int = 80) -> Column:
    """One safe segment of a path: long ones end in 8 hex digits of their hash, empty and reserved ones are named by it.

    Names that look alike must already be composed (NFC); nothing in SQL composes them.
    """
    digest = F.substring(F.sha2(name, 256), 1, 8)
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), r"(?U)[^\w.-]+", "-"), "-{2,}", "-")
    bare = F.regexp_replace(bare, r"^[-.]+|[-.]+$", "")
    cut = F.concat(F.regexp_replace(F.substring(bare, 1, most - 9), r"^[-.]+|[-.]+$", ""), F.lit("-"), digest)
    fits = F.when(F.length(bare) > most, cut).otherwise(bare)
    return F.when((fits == "") | F.lower(fits).isin(RESERVED_NAMES), F.concat(F.lit(f"{fallback}-"), digest)).otherwise(fits)


#: Fixed value: how long a passage in round brackets may be to be told as a whole.
LONGEST_ASIDE = 600


def narrations(text: Column) -> Column:
    """What speaks of the document it was made from, each once: the aside （…） around it, else its sentence from the last mark on.

    Each is a piece of the text as it stands, so that a repair finds it.
    """
    from folio.functions.markup import places

    def span(text: Column, found: Column, back: Column) -> Column:
        end = found["start"] + found["size"]
        opened, shut = F.instr(back, "（"), F.instr(back, "）")
        begin = found["start"] - opened
        # An aside is no longer than LONGEST_ASIDE, so its end is sought no farther.
        close = end + F.instr(F.substring(text, end + 1, F.greatest(F.lit(0), begin + LONGEST_ASIDE + 1 - end)), "）") - 1
        aside = (opened > 0) & ((shut == 0) | (shut > opened)) & (close >= end)
        # The text before is read backwards: a pattern that must end at its end would be tried from each of its places.
        left = F.regexp_replace(F.reverse(F.regexp_extract(back, "\\A[^。！？\\n；（）]*", 0)), r"^[ \t]+", "")
        right = F.regexp_extract(F.substring(text, end + 1, F.length(text)), "\\A[^。！？\\n]*[。！？\\n]?", 0)
        sentence = F.concat(left, F.substring(text, found["start"] + 1, found["size"]), right)
        return F.regexp_replace(F.when(aside, F.substring(text, begin + 1, close - begin + 1)).otherwise(sentence), r"(?U)^\s+|\s+$", "")

    def told(text: Column) -> Column:
        here = lambda f: let(F.reverse(F.substring(text, F.lit(1), f["start"])), lambda back: span(text, f, back))
        return F.array_distinct(F.filter(F.transform(places(text, F.lit(NARRATION)), here), lambda s: s != ""))

    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(let(text, told))


def same_segment(segment: Column, raw: Column) -> Column:
    """Whether a path segment and a raw slug are one, decoded or encoded either way."""
    encoded = lambda t: F.replace(F.url_encode(t), F.lit("+"), F.lit("%20"))
    return (segment == raw) | (segment == decoded(raw)) | (decoded(segment) == raw) | (decoded(segment) == decoded(raw)) | (encoded(segment) == raw) | (encoded(decoded(segment)) == raw)


def within_budget(text: Column, tokens: Column) -> Column:
    """The longest beginning of a text within a number of tokens, CJK characters one each, others a quarter."""
    head = F.substring(text, F.lit(1), F.greatest(tokens * 4, F.lit(0)).cast("int"))
    start = F.struct(F.lit(0).alias("quarters"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, c: Column) -> Column:
        more = acc["quarters"] + F.when(c.rlike(CJK), 4).otherwise(1)
        over = acc["full"] | (more > tokens * 4)
        return F.struct(more.cast("int").alias("quarters"), (acc["n"] + F.when(over, 0).otherwise(1)).alias("n"), over.alias("full"))

    n = F.aggregate(F.filter(F.split(head, ""), lambda c: c != ""), start, step, lambda acc: acc["n"])
    return F.when(tokens <= 0, "").when(estimated_tokens(text) <= tokens, text).otherwise(F.substring(text, F.lit(1), n))


#: Characters of a quote that are compared at once, characters of context, and how far a place may be off: 1000 / 2.
FUZZY_BITS, CONTEXT, FUZZY_REACH = 32, 32, 500


#: Rows whose windows are read side by side.
FUZZY_ROWS = 2048


def _read_backward(texts: list[str], patterns: list[str], near: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``fuzzy_place`` of some rows with windows ``texts`` that start at ``begin``; -1 without any. One word a row and number of errors."""
    n = len(texts)
    sizes, lengths = np.array([len(p) for p in patterns]), np.array([len(t) for t in texts])
    points = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)[::-1]
    signs, backward = np.full((max(lengths.max(), 1), n), 0xFFFFFFFE, np.uint32), np.full((sizes.max(), n), 0xFFFFFFFF, np.uint32)
    for i, (t, p) in enumerate(zip(texts, patterns)):
        signs[: len(t), i], backward[: len(p), i] = points(t), points(p)
    masks = np.zeros(signs.shape, np.uint64)
    for i, p in enumerate(backward):
        masks |= (signs == p).astype(np.uint64) << np.uint64(i)
    one, most = np.uint64(1), sizes // 2
    words = np.repeat(((one << np.arange(most.max() + 1, dtype=np.uint64)) - one)[:, None], n, 1)
    top, all_rows = one << (sizes - 1).astype(np.uint64), np.arange(n)
    # In order: cost, then more errors, then the first place; one number for all three.
    best, none = np.full(n, np.iinfo(np.int64).max), np.iinfo(np.int64).max
    for j in range(lengths.max()):
        ahead = words << one | one
        new = ahead & masks[j]
        new[1:] |= words[:-1] | ahead[:-1]
        for d in range(1, len(new)):
            new[d] |= new[d - 1] << one | one
        words = new
        rows = np.flatnonzero((words[most, all_rows] & top != 0) & (j < lengths))
        if len(rows):
            errors = (words[:, rows] & top[rows] != 0).argmax(0)
            at = lengths[rows] - 1 - j
            cost = errors * 1000 + np.abs(begin[rows] + at - near[rows]) * sizes[rows]
            told = (cost * 64 + (63 - errors)) << 20 | at
            best[rows] = np.minimum(best[rows], np.where(cost <= 500 * sizes[rows], told, none))
    return np.where(best == none, -1, begin + (best & (1 << 20) - 1))


def fuzzy_place(text: Column, pattern: Column, near: Column) -> Column:
    """Where a text has a pattern of at most ``FUZZY_BITS`` characters with the fewest errors, near a place; null without any.

    Bit-parallel matching: for each number of errors a word whose bits are the ends of the pattern that the text read so
    far begins with. The text is read from right to left, so a full word is a place where the pattern begins. An error
    costs 1000 / length, a character of distance 1, and places up to half the cost of a pattern of errors count; so the
    window around ``near`` and the number of words are bounded, whatever the text. The lowest cost wins, of equal ones
    that with more errors, then the first. Batches of rows are read side by side, a sign of each at a time; rows without
    a pattern cost nothing.
    """
    size, near = F.length(pattern), F.greatest(F.lit(0), F.least(near, F.length(text)))
    begin = F.greatest(F.lit(0), near - FUZZY_REACH)
    end = F.least(F.length(text), near + FUZZY_REACH + size + F.floor(size / 2).cast("int"))

    @F.pandas_udf("int")
    def found(window: pd.Series, pattern: pd.Series, near: pd.Series, begin: pd.Series) -> pd.Series:
        out = np.full(len(window), -1)
        rows = np.flatnonzero((window.notna() & pattern.notna()).to_numpy())
        for i in range(0, len(rows), FUZZY_ROWS):
            some = rows[i : i + FUZZY_ROWS]
            out[some] = _read_backward(window.iloc[some].tolist(), pattern.iloc[some].tolist(), near.iloc[some].to_numpy(np.int64), begin.iloc[some].to_numpy(np.int64))
        return pd.Series(out, dtype="Int64").where(out >= 0)

    wanted = lambda c: F.when(size > 0, c)
    return found(wanted(F.substring(text, begin + 1, end - begin)), wanted(pattern), near, begin)


def _in_common(a: Column, b: Column) -> Column:
    """Characters that two short texts begin with alike."""
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(CONTEXT)), lambda i: (F.length(a) >= i) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))))


def anchored(text: Column, quote: Column, start: Column, prefix: Column | None = None, suffix: Column | None = None) -> Column:
    """(start, end) of a quote in a text: where it was, else its exact place of the best context, then the nearest, else its
    first with other white space, else the place of its head and of its tail with the fewest errors nearby; null without any."""
    size, prefix, suffix = F.length(quote), F.lit("") if prefix is None else prefix, F.lit("") if suffix is None else suffix
    loose = F.regexp_replace(F.regexp_replace(F.trim(quote), r"([\\\[\](){}.*+?^$|])", r"\\$1"), r"\s+", r"\\s+")
    parts = F.split(text, F.concat(F.lit(r"\Q"), quote, F.lit(r"\E")), -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, p: a + F.length(p)) + (i - 1) * size)
    before = lambda at: F.reverse(F.substring(text, F.greatest(F.lit(0), at - CONTEXT) + 1, at - F.greatest(F.lit(0), at - CONTEXT)))
    context = lambda at: _in_common(before(at), F.reverse(prefix)) + _in_common(F.substring(text, at + size + 1, F.lit(CONTEXT)), suffix)
    nearest = F.get(F.array_sort(F.transform(ends, lambda at: F.struct((-context(at)).alias("context"), F.abs(at - start).alias("far"), at.alias("at")))), F.lit(0))["at"]
    there = F.regexp_instr(text, loose) - 1
    found = lambda at, n: F.struct(at.cast("int").alias("start"), (at + n).cast("int").alias("end"))
    # Errors are counted only where nothing else is left, those of a tail only where the head isn't all.
    exact = (F.substring(text, start + 1, size) == quote) | F.contains(text, quote) | ((F.trim(quote) != "") & (there >= 0))
    inexact = lambda part, when: F.when((quote != "") & when & ~exact, part)
    head = fuzzy_place(text, inexact(F.substring(quote, 1, FUZZY_BITS), F.lit(True)), start)
    tail = fuzzy_place(text, inexact(F.substring(quote, -FUZZY_BITS, FUZZY_BITS), size > FUZZY_BITS), start + size - FUZZY_BITS)
    upto = F.when(size <= FUZZY_BITS, head + size).otherwise(F.coalesce(tail + FUZZY_BITS, head + size))
    upto = F.least(F.length(text), F.greatest(upto, head + 1))
    return (
        F.when((quote != "") & (F.substring(text, start + 1, size) == quote), found(start, size))
        .when((quote != "") & F.contains(text, quote), found(nearest, size))
        .when((F.trim(quote) != "") & (there >= 0), found(there, F.length(F.regexp_substr(text, loose))))
        .when((quote != "") & (upto > head), F.struct(head.cast("int").alias("start"), upto.cast("int").alias("end")))
    )


def repaired_json(text: Column) -> Column:
    """A JSON text whose lone backslashes are doubled; pairs that mean something stay."""
    pairs = r"\\[\"\\/bfnrtu]"
    gaps = F.transform(F.split(text, pairs, -1), lambda g: F.replace(g, F.lit("\\"), F.lit("\\\\")))
    return F.array_join(F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pairs), F.lit(0)), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def first_heading(text: Column, otherwise: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(\S.*?)[ \t]*$", 1)), F.lit("")), otherwise)


def replaced_once(text: Column, old: Column, new: Column) -> Column:
    """(text, error): a replacement where the old text stands exactly once; otherwise the text as it was and why."""
    n = F.when(old == "", -1).otherwise((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)).cast("int")
    error = F.when(n < 0, "empty").when(n == 0, "missing").when(n > 1, F.concat(n.cast("string"), F.lit(" matches")))
    return F.struct(F.when(n == 1, F.replace(text, old, new)).otherwise(text).alias("text"), error.alias("error"))


def line_view(text: Column, first: Column, last: Column, most: int = 400) -> Column:
    """Numbered lines first to last of a text, ``most`` at most; null where the range is empty."""
    lines = F.split(text, "\n", -1)
    low = F.greatest(first, F.lit(1))
    high = F.least(last, F.size(lines), low + most - 1)
    shown = F.transform(F.slice(lines, low, F.greatest(high - low + 1, F.lit(0))), lambda line, i: F.concat((i + low).cast("string"), F.lit(": "), line))
    return F.when(high >= low, F.array_join(shown, "\n"))


def xml_chunks(text: Column) -> Column:
    """A text as chunks by reference marks, with what stands before the first mark in the first; null without marks."""
    escape = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts, refs = F.split(text, SOURCE_REF, -1), F.regexp_extract_all(text, F.lit(SOURCE_REF), F.lit(1))
    bodies = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p, i: strip(F.when(i == 0, F.concat(strip(F.get(parts, F.lit(0))), F.lit("\n\n"), strip(p))).otherwise(p)))
    chunks = F.zip_with(refs, bodies, lambda r, b: F.concat(F.lit('  <chunk ref="'), escape(r), F.lit('">'), escape(b), F.lit("</chunk>")))
    return F.when(F.size(refs) > 0, F.concat(F.lit("<document>\n"), F.array_join(chunks, "\n"), F.lit("\n</document>")))


def owner_file(owner: Column) -> Column:
    """The page that a check's owner stands for."""
    concept = F.concat(F.lit("concepts/"), F.regexp_replace(owner, "^concept-mdx:", ""), F.lit(".mdx"))
    return F.when(owner.startswith("concept-mdx:"), concept).otherwise(F.concat(F.lit("chapters/"), F.regexp_replace(owner, ":[^:]*$", ""), F.lit(".mdx")))


def chunk_budget(cap: Column, factor: Column, overhead: int = 8000) -> Column:
    """Tokens of a chunk: a share of what the prompt leaves, at least one; null where it would not stay below the cap."""
    usable = cap - overhead
    budget = F.floor(usable * factor)
    fits = F.when(budget >= 1, budget).otherwise(F.greatest(F.lit(1), usable)).cast("long")
    return F.when(fits < cap, fits)


def config_hash(*fields: str) -> Column:
    """16 hex digits over the JSON of settings in order of name."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(fields))), 256), 1, 16)


def without_files(parts: Column) -> Column:
    """Parts of a message but for files."""
    return F.filter(parts, lambda p: p["type"] != "file")
