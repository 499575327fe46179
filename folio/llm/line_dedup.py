"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A text is cut into lines: at line breaks, behind the marks that end sentences and clauses, and in long stretches without
marks behind words with certain last letters, since passages are often copied without their line breaks and pasted
into the middle of other lines: wherever they stand, they are cut alike. A window is the shortest run of lines
with at least ``WINDOW`` words; each window selects its line of minimum hash, the leftmost of equal ones. Two texts
that share a run of so many words in whole lines share a window and thus a selected line: every such run is found,
while only the selected lines are joined.

A fingerprint is a selected line with its window (one hash of the window's lines, which decide the line), so that common
short lines join nothing by themselves. Its first place in the corpus is its anchor. Each later text is aligned with the anchors' texts (and a
repetition inside one text with the place before it), the match is extended both ways line by line, and at its ends word
by word into the lines that are equal in part. What stands there for at least ``min_words`` words goes. A word goes only
if an equal run stands at an earlier place, so first occurrences always stay. A fingerprint makes at most two alignments
at each of its places: one with its anchor, one with the place before it in its own text.

A repeated run of whole lines with ``min_words`` words or more goes entirely: each of its lines is in a window inside the
run, and that window's anchor has the window's words. What may stay: runs whose ends lie inside lines and whose whole
lines fill no window, all shorter than a window and two long lines; and copies whose line breaks cut their sentences
elsewhere, where whole sentences fill none. Words are what white space divides; signs of scripts that write without
spaces are words of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import discard, spool

#: Words of a repeated run that is deleted, and of a window, the whole lines that it must hold.
MIN_WORDS, WINDOW = 20, 20

#: Signs of scripts that write without spaces (Thai, Lao, Burmese, Khmer, Kana, Han), by ranges, which are fast to test;
#: what a text's words are where it has such signs, with the space behind.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
SIGNS = rf"[{UNSPACED}]\s*|[^\s{UNSPACED}]+\s*"
#: A line of more words than ``LONG`` is cut behind words with one of ``ENDS`` as their last sign, into parts of ``LEAST`` to ``MOST`` words.
LONG, LEAST, MOST, ENDS = 16, 4, 12, ",;:ndND05нйνςの，、；：的了是"
#: Lines end at line breaks and at the space behind the marks that end sentences; ``WORD`` and ``SPACE`` are a word of a tidy text and a space inside a line.
MARKS = ".!?。！？"
WORD, SPACE = r"(?>[^ \n]+)", rf"(?<![{MARKS}]) "
#: A part: to the first word with one of ``ENDS`` from the word ``LEAST`` on, else ``MOST`` words or what is left, with or without a space behind it.
PART = rf"(?:{WORD}{SPACE}){{{LEAST - 1}}}(?:{WORD}(?<![{ENDS}]){SPACE}){{0,{MOST - LEAST}}}+{WORD}|{WORD}(?:{SPACE}{WORD}){{0,{MOST - 1}}}+"
#: A whole line up to ``LONG`` words, or a part of one, where single spaces are between words.
LINE = rf"(?:(?<![^\n])|(?<=(?:^|[{MARKS}\n]) )){WORD}(?:{SPACE}{WORD}){{0,{LONG - 1}}}+(?!{SPACE}[^ \n])|{PART}"
#: Lines on either side of a match whose words are compared.
NEXT = 3


def _tidy(text: Column | str) -> Column:
    """A text with single spaces or line breaks between its words."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    tidy = lambda t: F.regexp_replace(t, r"[^\S\n]+", " ")
    untidy = reduce(Column.__or__, [F.contains(whole, F.lit(sign)) for sign in ("  ", "\t", "\r", "\f", "\x0b")])
    return F.when(unspaced(whole), tidy(F.regexp_replace(whole, f"([{UNSPACED}])", " $1 "))).when(untidy, tidy(whole)).otherwise(whole)


def lines_of(text: Column | str) -> Column:
    """The lines of a text, single spaces between their words."""
    return F.regexp_extract_all(_tidy(text), F.lit(LINE), F.lit(0))


def words_of(text: Column | str) -> Column:
    """The words of a text, in order those of its lines."""
    return F.array_remove(F.split(F.replace(_tidy(text), F.lit("\n"), F.lit(" ")), " "), "")


def unspaced(text: Column) -> Column:
    """Whether a text has signs that are words of their own; plain ASCII is told by its size, most others by one range."""
    return (F.octet_length(text) > F.length(text)) & text.rlike(r"[^\x00-\u0DFF]") & text.rlike(f"[{UNSPACED}]")


def _size(line: Column) -> Column:
    """Words of a tidy line."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def sequences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc, h, w): hashes and words of the lines of each row; ``row`` tells rows apart that differ in doc_id or text."""
    return docs.select(_row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(doc_id).cast("long").alias("doc"), lines_of(F.col(text)).alias("lines")).select(
        "row", "doc", F.transform("lines", lambda line: F.xxhash64(line)).alias("h"), F.transform("lines", _size).alias("w")
    )


def selected(sequence: DataFrame, min_words: int) -> DataFrame:
    """(row, doc, pos, around): for each window of at least ``min_words`` words the line that it selects.

    ``around`` is a hash of the window's lines in order. A line is there once for each of its windows: the first may
    begin in front of a run that texts share, and so differ between them. A window is made at the first word of
    the line that it begins with, out of its text's arrays (``line``: each word's line), without a sort.
    """
    lines = F.flatten(F.transform("w", lambda n, at: F.array_repeat(at, n)))
    words = sequence.select("row", "doc", "h", lines.alias("line")).select("*", F.posexplode_outer("line").alias("word", "at"))  # outer, else Spark makes the array twice, to test its size
    begun = words.where((F.col("word") == 0) | (F.get("line", F.col("word") - 1) < F.col("at"))).withColumn("end", F.get("line", F.col("word") + (min_words - 1))).where("end IS NOT NULL")
    begun = begun.select("row", "doc", "at", F.slice("h", F.col("at") + 1, F.col("end") - F.col("at") + 1).alias("part"))
    least = F.col("at") + F.array_position("part", F.array_min("part")).cast("int") - 1
    return begun.select("row", "doc", least.alias("pos"), F.xxhash64("part").alias("around"))


def alignments(sequence: DataFrame, min_words: int) -> DataFrame:
    """(row, other, shift): texts to align; line pos of ``row`` meets line pos - shift of ``other``, an earlier place.

    Windows are counted by their hash alone first, and made a second time to be joined with the hashes that occur again,
    so that only these, a small part, are sorted and written. There a window meets the place before it in its text, and its
    first place alone meets other texts. What is joined with windows is aggregated and written before, so that adaptive
    execution can split the partition of a hash that a large part of all texts share. The result is spooled.
    """
    windows = selected(sequence, min_words)
    again = spool(windows.groupBy("around").count().where("count > 1").select("around"), "line-again")
    same = F.lag("pos").over(Window.partitionBy("row", "around").orderBy("pos"))
    places = spool(windows.join(again.hint("shuffle_hash"), "around").repartition("row", "around").withColumn("same", same), "line-places")
    inside = places.where("same IS NOT NULL").select("row", F.col("row").alias("other"), (F.col("pos") - F.col("same")).alias("shift")).where("shift > 0").distinct()
    once = places.where("same IS NULL")  # a window once in each text
    first = spool(once.groupBy("around").agg(F.min(F.struct("doc", "row", "pos")).alias("at"), F.count("*").alias("n")).where("n > 1").drop("n"), "line-anchors")
    ahead = once.join(first, "around").where(F.col("row") != F.col("at.row")).select("row", F.col("at.row").alias("other"), (F.col("pos") - F.col("at.pos")).alias("shift"))
    aligned = spool(inside.unionByName(ahead.distinct()), "line-alignments")
    for done in (again, places, first):
        discard(done)
    return aligned


def _runs(least: int) -> Column:
    """Runs of equal lines with at least ``least`` words, from h, w, other_h, other_w and shift, in words.

    ``begin`` and ``other_begin`` are the first word in either text, ``words`` how many the run has; ``before``, ``after``,
    ``other_before`` and ``other_after`` how many stand in the ``NEXT`` lines on either side.
    """
    first = F.greatest(F.lit(0), F.col("shift"))
    many = F.greatest(F.lit(0), F.least(F.size("h"), F.size("other_h") + F.col("shift")) - first)
    equal = F.zip_with(F.slice("h", first + 1, many), F.slice("other_h", first - F.col("shift") + 1, many), lambda a, b: F.when(a == b, "1").otherwise("0"))
    stretches = F.transform(F.regexp_extract_all(F.array_join(equal, ""), F.lit("1+|0+"), F.lit(0)), lambda s: F.struct(F.length(s).alias("n"), s.startswith("1").alias("equal")))
    none = F.expr("CAST(array() AS array<struct<at: int, n: int>>)")
    step = lambda acc, s: F.struct((acc["at"] + s["n"]).alias("at"), F.when(s["equal"], F.concat(acc["runs"], F.array(F.struct(acc["at"].alias("at"), s["n"].alias("n"))))).otherwise(acc["runs"]).alias("runs"))
    runs = F.aggregate(stretches, F.struct(first.alias("at"), none.alias("runs")), step, lambda acc: acc["runs"])
    words = lambda w, at, n: F.aggregate(F.slice(w, at + 1, n), F.lit(0), lambda x, y: x + y)
    long = F.filter(F.transform(runs, lambda run: F.struct(run["at"].alias("at"), run["n"].alias("n"), words("w", run["at"], run["n"]).alias("words"))), lambda run: run["words"] >= least)

    def placed(run: Column) -> Column:
        sides = [run["words"].alias("words")]
        for w, at, name in (("w", run["at"], ""), ("other_w", run["at"] - F.col("shift"), "other_")):
            low = F.greatest(F.lit(0), at - NEXT)
            sides += [words(w, F.lit(0), at).alias(name + "begin"), words(w, low, at - low).alias(name + "before"), words(w, at + run["n"], F.lit(NEXT)).alias(name + "after")]
        return F.struct(*sides)

    return F.transform(long, placed)


def _alike(one: Column, two: Column) -> Column:
    """How many words two lists have in common at their beginning."""
    end = F.array_position(F.zip_with(one, two, lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False))
    return F.when(end > 0, end - 1).otherwise(F.least(F.size(one), F.size(two))).cast("int")


def _ends(found: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, begin, words, left, right) of all ranges of words that runs have in either text: the words on either side.

    Ranges are gathered by text first, each once, so that a text goes through the join once however many meet it.
    """
    own = found.select("row", "begin", "words", "before", "after")
    theirs = found.select(F.col("other").alias("row"), F.col("other_begin").alias("begin"), "words", F.col("other_before").alias("before"), F.col("other_after").alias("after"))
    asked = own.unionByName(theirs).groupBy("row").agg(F.collect_set(F.struct("begin", "words", "before", "after")).alias("ranges"))
    texts = docs.select(_row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(text).alias("text")).join(asked, "row")

    def sides(words: Column, of: Column) -> Column:
        left = F.slice(words, of["begin"] - of["before"] + 1, of["before"])
        return F.struct(of["begin"].alias("begin"), of["words"].alias("words"), left.alias("left"), F.slice(words, of["begin"] + of["words"] + 1, of["after"]).alias("right"))

    each = F.get(F.transform(F.array(words_of("text")), lambda words: F.transform("ranges", lambda of: sides(words, of))), F.lit(0))  # a text's words are made once
    return texts.select("row", F.explode_outer(each).alias("range")).select("row", "range.*")  # outer for the same reason; no text is without ranges


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, doc, runs): for each distinct (doc_id, text) with repeats, the runs (first word, last word) to delete."""
    sequence = spool(sequences(docs, doc_id, text), "line-sequences")
    repeated = not sequence.groupBy("row").count().where("count > 1").isEmpty()
    if repeated:  # repeated rows are one document
        whole, sequence = sequence, spool(sequence.dropDuplicates(["row"]), "line-sequences")
        discard(whole)
    aligned = alignments(sequence, min(WINDOW, min_words))
    own = aligned.join(sequence, "row")
    other = sequence.select(F.col("row").alias("other"), F.col("h").alias("other_h"), F.col("w").alias("other_w"))
    found = own.join(other, "other").select("row", "doc", "other", F.explode_outer(_runs(min(WINDOW, min_words))).alias("run")).where("run IS NOT NULL").select("row", "doc", "other", "run.*")  # outer, else Spark makes the array twice, to test its size
    found = spool(found, "line-found")
    discard(aligned)
    discard(sequence)
    ends = _ends(found, docs, doc_id, text)
    ends = spool(ends.dropDuplicates(["row", "begin", "words"]) if repeated else ends, "line-ends")
    theirs = ends.select(F.col("row").alias("other"), F.col("begin").alias("other_begin"), "words", F.col("left").alias("other_left"), F.col("right").alias("other_right"))
    met = found.select("row", "doc", "other", "begin", "words", "other_begin").join(theirs, ["other", "other_begin", "words"]).join(ends, ["row", "begin", "words"])
    left, right = _alike(F.reverse("left"), F.reverse("other_left")), _alike(F.col("right"), F.col("other_right"))
    grown = met.select("row", "doc", (F.col("begin") - left).alias("first"), (F.col("begin") + F.col("words") - 1 + right).alias("last")).where(F.col("last") - F.col("first") + 1 >= min_words)
    runs = spool(grown.groupBy("row", "doc").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs")), "line-runs")
    for done in (found, ends):
        discard(done)
    return runs


def _gaps(runs: Column, size: Column) -> Column:
    """Stretches (at, n) of ``size`` words that lie in none of the runs, which are in order of their first words."""
    none = F.expr("CAST(array() AS array<struct<at: int, n: int>>)")
    gap = lambda acc, end: F.when(end > acc["at"], F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("at"), (end - acc["at"]).alias("n"))))).otherwise(acc["gaps"])
    step = lambda acc, run: F.struct(F.greatest(acc["at"], run["last"] + 1).alias("at"), gap(acc, run["first"]).alias("gaps"))
    return F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("gaps")), step, lambda acc: gap(acc, size))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """``docs`` with later repeats of passages cut out of ``text``; all rows and other columns stay as they were.

    Earlier and later go by doc_id (nulls first), then by text. White space does not count, but goes with the word before
    it. Rows equal in doc_id and text are one document and come back alike; texts under ``min_words`` words never change;
    null texts stay null; a text that is a repeat from end to end becomes empty. ``counts`` adds n_removed, in words.
    """
    runs = repeated_runs(docs, doc_id, text, min_words)
    keyed = docs.select(F.struct("*").alias("folio_row"), _row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(doc_id).cast("long").alias("doc"))
    same = (keyed["row"] == runs["row"]) & keyed["doc"].eqNullSafe(runs["doc"])
    joined = keyed.join(runs.hint("shuffle_hash"), same, "left").select("folio_row", "runs")
    body = F.col("folio_row")[text]
    joined = joined.withColumn("pieces", F.when(F.col("runs").isNull(), None).when(unspaced(body), F.regexp_extract_all(body, F.lit(SIGNS), F.lit(0))).otherwise(F.regexp_extract_all(body, F.lit(r"(?>\S+)\s*"), F.lit(0))))
    joined = joined.withColumn("kept", F.flatten(F.transform(_gaps(F.col("runs"), F.size("pieces")), lambda gap: F.slice("pieces", gap["at"] + 1, gap["n"]))))
    lead = F.when(F.size("kept") > 0, F.regexp_extract(body, r"^\s*", 0)).otherwise("")
    shorter = F.when(F.col("runs").isNull(), body).otherwise(F.concat(lead, F.array_join("kept", "")))
    columns = [shorter.alias(c) if c == text else F.col("folio_row")[c].alias(c) for c in docs.columns]
    if counts:
        columns.append(F.when(F.col("runs").isNull(), 0).otherwise(F.size("pieces") - F.size("kept")).cast("long").alias("n_removed"))
    return joined.select(*columns)
