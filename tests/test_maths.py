"""Formulas in pages: fences against a direct pairing, quotes, signs."""

import random
import re

from folio.functions import maths
from pyspark.sql import functions as F


def paired(text):
    """Peer of ``own_lines``: fences in the order they stand, two by two."""
    marks = [m.start() for m in re.finditer(r"\$\$", text)]
    if len(marks) % 2:
        return text
    out, last = "", 0
    for a, b in zip(marks[::2], marks[1::2]):
        inner, rest = text[a + 2 : b], text[b + 2 :]
        fine = (text[:a] == "" or text[:a].endswith("\n")) and inner.startswith("\n") and re.search(r"\n[ \t]*\Z", inner) and (rest == "" or rest.startswith("\n"))
        if "\n" in inner and not fine:
            out += text[last:a].rstrip(" \t") + f"\n\n$$\n{inner.strip()}\n$$\n\n"
            last = b + 2
    return out + text[last:]


def test_fences_against_direct_pairing(spark):
    rng = random.Random(1)
    parts = ["$$", "$$", "\n", "x", " ", "\n$$\n", "$$y$$", "\t", "a = b"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 16))) for _ in range(500)] + [""]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.t for r in frame.select("i", maths.own_lines(F.col("t")).alias("t")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == paired(t), repr(t)


CASES = [
    (r"so \(x\) and \[ y \] end", "so $x$ and\n\n$$\ny\n$$\n\nend"),
    ("a \\\\\n\n$$\n4pt]\nb", "a \\\\[4pt]\nb"),
    (r"$\tag{①}$ and ① $\\mathbf x \\[2pt] \left| a \right|$", r"$\tag{1}$ and ① $\mathbf x \\[2pt] \left\vert a \right\vert$"),
    (r"$\text{aθ} + \text{θ} + \text{b}$", r"$\text{a}\theta + \theta + \text{b}$"),
    ("text $$f(x) =\n1$$ more", "text\n\n$$\nf(x) =\n1\n$$\n\n more"),
    ("```\n$$a\nb$$\n``` `$$` x={[\"$$a\nb$$\"]} y={\"\\(a\\)\"}", "```\n$$a\nb$$\n``` `$$` x={[\"$$a\nb$$\"]} y={\"\\(a\\)\"}"),
    ("odd $$ one\ntwo", "odd $$ one\ntwo"),
    ("$$\nfine\n$$\nand $$x$$", "$$\nfine\n$$\nand $$x$$"),
    (None, None),
]
QUOTES = [
    (r"\frac{1}{n} + x_1.", r"$\frac{1}{n} + x_1$."),
    (r"The N-th sum: S_{n} = \sum a_i；", r"The N-th sum: $S_{n} = \sum a_i$；"),
    (r"\frac{1}{n} is not unbiased", r"\frac{1}{n} is not unbiased"),
    (r"already $x$ and \frac{1}{2}", r"already $x$ and \frac{1}{2}"),
    ("plain words: no formula", "plain words: no formula"),
    ("the command \\frac means", "the command \\frac means"),
    (r" \(x\) ", "$x$"),
    ("", ""),
    (r"前文 甲乙：\alpha = 2", r"前文 甲乙： $\alpha = 2$"),
]


def test_pages_and_quotes(spark):
    pages = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.t for r in pages.select("i", maths.normalised("t").alias("t")).collect()}
    for i, (t, want) in enumerate(CASES):
        assert got[i] == want, t
    quotes = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(QUOTES)], "i int, t string")
    got = {r.i: r.t for r in quotes.select("i", maths.quote_formulas(F.col("t")).alias("t")).collect()}
    for i, (t, want) in enumerate(QUOTES):
        assert got[i] == want, t
