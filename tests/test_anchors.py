"""Fuzzy places of quotes against edit distances by dynamic programming."""

import random

from pyspark.sql import functions as F

from folio.functions import text as T


def errors_at(text, pattern, at):
    """The fewest edits that make the pattern of some stretch of the text that begins there."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text[at : at + 2 * len(pattern)]:
        new = [row[0] + 1]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def place(text, pattern, near):
    near = max(0, min(near, len(text)))
    found = []
    for at in range(max(0, near - 500), min(len(text), near + 501)):
        e = errors_at(text, pattern, at)
        cost = 1000 * e + len(pattern) * abs(at - near)
        if cost <= 500 * len(pattern) and e <= len(pattern) // 2:
            found.append((cost, -e, at))
    return min(found)[2] if found else None


def spoiled(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(i, rng.choice("abc𝒜 "))
        elif out and kind == 1:
            out.pop(min(i, len(out) - 1))
        elif out:
            out[min(i, len(out) - 1)] = rng.choice("xyz")
    return "".join(out)


def test_places_against_dynamic_programming(spark):
    rng = random.Random(2)
    rows = []
    for i in range(150):
        text = "".join(rng.choices("abcde é", k=rng.choice([0, 5, 60, 200])))
        at = rng.randrange(len(text) + 1)
        pattern = spoiled(rng, text[at : at + rng.choice([1, 6, 12, 32])], rng.randrange(6))[:32] or "zq"
        rows.append((i, text, pattern, at + rng.randrange(-20, 20)))
    got = {r.i: r.at for r in spark.createDataFrame(rows, "i int, text string, pattern string, near int").select("i", T.fuzzy_place(F.col("text"), F.col("pattern"), F.col("near")).alias("at")).collect()}
    assert got == {i: place(t, p, n) for i, t, p, n in rows}


def test_far_places_and_long_texts_stay_cheap(spark):
    text = "filler " * 100_000 + "the quotation stands here" + " filler" * 10
    rows = [(1, text, "teh quotation stnads here", 700_010), (2, text, "teh quotation stnads here", 10)]
    frame = spark.createDataFrame(rows, "i int, text string, pattern string, near int")
    got = {r.i: r.at for r in frame.select("i", T.fuzzy_place(F.col("text"), F.col("pattern"), F.col("near")).alias("at")).collect()}
    assert got[1] == place(text, rows[0][2], 700_010) and abs(got[1] - 700_000) < 5 and got[2] is None


def test_tiers_of_anchors(spark):
    quote = "a long quotation that has more than thirty-two characters in it"
    rows = [
        ("aa bb aa cc aa", "aa", 6, "", "", (6, 8)),
        ("aa bb aa cc aa", "aa", 7, "bb ", " cc", (6, 8)),
        ("xx aa, yy aa; zz aa", "aa", 16, "yy ", ";", (10, 12)),
        ("one  two\n three", "two three", 4, "", "", (5, 15)),
        ("say: a lnog quotation that has more than thirty-two charakters in itt.", quote, 5, "", "", (5, 70)),
        ("some wrods", "words", 5, "", "", (5, 10)),
        ("nothing alike", "qqqq", 3, "", "", None),
        ("text", "", 0, "", "", None),
    ]
    frame = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, text string, quote string, start int, prefix string, suffix string")
    got = {r.i: r.at and tuple(r.at) for r in frame.select("i", T.anchored(F.col("text"), F.col("quote"), F.col("start"), F.col("prefix"), F.col("suffix")).alias("at")).collect()}
    for i, r in enumerate(rows):
        if i == 4:
            assert got[i][0] == 5 and abs(got[i][1] - 69) <= 1
        else:
            assert got[i] == r[5], r
