import random
import re

from folio.functions import markup as M
from folio.operators import assembly as A
from folio.operators import linking
from pyspark.sql import functions as F

NAMES = ["term", "canonical", "href", "title", "summary"]


def linked(text, terms):
    """Peer of ``concept_links`` for prose: from left to right, the longest term of a concept that has no link yet."""
    done, out, at = set(), [], 0
    while at < len(text):
        fits = []
        for term, canonical in terms:
            if canonical not in done and text[at : at + len(term)].lower() == term and not re.match(r"\w", text[at - 1 : at] if at else "") and not re.match(r"\w", text[at + len(term) : at + len(term) + 1]):
                fits.append((len(term), term, canonical))
        if fits:
            size, _, canonical = max(fits, key=lambda f: f[0])
            out.append(f"<{canonical}|{text[at : at + size]}>")
            done.add(canonical)
            at += size
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def test_links_of_overlapping_and_repeated_terms(spark):
    rng = random.Random(1)
    terms = [("network", "net"), ("neural network", "nn"), ("neural", "neuron"), ("deep neural network", "dnn"), ("deep", "depth"), ("nets", "net")]
    words = ["Neural", "network", "deep", "nets", "and", "networks", "x", "neural network", "Deep neural network"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(60)]
    column = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(NAMES, (t, c, c, c, c)))) for t, c in terms))
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.linked for r in frame.select("i", M.concept_links(F.col("text"), column, F.array()).alias("linked")).collect()}
    short = lambda t: re.sub(r'<PreviewLink href=\{"([^"]*)"\}[^>]*>([^<]*)</PreviewLink>', r"<\1|\2>", t)
    assert [short(got[i]) for i in range(60)] == [linked(t, terms) for t in texts]
    table = spark.createDataFrame([(t, c, c, c, c) for t, c in terms], ", ".join(f"{n} string" for n in NAMES))
    for most in (100, 2):  # one automaton, and several
        many = {r.i: r.text for r in linking.linked(frame, "i", "text", table, most=most).collect()}
        assert many == got


def test_links_keep_out_of_code_headings_formulas_and_quizzes(spark):
    text = "# net\n`net` $net$ [net](x) <b net>\n```\nnet\n```\n<QuizBlock>net</QuizBlock> subnet net_x\n"
    column = F.array(F.struct(*(F.lit("net").alias(n) for n in NAMES)))
    frame = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    got = [r.t for r in frame.select(M.concept_links(F.col("text"), column, F.array()).alias("t")).collect()]
    assert got == [text, "", ""]
    assert frame.where("text <> ''").select(M.concept_links(F.concat("text", F.lit("net")), column, F.array(F.lit("net"))).alias("t")).first().t == text + "net"


def test_braces_at_any_depth(spark):
    inner = '[{"a": "}" , "b": {"c": "\\"{"}}, [[{}]]]'
    frame = spark.createDataFrame([(f" x={{{inner}}} y={{1}}",), (" x={open",), ("",)], "a string")
    assert [r.x for r in frame.select(M.braced(F.col("a"), "x").alias("x")).collect()] == [inner, None, None]


def test_slugs_where_a_numbered_title_is_taken(spark):
    titles = ["x-2", "x", "X", "x", "appendix", "x-2"]
    rows = spark.createDataFrame([("b", i, t) for i, t in enumerate(titles)], "book string, place int, title string")
    got = {r.place: r.slug for r in A.slugs_of(rows, "book", "place", "title").collect()}
    assert [got[i] for i in range(6)] == ["x-2", "x", "X-3", "x-4", "appendix-2", "x-2-2"]


def test_signs_cases_and_bounds_of_many_terms(spark):
    """The automaton finds what the patterns find: signs, letters beyond A-Z, digits, terms inside words."""
    terms = ["C++", "é", "École", "电磁", "a b", "x1", "_y", "$", "Ab"]
    texts = ["C++ c++ xC++ C++y", "é É école ÉCOLE cole École", "电磁感应 x电磁x", "A B a  b a bc", "x1 X1 x12 _x1", "_y z_y _Y", "ab AB aB cab", "", None, "`ab` # ab\n# ab\nab $ab$"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    column = F.array(*(F.struct(*(F.lit(t).alias(n) for n in NAMES)) for t in terms))
    want = {r.i: r.t for r in frame.where("text IS NOT NULL").select("i", M.concept_links(F.col("text"), column, F.array()).alias("t")).collect()}
    table = spark.createDataFrame([(t,) * 5 for t in terms], ", ".join(f"{n} string" for n in NAMES))
    got = {r.i: r.text for r in linking.linked(frame, "i", "text", table).collect()}
    assert got == want | {8: None}


def test_slugs_of_random_titles_against_a_loop(spark):
    """Numbers that titles have themselves, the reserved one, pins: each slug is the first that is free."""
    rng = random.Random(4)
    rows = [(f"b{i % 8}", i, rng.choice(["Intro", "intro", "Intro 2", "intro-2-2", "Appendix", "appendix-2", "Part", "x", "X-3"])) for i in range(240)]
    got = {(r.book, r.place): r.slug for r in A.slugs_of(spark.createDataFrame(rows, "book string, place int, title string"), "book", "place", "title").collect()}
    pins = [(f"b{k}", f"p{k * 10 + j}", rng.choice(["Intro-2", "part", "x-3", "other"])) for k in range(8) for j in range(3)]
    chapters = [(b, i, f"p{rng.randrange(80)}", t.replace(" ", "-")) for b, i, t in rows]
    schema = "book string, place int, print string, slug string"
    made = {(r.book, r.place): r.slug for r in A.pinned_slugs(spark.createDataFrame(chapters, schema), spark.createDataFrame(pins, "book string, print string, pin string"), "book", "place").collect()}

    def free(base, used):
        slug, n = base, 2
        while slug.lower() in used:
            slug, n = f"{base}-{n}", n + 1
        used.add(slug.lower())
        return slug

    for book in {b for b, _, _ in rows}:
        used = {"appendix"}
        for b, i, title in rows:
            if b == book:
                assert got[b, i] == free(title.replace(" ", "-"), used), (title, used)
        pinned = {p: pin for b, p, pin in pins if b == book}
        used, hold = {"appendix"}, {}
        for b, i, p, _ in chapters:
            if b == book and p in pinned and pinned[p].lower() not in {h.lower() for h in hold.values()}:
                hold[i] = pinned[p]
        used |= {h.lower() for h in hold.values()}
        for b, i, _, slug in chapters:
            if b == book:
                assert made[b, i] == (hold[i] if i in hold else free(slug, used))
