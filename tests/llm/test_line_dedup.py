import random
import re

from folio.llm import line_dedup as L

SCHEMA = "doc_id long, text string, row long, h string"


def naive(rows, least):
    """Whether each word stands in a run of ``least`` words that is at an earlier place, by comparing all windows."""
    first, gone = set(), []
    for _, text in rows:
        words = (text or "").split()
        own = [False] * len(words)
        for a in range(len(words) - least + 1):
            window = tuple(words[a : a + least])
            if window not in first:
                first.add(window)
            else:
                own[a : a + least] = [True] * least
        gone.append(own)
    return gone


def rest(rows, gone):
    return [" ".join(w for w, g in zip((text or "").split(), own) if not g) for (_, text), own in zip(rows, gone)]


def removed(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return {r.doc_id: r for r in L.remove_repeats(frame, counts=True, **more).collect()}


def corpus(seed):
    rng = random.Random(seed)
    sentence = lambda: " ".join(f"w{rng.randrange(10**5)}" for _ in range(rng.randrange(1, 9))) + rng.choice([".", "!", "?", ",", ""])
    pool = [sentence() for _ in range(400)]
    passages = [rng.sample(pool, 18) for _ in range(6)]
    rows = []
    for i in range(60):
        body = rng.sample(pool, rng.randrange(1, 12))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(passages)
        rows.append((i, ("\n" if seed % 2 else " ").join(body)))
    return rows + [(100 + i, rows[i][1]) for i in range(10)]


def test_only_repeats_go_and_no_passage_of_50_words_stays_twice(spark):
    """Sentences with and without marks, all in lines of their own or all one after the other, passages between any of them."""
    for seed in (1, 2):
        rows = corpus(seed)
        out = removed(spark, rows)
        allowed, words = naive(rows, L.MIN_WORDS), 0
        for (i, text), may in zip(rows, allowed):
            assert out[i].n_removed == len(text.split()) - len(out[i].text.split())
            assert out[i].n_removed <= sum(may)
            words += out[i].n_removed
        assert words > 0.95 * sum(map(sum, allowed)) > 1000
        assert sum(map(sum, naive([(i, out[i].text) for i, _ in rows], 50))) == 0
        assert all(not out[100 + i].text for i in range(10) if len(rows[i][1].split()) >= 50)


def test_matches_brute_force_over_all_windows(spark):
    """Whole lines, unequal neighbours, copies of different length: nothing is left over."""
    rng = random.Random(11)
    passage = [" ".join(f"p{j}w{k}" for k in range(6)) + "." for j in range(5)]
    rows = []
    for i in range(12):
        own = [" ".join(f"d{i}s{j}w{k}" for k in range(rng.randrange(2, 7))) + "." for j in range(6)]
        at = rng.randrange(6)
        rows.append((i, "\n".join(own[:at] + (passage if i % 3 == 0 else passage[:3] if i % 3 == 1 else []) + own[at:])))
    out = removed(spark, rows, min_words=15)
    assert [out[i].text.split() for i, _ in rows] == [t.split() for t in rest(rows, naive(rows, 15))]


def test_third_document_shares_a_run_with_the_second_only(spark):
    """A hot line stands first elsewhere; the run of 28 words around it is shared by the later texts alone."""
    line = lambda n, sign: " ".join(f"{sign}{k}" for k in range(n)) + "."
    hot, run = line(4, "hot"), [line(8, "a"), line(8, "b"), line(8, "c")]
    rows = [(1, "\n".join([line(9, "x"), hot, line(9, "y")])), (2, "\n".join([line(7, "u"), hot, *run, line(5, "v")])), (3, "\n".join([line(6, "q"), hot, *run, line(7, "r")]))]
    out = removed(spark, rows)
    assert (out[1].n_removed, out[2].n_removed, out[3].n_removed) == (0, 0, 28)
    assert out[3].text.split() == (line(6, "q") + " " + line(7, "r")).split()


def test_hot_line_opens_runs_of_later_texts(spark):
    """Short lines that stand first in another text, also twice in a text, open a run of two or three lines."""
    rng = random.Random(5)
    line = lambda least, most: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(least, most))) + "."
    rows = []
    for k in range(60):
        hot, passage = line(2, 4), [line(7, 15) for _ in range(1 + k % 2)]
        texts = [[line(5, 9), hot, line(5, 9), line(5, 9)]]
        for _ in range(2):
            again = [hot, line(8, 12)] if k % 3 == 0 else []
            texts.append([*again, line(3, 9), line(3, 9), hot, *passage, line(3, 9), line(3, 9)])
        rows += [(3 * k + i, "\n".join(t)) for i, t in enumerate(texts)]
    out = removed(spark, rows, min_words=12)
    assert [out[i].text.split() for i, _ in rows] == [t.split() for t in rest(rows, naive(rows, 12))]


def test_passage_pasted_into_the_middle_of_sentences(spark):
    """55 words whose ends are merged into other lines go to the last word; so do those without any marks."""
    rng = random.Random(3)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    for marks in (True, False):
        words = some(55).split()
        passage = " ".join(w + ("." if marks and k % 11 == 6 else "") for k, w in enumerate(words))
        rows = [(1, f"{some(9)} {passage} {some(12)}."), (2, f"{some(30)}. {some(4)} {passage} {some(8)}."), (3, f"{passage}")]
        out = removed(spark, rows)
        assert out[1].n_removed == 0 and out[3].text == ""
        assert out[2].n_removed == 55 and out[2].text.split() == rows[1][1].replace(passage, "").split()


def test_junk_of_one_word_shrinks(spark):
    out = removed(spark, [(1, "Start here. " + "and " * 500 + "then stop.")])
    assert 470 <= out[1].n_removed <= 499 and out[1].text.startswith("Start here. and ") and out[1].text.endswith("then stop.")


def test_a_text_that_very_many_are_aligned_with(spark):
    passage = " ".join(f"p{k}" for k in range(30)) + "."
    rows = [(i, f"Own {i} line {i}.\n{passage}\n{i} ends {i}.") for i in range(80)]
    out = removed(spark, rows)
    assert [out[i].n_removed for i in range(80)] == [0] + [30] * 79


def test_odd_rows(spark):
    long = "The same twelve words stand here again and again in this line. "
    rows = [(1, None), (None, long * 3), (2, ""), (2, ""), (3, long * 2000), (4, "short"), (5, "short"), (6, long * 3), (6, long * 3), (7, "\n\n\n")]
    frame = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text, r.row, r.h) for r in L.remove_repeats(frame).collect()), key=str)
    assert len(got) == len(rows) and all(r[2:] == (9, "x") for r in got)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1])
    assert by[1] == [None] and by[2] == ["", ""] and by[4] == by[5] == ["short"] and by[7] == ["\n\n\n"]
    assert by[6] == ["", ""] and by[3] == [""] and by[None][0].startswith(long)
    assert L.remove_repeats(frame.limit(0)).collect() == []


def test_lines_are_cut_at_breaks_sentences_and_certain_words(spark):
    text = "One two. Three, four\nfive  six;\n" + " ".join(map(str, range(20)))
    got = spark.createDataFrame([(text,)], "t string").select(L.lines_of("t").alias("l")).first().l
    assert got == ["One two.", "Three, four", "five six;", "0 1 2 3 4 5", "6 7 8 9 10", "11 12 13 14 15", "16 17 18 19"]
    assert re.sub(r"\s+", " ", text) == " ".join(got)


def test_windows_are_made_without_a_window_function(spark):
    """The line and the lines' hash of each run of at least 20 words, by hand; a text is sorted only if it repeats a line."""
    rng = random.Random(6)
    texts = [(i, [rng.randrange(1, 9) for _ in range(rng.randrange(30))]) for i in range(40)]
    rows = [(i, i, [rng.randrange(10**9) for _ in w], w) for i, w in texts]
    frame = spark.createDataFrame(rows, "row long, doc long, h array<long>, w array<int>")
    made = L.selected(frame, 20)
    assert "Sort" not in made._jdf.queryExecution().executedPlan().toString()
    got, want = {}, {}
    for r in made.collect():
        got.setdefault(r.row, []).append((r.pos, r.around))
    hashes = {}
    for i, _, h, w in rows:
        for a in range(len(w)):
            b = next((b for b in range(a, len(w) + 1) if sum(w[a:b]) >= 20), None)
            if b is not None:
                part = h[a:b]
                want.setdefault(i, []).append(a + part.index(min(part)))
                hashes.setdefault(tuple(part), None)
    assert {i: [p for p, _ in v] for i, v in got.items()} == want
    assert len({a for v in got.values() for _, a in v}) == len(hashes)


def test_windows_anchored_in_different_texts(spark):
    """Short texts hold two lines each of a passage; the first text with all of it stays, the second loses it."""
    lines = [" ".join(f"l{j}w{k}" for k in range(9)) + "." for j in range(10)]
    rows = [(j, f"own {j} start.\n{lines[j]}\n{lines[j + 1]}\nown {j} end.") for j in range(9)]
    rows += [(20, "a begins.\n" + "\n".join(lines) + "\na ends."), (21, "b begins.\n" + "\n".join(lines) + "\nb ends.")]
    out = removed(spark, rows)
    assert [out[i].n_removed for i in range(9)] == [0] * 9 and (out[20].n_removed, out[21].n_removed) == (0, 91)  # "begins." too
    assert out[21].text.split() == "b b ends.".split()


def test_runs_of_whole_lines_against_brute_force_without_tolerance(spark):
    """Pieces of passages of many lengths, each first seen in another text: just the words of naive() go."""
    rng = random.Random(8)
    passages = [[" ".join(f"p{p}l{j}w{k}" for k in range(rng.randrange(3, 9))) + "." for j in range(14)] for p in range(5)]
    rows = []
    for i in range(80):
        body = []
        for n in range(rng.randrange(1, 4)):
            p, a = rng.choice(passages), rng.randrange(13)
            body += [f"d{i}n{n}x d{i}n{n}y."] + p[a : a + rng.randrange(1, 9)]
        rows.append((i, "\n".join(body)))
    out = removed(spark, rows)
    want = rest(rows, naive(rows, L.MIN_WORDS))
    assert sum(out[i].n_removed for i, _ in rows) > 1000
    assert [out[i].text.split() for i, _ in rows] == [t.split() for t in want]


def test_scripts_without_spaces(spark):
    rng = random.Random(9)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(n))
    passage = "".join(han(rng.randrange(5, 12)) + mark for mark in "，。，。，。，。")
    rows = [(1, f"{han(9)}。{passage}{han(8)}。"), (2, f"{han(7)}。{passage}{han(6)}。"), (3, f"{passage}"), (4, f"{han(7)}。{han(30)}。")]
    out = removed(spark, rows)
    assert out[1].n_removed == out[4].n_removed == 0 and out[1].text == rows[0][1] and out[4].text == rows[3][1]
    assert out[3].text == "" and out[2].text == rows[1][1].replace("。" + passage, "")


def test_only_windows_that_occur_again_are_written(spark, monkeypatch):
    """Texts repeat a short line, but no window: nothing but their lines is written; a window that occurs again is, at each place."""
    written, spool = {}, L.spool

    def noted(df, name):
        out = spool(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(L, "spool", noted)
    own = lambda i: [w for j in range(6) for w in (" ".join(f"d{i}l{j}w{k}" for k in range(9)) + ".", "Again.")]
    rows = [(i, "\n".join(own(i))) for i in range(10)]
    assert all(r.n_removed == 0 for r in removed(spark, rows).values())
    assert written.pop("line-sequences") == 10 and sum(written.values()) == 0
    written.clear()
    both = " ".join(f"p{k}" for k in range(12)) + ".\n" + " ".join(f"q{k}" for k in range(12)) + "."
    out = removed(spark, rows + [(20, both), (21, f"{both}\n{own(30)[0]}\n{both}")])
    assert (out[20].n_removed, out[21].n_removed, written["line-places"]) == (0, 48, 3)


def test_words_of_a_text_are_those_of_its_lines(spark):
    rng = random.Random(4)
    signs = ["a", "b1", "end,", "stop.", "x!", " ", "  ", "\n", "\t", "\r\n", " ", "漢字。", "ไทย", "день", "\u0001", "😀"]
    rows = [("".join(rng.choice(signs) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(120))),) for _ in range(300)] + [(None,)]
    got = spark.createDataFrame(rows, "t string").select(L.lines_of("t").alias("l"), L.words_of("t").alias("w")).collect()
    assert all([w for line in r.l for w in line.split(" ") if w] == r.w for r in got)


def test_a_space_at_the_end_of_a_long_line_changes_no_cut(spark):
    text = " ".join(f"w{k}q" for k in range(21))
    got = spark.createDataFrame([(text + end + "\nx",) for end in ("", " ", " \t")], "t string").select(L.lines_of("t").alias("l")).collect()
    assert [[line.count(" ") + 1 for line in r.l] for r in got] == [[12, 9, 1]] * 3
