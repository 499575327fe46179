import random
import re

from folio.llm import license_scan as L

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = []
    for phrase, label in BASE.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def texts():
    rng = random.Random(5)
    words = sorted({w.decode() for _, t in L.TEMPLATES for w in L.words_of(t)}) + ["x", "über", "2.0", "BY-NC", "MIT"]
    phrases = list(BASE) + [t for _, t in L.TEMPLATES]
    for _ in range(300):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(0, 30))]
        yield rng.choice([" ", "\n", ", ", "-"]).join(parts)
    yield from ["", None, "cc by nc cc by nc", "under the mit license " * 3, "apache license version 2.0", "apache license version 20", "under under the mit license", "CC BY-NC 4.0"]


def test_base_places_match_brute_force():
    for text in texts():
        got = L.scanner().scan(text)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == brute(text), text


def test_matching_statistics():
    own = L.scanner()
    inverse = {n: w for w, n in own.vocabulary.items()}
    sequences = [[own.vocabulary[w] for w in L.words_of(t)] for t in [*BASE, *(t for _, t in L.TEMPLATES)]]
    inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    rng = random.Random(2)
    import numpy as np

    for _ in range(60):
        stream = []
        while len(stream) < 40:
            s = rng.choice(sequences)
            i = rng.randrange(len(s))
            stream += s[i : i + rng.randrange(1, 8)]
        for at, _, matched in own.statistics(np.array(stream, np.int32)):
            longest = max(k for k in range(at + 2) if k == 0 or tuple(stream[at + 1 - k : at + 1]) in inside)
            assert matched == longest, [inverse[x] for x in stream[: at + 1]]


def test_labels_spans_and_scores():
    got = L.scanner().scan("Foo. This work is licensed under the GNU General Public License, version 3. Bar")
    assert got["labels"] == "gpl-3" and got["base_labels"] == "" and got["score"] == 1.0
    (span,) = [s for s in got["spans"] if s["label"] == "gpl-3"]
    assert (span["first"], span["last"]) == (4, 12)
    broken = "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and associated documentation files"
    assert L.scanner().scan(broken)["labels"] == "mit"
    assert L.scanner().scan("plain words of a story about the public")["score"] == 0.0


def test_table(spark):
    rows = [(1, "Released under the MIT License.", 9), (1, "Released under the MIT License.", 9), (None, None, 9), (3, "", 9), (4, "word " * 200_000, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted((tuple(r)[:8] for r in L.scan_licenses(frame).collect()), key=str)
    assert got == sorted([(1, 5, 1, 1, 1, "mit", "mit", 1.0)] * 2 + [(None, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), (4, 200_000, 0, None, None, "", "", 0.0)], key=str)
    assert L.scan_licenses(frame.limit(0)).collect() == []
