"""The trigram index against a scan of all texts."""

import random
import re

import pytest

from folio.operators import gram_index as G
from folio.operators import retrieval as R

CHUNKS = "row_id long, text string, heading string"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(1)
    words = ["aaa", "aaaa", "banana", "Über", "电磁感应", "反向传播", "ering", "ab", "x", "𝒜𝒜𝒜b", "Straße"]
    rows = [(i, rng.choice([" ", "", "-"]).join(rng.choices(words, k=rng.choice([0, 1, 5, 40]))), rng.choice(["", "ana", "aaa 反向传播", None])) for i in range(120)]
    return spark.createDataFrame([*rows, (500, None, None), (501, "é ", "zz"), (502, "a", None)], CHUNKS).cache()


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    small = G.BLOCK_SIGNS
    G.BLOCK_SIGNS = 300  # several blocks a gram
    made = G.build(chunks, f"file://{tmp_path_factory.mktemp('index')}", heading="heading", parts=8, slices=2)
    G.BLOCK_SIGNS = small
    return made


@pytest.mark.parametrize("phrase", ["aaa", "aaaa", "aaaaa", "banana", "ana ban", "电磁感应", "反向传播", "über", "absent phrase", "straßeaaa", "𝒜𝒜b", "aaabanana"])
def test_occurrences_overlap_and_stay_inside_a_column(index, chunks, phrase):
    count = lambda t: len(re.findall(f"(?={re.escape(phrase)})", (t or "").lower()))
    want = {r.row_id: count(r.text) + count(r.heading) for r in chunks.collect()}
    got = {r.row_id: r.tf for r in G.occurrences(index, phrase).collect()}
    assert got == {i: n for i, n in want.items() if n}


@pytest.mark.parametrize("query", ["banana", "aaa 反向传播", "ering 电磁感应 über", "banana nowhere", "nowhere at all", "ab x"])
def test_scores_are_those_of_the_scan(index, chunks, query):
    want = {r.row_id: r.score for r in R.bm25(chunks, query, "row_id", "text", "heading").collect()}
    assert {r.row_id: r.score for r in G.bm25(index, query).collect()} == pytest.approx(want)


@pytest.mark.parametrize("shuffled", [False, True])
def test_no_broadcast_beyond_the_bound(index, monkeypatch, shuffled):
    monkeypatch.setattr(G, "BROADCAST_PLACES", 0 if shuffled else 10**6)
    index.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    found = G.occurrences(index, "banana")
    plan = found._jdf.queryExecution().executedPlan().toString()
    index.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("SortMergeJoin" in plan, "BroadcastHashJoin" in plan) == (shuffled, not shuffled)


@pytest.mark.parametrize("query", ["é ", "a", "na", "Straße", "BAN", "zz", "-x", "nowhere"])
def test_substrings_of_any_length(index, chunks, query):
    want = {r.row_id for r in R.like(chunks, query, "row_id", "text").collect()}
    assert {r.row_id for r in G.holding(index, chunks, query).collect()} == want


def test_a_search_reads_its_own_grams_only(index):
    plan = G.occurrences(index, "banana")._jdf.queryExecution().toString()
    scans = [x for x in plan.split("\n") if "FileScan parquet" in x]
    assert scans and all("PartitionFilters: [isnotnull(part" in x or "PartitionFilters: [part" in x for x in scans)
    assert all(re.search(r"PushedFilters: \[[^\]]*gram", x) for x in scans) and "text" not in " ".join(scans)
    read = {f.split("part=")[1].split("/")[0] for f in G._of(index, [G.gram_key("ban")]).inputFiles()}
    assert len({f.split("part=")[1].split("/")[0] for f in index.postings.inputFiles()}) > 1 and read


def test_absent_grams_read_no_postings(index):
    assert "FileScan" not in G.occurrences(index, "qqq")._jdf.queryExecution().toString()


def test_dictionary(index, chunks):
    want = {}
    for r in chunks.collect():
        for t in (r.text, r.heading):
            low = (t or "").lower()
            for i in range(len(low) - 2):
                want.setdefault(low[i : i + 3], []).append(r.row_id)
    got = {r.gram: (r.docs, r.places) for r in G.dictionary(index).withColumn("gram", G.gram_text(G.F.col("gram"))).collect()}
    assert got == {g: (len(set(rows)), len(rows)) for g, rows in want.items()}


def test_empty_table(spark, tmp_path):
    made = G.build(spark.createDataFrame([], CHUNKS), f"file://{tmp_path}/empty", heading="heading", parts=2)
    assert G.bm25(made, "banana").collect() == [] and made.rows == 0
