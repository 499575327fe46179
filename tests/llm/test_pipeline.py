import corpus_pipeline as C
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage kept, on the smallest tables and odd rows; each stage reads what the one before wrote."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "s", None), (10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "", None, None, 0), (10**6 + 2, "", None, None, 0)], docs.schema)
    now, out = docs.unionByName(odd), {}
    out["documents"] = now.collect()
    for name, stage in C.STAGES:
        to = str(tmp_path_factory.mktemp(name) / "t")
        made = stage(spark, now, SF)
        if name != C.STAGES[-1][0]:
            assert made.columns == docs.columns
        made.write.parquet(to)
        now = spark.read.parquet(to)
        out[name] = now.collect()
    return out


def test_stages_filter_and_change(stages):
    ids = {k: [r.doc_id for r in v] for k, v in stages.items() if k != "pack_documents"}
    assert set(ids["quality_filter"]) < set(ids["documents"])
    assert sorted(ids["dedup_lines"], key=str) == sorted(ids["quality_filter"], key=str)
    assert len(ids["dedup_documents"]) == len({(r.doc_id, r.text) for r in stages["dedup_documents"]}) < len(ids["dedup_lines"])
    assert sorted(ids["replace_pii"], key=str) == sorted(ids["dedup_documents"], key=str)
    assert sum("@mail" in (r.text or "") for r in stages["replace_pii"]) == 0 < sum("@mail" in (r.text or "") for r in stages["documents"])
    assert {r.doc_id for r in stages["pack_documents"]} == set(ids["replace_pii"])


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages["quality_filter"]}
    right = [(i in kept) == q for i, q in labels.items()]
    assert sum(right) / len(right) > 0.9


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        made = stage(spark, docs, SF)
        assert made.collect() == [], name


def test_run(spark):
    assert C.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
