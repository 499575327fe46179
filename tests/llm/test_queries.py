"""Each query of the corpus operators on the smallest tables: its columns, and one row where the contract asks for one."""

import duckdb
import pytest

from folio.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2_ann": "query_id rank vec_id score",
    "op3_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_quality": "doc_id held_out score predicted",
    "op5_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_embedding_dedup": "vec_id n_links component_id kept",
    "op8_line_dedup": "doc_id n_removed text",
    "op9_pii": "doc_id n_entities text",
    "op10_simhash": "doc_id fingerprint component_id",
    "op11_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op12_source_divergence": "lang source part item value rank",
    "op13_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
}
TABLE = {"op2_ann": None, "op3_warc": "pages", "op6_packing": None, "op7_embedding_dedup": "embeddings", "op12_source_divergence": None, "op13_filter_audit": None}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    made = Q.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(made.columns)
    rows = made.collect()
    table = TABLE.get(name, "documents")
    if table:
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    elif name == "op2_ann":
        asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").count()
        assert len(rows) == 10 * asked and {r["rank"] for r in rows} == set(range(1, 11))
    elif name == "op6_packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
        for s in {r.sequence_id for r in rows}:
            own = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made = Q.queries()[name](spark, SF)
    columns = sorted(made.columns)
    frame = con.execute(Q.oracle_sql()[name]).df()
    assert sorted(frame.columns) == columns
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in made.collect()) == sorted(tuple(map(str, row)) for row in frame[columns].itertuples(index=False, name=None))
