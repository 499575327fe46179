"""Queries against their SQL on rows that the given tables don't hold: ties, nulls, exact borders."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import plain

from folio.operators import concepts as K
from folio.plans import registry

T0 = dt.datetime(2020, 1, 1)
LINES = [(1, 7, 1, T0), (1, 7, 1, T0.replace(day=9)), (2, 3, 5, T0.replace(day=3)), (2, 3, 5, T0), (3, None, 1, T0), (3, 9, 2, T0.replace(day=2)), (4, 1, 1, None), (4, 2, 1, T0), (5, None, 1, T0), (None, 1, 1, T0), (6, 1, 200, T0.replace(day=5)), (6, 2, 1, T0)]
EVENTS = [(1, -41), (1, -39), (1, 39), (1, 200), (1, None), (2, None), (2, 0), (None, 5), (3, 2**60 + 39), (3, 2**60 + 160), (3, 2**60 + 161)]
TEXTS = ["a" * 51 + "\n" + "b" * 98, "a" * 50 + "\n" + "b" * 99, "", None, "12.5 is no question. But this one is it. short", "3) neither. x. One of  . The last question \u0085", "No stop at all", "A tab\tand\x0bsigns. Another question\n"]
ROWS = {
    "AG04_ref_registry": ("lineitem", "l_partkey BIGINT, l_orderkey BIGINT, l_linenumber INTEGER, l_shipdate TIMESTAMP", LINES),
    "XC10_line_windows": ("events", "user_id BIGINT, event_id BIGINT", EVENTS),
    "PF14_truncated": ("documents", "doc_id BIGINT, text VARCHAR", list(enumerate(TEXTS))),
    "FN54_questions": ("documents", "doc_id BIGINT, text VARCHAR", list(enumerate(TEXTS))),
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_query(spark, tmp_path, name):
    source, columns, rows = ROWS[name]
    duck = duckdb.connect()
    duck.execute("SET threads = 1")
    duck.execute(f"CREATE TABLE made ({columns})")
    duck.executemany(f"INSERT INTO made VALUES ({', '.join('?' * len(rows[0]))})", rows)
    duck.execute(f"COPY made TO '{tmp_path}/{source}.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW {source} AS SELECT * FROM '{tmp_path}/{source}.parquet'")
    made = registry.queries()[name](spark, str(tmp_path))
    columns = sorted(made.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in made.collect())
    told = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert got == sorted(tuple(plain(v) for v in row) for row in told)


def test_exam_questions_of_every_topic_are_mapped(spark):
    """Every even size up to 20 has its chapter; names are stripped and without case, a name with another sign is another."""
    sf = "/root/testdata/sf0.001"
    sizes = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    got = {r.p_partkey: r.chapter_id for r in registry.queries()["CH20_exam_pools"](spark, sf).collect()}
    assert got == {k: f"c{n:02}" if n <= 20 else "_unmapped" for k, n in sizes.items() if n % 2 == 0}
    asked = spark.createDataFrame([(1, ["topic-8"]), (2, [" Topic 8"])], "q int, c array<string>")
    pools = K.exam_pools(asked, "q", F.col("c"), spark.createDataFrame([("c08", 8, ["TOPIC 8"])], "chapter_id string, ord int, concepts array<string>"))
    assert {r.q: r.chapter_id for r in pools.collect()} == {1: "_unmapped", 2: "c08"}


def test_every_question_is_kept(spark, tmp_path):
    """Of 120 questions all are, in code and in SQL; short ones are still none."""
    text = "Head. " + "short. ".join(f"Question {n:03}. " for n in range(120))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = registry.queries()["FN54_questions"](spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = duck.execute(f"SELECT questions FROM ({registry.oracle_sql()['FN54_questions']})").fetchall()
    assert [r.questions for r in made] == [r[0] for r in told] == ["|".join(f"Question {n:03}" for n in range(120))]


def in_duck(folder, source, columns, rows, sql):
    """The rows of a statement over made rows, which are left as a file with row groups of 2,048 rows."""
    duck = duckdb.connect()
    duck.execute("SET threads = 1")
    duck.execute(f"CREATE TABLE made ({columns})")
    duck.executemany(f"INSERT INTO made VALUES ({', '.join('?' * len(rows[0]))})", rows)
    duck.execute(f"COPY made TO '{folder}/{source}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    duck.execute(f"CREATE VIEW {source} AS SELECT * FROM '{folder}/{source}.parquet'")
    told = duck.execute(sql)
    names = [d[0] for d in told.description]
    return sorted(tuple(plain(dict(zip(names, row))[c]) for c in sorted(names)) for row in told.fetchall())


def of_spark(made):
    columns = sorted(made.columns)
    return sorted(tuple(plain(r[c]) for c in columns) for r in made.collect())


def test_points_of_equal_parts_are_the_first_ones(spark, tmp_path):
    """Several returned rows of a line with one part, discounts and parts that are null or no numbers, lines without a key."""
    nan = float("nan")
    rows = [(1, 1, 7, 0.03, "R", 9.0), (1, 1, 7, 0.01, "R", 9.0), (1, 1, 8, 0.09, "R", 0.5), (2, 1, 5, None, "R", 9.0), (2, 1, 6, 0.04, "R", None), (2, 1, 6, 0.02, "R", 9.0), (3, 1, None, 0.05, "R", 9.0), (3, 1, 9, 0.06, "N", 9.0)]
    rows += [(4, 2, 3, nan, "R", 2.0), (4, 2, 3, 0.01, "R", 2.0), (5, 1, 2, -0.01, "R", 3.0), (None, 1, 2, 0.01, "R", 3.0), (6, None, 2, 0.01, "R", 3.0), (7, 1, 1, 0.01, None, 3.0)]
    name, columns = "JN17_graded_points", "l_orderkey BIGINT, l_linenumber INTEGER, l_partkey BIGINT, l_discount DOUBLE, l_returnflag VARCHAR, l_quantity DOUBLE"
    told = in_duck(tmp_path, "lineitem", columns, rows, registry.oracle_sql()[name])
    assert of_spark(registry.queries()[name](spark, str(tmp_path))) == told


def test_chapters_without_a_book_keep_their_rows(spark, tmp_path):
    """Customers without a nation or without a key, negative keys, and pins that are taken or not."""
    rows = [(k, k % 2) for k in range(-40, 40)] + [(k, 3) for k in (99, 100, 102, 103, 104)] + [(k, None) for k in (300, 301, 302, None)] + [(None, 3), (None, 3)]
    name = "WN07_pinned_slugs"
    told = in_duck(tmp_path, "customer", "c_custkey BIGINT, c_nationkey INTEGER", rows, registry.oracle_sql()[name])
    assert of_spark(registry.queries()[name](spark, str(tmp_path))) == told and len(told) == len(rows)
