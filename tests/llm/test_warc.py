import base64
import hashlib
import io

import pyarrow.fs
import pytest
import zstandard

from folio.llm import warc as W

SCHEMA = "page_id long, url string, html string, bundle string"


def rows():
    made = [(i, f"http://h{i % 3}.example/{i}", "<p>" + "é" * (i % 7) + "</p>") for i in range(60)]
    made += [(100, None, None), (101, "http://a b\r\nX: y", ""), (102, "u", "<html>" + "long " * 300_000), (103, "u", "WARC/1.1\r\n\r\n\r\n"), (None, "u", "<p></p>"), (None, "u", "only mine"), (7, "u", "<p></p>"), (0, "again", "<p></p>")]
    return made


def brute(given):
    out, first = [], {}
    for page, _, html in given:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    for page, _, html in given:
        body = (html or "").encode()
        one = first.get(html or "")
        revisit = one is not None and one != page
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", one if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    given = rows()
    frame = spark.createDataFrame([(*r, "clash") for r in given], SCHEMA).repartition(3)
    index = W.write_archives(frame)
    read = W.read_archives(index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read), key=str) == brute(given)
    named = [r.record_id for r in index.collect()]
    assert len(named) == len(set(named)) == len(given)
    body = {r.page_id: bytes(r.payload) for r in read if r.payload is not None and r.page_id is not None}
    assert all(body[p] == (h or "").encode() for p, _, h in given if p in body and p not in (0, 7))
    wanted = spark.createDataFrame([(W.record_id(i),) for i in (3, 100, 102)], "record_id string")
    assert sorted((r.page_id, r.payload_bytes) for r in W.lookup(index, wanted).collect()) == sorted((p, len((h or "").encode())) for p, _, h in given if p in (3, 100, 102))


def test_bundles_are_plain_zstandard(spark, monkeypatch):
    index = W.write_archives(spark.createDataFrame([(*r, "x") for r in rows()], SCHEMA))
    for name in {r.bundle for r in index.collect()}:
        system, path = pyarrow.fs.FileSystem.from_uri(name)
        raw = system.open_input_file(path).read()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1\r\n")
        reader = W.Reader(io.BytesIO(raw))
        assert b"".join(reader.frame(i) for i in range(len(reader.sizes))) == whole


def test_damage_is_an_error():
    record = W.write_record(5, "u", b"body", None, False, "2000-01-01T00:00:00Z")
    assert W.parse_record(record, 0)[0]["payload"] == b"body"
    with pytest.raises(ValueError):
        W.parse_record(record.replace(b"body", b"bodY"), 0)
    with pytest.raises(ValueError):
        W.Reader(io.BytesIO(b"x" * 50))


def test_empty(spark):
    index = W.write_archives(spark.createDataFrame([], SCHEMA))
    assert W.read_archives(index).collect() == []
