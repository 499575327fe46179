"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle is a run of frames and, as its last frame, a skippable one with
the seek table of the public seekable format (compressed and plain size of every frame). The index maps each record to
its bundle, its frame and its offset within that frame's plain bytes, so one record costs one frame. Equal payloads are
stored once: the record with the smallest page is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import new_folder, spool

#: Plain bytes after which a frame, and compressed bytes after which a bundle is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 25

# The seekable format's skippable frame, its footer, and the two WARC identifiers that revisits need.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"

INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, mark: str = "") -> str:
    """A record's identifier: a response goes by its page; ``mark`` tells apart what else has the page, or none."""
    return f"urn:folio:page:{'none' if page_id is None else page_id}{mark and ':'}{mark}"


def _page(urn: str) -> int | None:
    named = urn.strip("<>").split(":")[3]
    return None if named == "none" else int(named)


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, mark: str = "") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{record_id(page_id, mark)}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to)}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines.split(b"\r\n") if line)}


def parse_record(plain: bytes, offset: int) -> tuple[dict, int]:
    """The record at an offset of a frame's plain bytes, and where it ends; a broken record is an error."""
    if plain[offset : offset + len(VERSION)] != VERSION:
        raise ValueError(f"no WARC record at {offset}")
    body = plain.index(b"\r\n\r\n", offset) + 4
    head = _headers(plain[offset + len(VERSION) : body - 4])
    end = body + int(head["content-length"])
    if plain[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {offset} has no end")
    block = plain[body:end]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_headers(http.partition(b"\r\n")[2])["content-length"])
    named, revisit = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "revisit"
    if not revisit and (digest(payload) != named or len(payload) != size):
        raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
    return {
        "page_id": _page(head["warc-record-id"]),
        "url": head.get("warc-target-uri"),
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": named,
        "record_type": head["warc-type"],
        "refers_to": _page(head["warc-refers-to"]) if revisit else None,
    }, end + 4


class Bundle:
    """One bundle being written. ``entries``: (record_id, page_id, frame, offset, length)."""

    def __init__(self, out, level: int) -> None:
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.sizes: list[tuple[int, int]] = []
        self.entries: list[tuple[str, int | None, int, int, int]] = []
        self.plain, self.waiting, self.written = [], 0, 0
        self.responses: set[int] = set()

    def mark(self, page_id: int | None, revisit: bool, name: str) -> str:
        """What the next record's identifier needs besides its page to be the only one."""
        if page_id is not None and not revisit and page_id not in self.responses:
            self.responses.add(page_id)
            return ""
        return f"{name}-{len(self.entries)}"

    def add(self, page_id: int | None, record: bytes, mark: str = "") -> None:
        self.entries.append((record_id(page_id, mark), page_id, len(self.sizes), self.waiting, len(record)))
        self.plain.append(record)
        self.waiting += len(record)
        if self.waiting >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            frame = self.pack(b"".join(self.plain))
            self.out.write(frame)
            self.sizes.append((len(frame), self.waiting))
            self.plain, self.waiting, self.written = [], 0, self.written + len(frame)

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to the frames of one bundle by its seek table."""

    def __init__(self, source) -> None:
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("the bundle has no seek table")
        source.seek(size - 9 - 8 * count)
        raw = source.read(8 * count)
        self.sizes = [struct.unpack_from("<II", raw, 8 * i) for i in range(count)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, number: int) -> bytes:
        self.source.seek(self.starts[number])
        packed, plain = self.sizes[number]
        return self.unpack(self.source.read(packed), max_output_size=plain)


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", level: int = 3, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row into bundles under ``folder`` (default: a new one in the shared folder); returns their index.

    The payload is the html in UTF-8, empty for null. Of equal payloads the smallest page_id is the response (each of
    its rows, if it is repeated); a null page_id is a response only if no other has its payload. Bundles carry a name
    of their own per task attempt, and the index, itself written to the shared folder, names only finished ones: what a
    lost executor leaves behind is never read.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    copies = rows.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(copies, ["sha", "size"], "left").select("page_id", "url", "html", "first", (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))).alias("revisit"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, name, own = None, "", ""

        def finished() -> pa.RecordBatch:
            bundle.close()
            ids, page, frame, offset, length = zip(*bundle.entries)
            columns = [pa.array(ids), pa.array(page, pa.int64()), pa.array([name] * len(ids)), pa.array(frame, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in INDEX.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                page, address, body, first, revisit = (c[i].as_py() for c in batch.columns)
                if bundle is None:
                    own = uuid.uuid4().hex
                    name = f"{folder}/{own}.warc.zst"
                    system, path = _open(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    bundle = Bundle(system.open_output_stream(path, compression=None), level)
                mark = bundle.mark(page, revisit, own)
                bundle.add(page, write_record(page, address, body.encode(), first, revisit, date, mark), mark)
                if bundle.written >= BUNDLE_BYTES:
                    yield finished()
                    bundle = None
        if bundle is not None:
            yield finished()

    return spool(marked.mapInArrow(each, INDEX), "warc-index")


def _batch(found: list[dict]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in kinds], [k for k, _ in kinds])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records at places (bundle, frame, offset) in that order: a bundle is opened once, a frame unpacked once."""
    name, number, source, reader, plain, found = None, None, None, None, b"", []
    for batch in batches:
        for bundle, frame, offset in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if found and (bundle, frame) != (name, number):
                yield _batch(found)
                found = []
            if bundle != name:
                if source:
                    source.close()
                system, path = _open(bundle)
                source = system.open_input_file(path)
                name, number, reader = bundle, None, Reader(source)
            if frame != number:
                number, plain = frame, reader.frame(frame)
            found.append(parse_record(plain, offset)[0])
    if found:
        yield _batch(found)
    if source:
        source.close()


def read_archives(index: DataFrame) -> DataFrame:
    """The records that an index names, each by its frame and its offset there; damaged records are an error.

    The index is dealt by bundle to as many tasks as shuffles have, so that a bundle is opened by one task.
    """
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = index.select("bundle", "frame", "offset").repartition(tasks, "bundle")
    return places.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(_records, RECORD)


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose ``record_id`` is in ``wanted``: frames without any of them are not unpacked."""
    return read_archives(index.join(wanted.select("record_id").distinct(), "record_id", "left_semi"))
