"""A written index of character trigrams, searched in place of the texts.

Postings are blocks: a gram with the rows that hold it, their sizes and the gram's places in them, packed into bytes. The table is
partitioned by a hash of the gram and sorted by gram inside each file, so a search reads the few row groups of its own
grams. Phrases are matched on places: the grams that cover a phrase are intersected, the rarest first, and what is left
are the phrase's occurrences, exactly, so neither matching nor scoring opens a text. A gram that no row holds ends its
phrase before any postings are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.retrieval import K1, B, like, phrases

#: Partitions by gram; signs of text whose postings one task writes: partitions with more are sliced by rows.
PARTS, TASK_SIGNS = 64, 20_000_000
#: Characters whose grams a task gathers into one set of blocks.
BLOCK_SIGNS = 2_000_000
#: Places up to which the rarest gram's postings are broadcast to those of the next.
BROADCAST_PLACES = 1_000_000
_POSTINGS, _ENTRIES = "gram long, docs long, n long, packed binary", "row_id long, size int, places array<int>"


@dataclass(frozen=True)
class GramIndex:
    """An index on disk: its folder, the rows it was made of, their mean size in grams, the number of partitions."""

    spark: SparkSession
    folder: str
    rows: int
    mean: float
    parts: int

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"{_POSTINGS}, part int").parquet(f"{self.folder}/postings")

    @property
    def short(self) -> DataFrame:
        """Rows with a text of fewer than three characters, which have no gram."""
        return self.spark.read.schema("row_id long").parquet(f"{self.folder}/short")


def gram_key(gram: str) -> int:
    """Three code points in one number."""
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def gram_text(key: Column) -> Column:
    """The three characters of a key."""
    sign = lambda by: F.lpad(F.hex(F.shiftright(key, by).bitwiseAND(F.lit((1 << 21) - 1))), 8, "0")
    return F.decode(F.unhex(F.concat(sign(42), sign(21), sign(0))), "UTF-32")


def _part(key, parts: int):
    """The partition of a gram; for numbers and Columns."""
    return key % 1_000_003 % parts


def _shrunk(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes, seven bits each, the last byte of each below 128; and how many bytes each takes."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        size += values >= np.uint64(1 << bits)
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for i in range(size.max() if len(size) else 0):
        has = np.flatnonzero(size > i)
        part = (values[has] >> np.uint64(7 * i) & np.uint64(127)).astype(np.uint8)
        out[ends[has] - size[has] + i] = part | np.where(size[has] > i + 1, 128, 0).astype(np.uint8)
    return out, size


def _grown(data: np.ndarray) -> np.ndarray:
    """The numbers of ``_shrunk``."""
    ends = np.flatnonzero(data < 128)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts) if len(data) else np.empty(0, np.uint64)


def _steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the value before, the first of each group to 0."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    steps[starts] = values[starts]
    return steps


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks (docs, n, packed): one row for each row of the table that holds the block's gram."""
    for batch in batches:
        for docs, n, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
            values = _grown(np.frombuffer(packed, np.uint8))
            turned = values[:docs]
            rows = np.cumsum((turned >> np.uint64(1)).astype(np.int64) ^ -(turned & np.uint64(1)).astype(np.int64))
            counts, steps = values[2 * docs : 3 * docs].astype(np.int64), values[3 * docs :].astype(np.int64)
            ends = np.cumsum(counts)
            total, before = np.cumsum(steps), ends - counts
            places = total - np.repeat(total[before] - steps[before], counts)
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(places.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(values[docs : 2 * docs].astype(np.int32)), listed], ["row_id", "size", "places"])


def entries(blocks: DataFrame) -> DataFrame:
    """(row_id, size, places) of blocks of postings."""
    return blocks.select("docs", "n", "packed").mapInArrow(_entries, _ENTRIES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (row_id, size, text, heading), lower-cased: one row for each gram of a set of texts."""
    rows, sizes, keys, places, owner, signs = [], [], [], [], [], 0

    def told() -> pa.RecordBatch:
        key, place, own = np.concatenate(keys), np.concatenate(places), np.concatenate(owner)
        order = np.argsort(key, kind="stable")
        key, place, own = key[order], place[order], own[order]
        entry = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        gram = np.flatnonzero(np.r_[True, key[entry][1:] != key[entry][:-1]])
        of, n = own[entry], len(key)
        docs, counts = np.diff(np.r_[gram, len(entry)]), np.diff(np.r_[entry, n])
        found = np.add.reduceat(counts, gram)
        # A gram's numbers: steps of its rows' ids, signs turned into the lowest bit, their sizes, their counts, steps of places.
        base = 3 * gram + entry[gram]
        at = np.repeat(base - gram, docs) + np.arange(len(entry))
        numbers, wide = np.empty(3 * len(entry) + n, np.uint64), np.repeat(docs, docs)
        step = _steps(np.array(rows, np.int64)[of], gram)
        numbers[at] = (step << 1 ^ step >> 63).astype(np.uint64)
        numbers[at + wide], numbers[at + 2 * wide] = np.array(sizes, np.uint64)[of], counts.astype(np.uint64)
        numbers[np.repeat(base + 3 * docs - entry[gram], found) + np.arange(n)] = _steps(place, entry).astype(np.uint64)
        data, widths = _shrunk(numbers)
        cuts = np.r_[0, np.add.reduceat(widths, base).cumsum()].astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(gram), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(key[entry][gram]), pa.array(docs.astype(np.int64)), pa.array(found.astype(np.int64)), packed], ["gram", "docs", "n", "packed"])

    for batch in batches:
        for row_id, size, *texts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            start = 0
            for text in texts:
                points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.int64)
                if len(points) >= 3:
                    keys.append(points[:-2] << 42 | points[1:-1] << 21 | points[2:])
                    places.append(np.arange(start, start + len(points) - 2, dtype=np.int32))
                    owner.append(np.full(len(points) - 2, len(rows), np.int32))
                    signs += len(points)
                start += len(points) + 1  # no phrase reaches from a text into the heading
            rows.append(row_id)
            sizes.append(size)
            if signs >= BLOCK_SIGNS:
                yield told()
                rows, sizes, keys, places, owner, signs = [], [], [], [], [], 0
    if keys:
        yield told()


def build(chunks: DataFrame, to: str, row_id: str = "row_id", text: str = "text", heading: str | None = None, parts: int = PARTS, slices: int | None = None) -> GramIndex:
    """Write the index of ``chunks`` below ``to``. The row with counts comes last: without it there is no index.

    A partition is written by as many tasks as its texts ask for (``slices`` sets their number), so that a task sorts
    what fits its memory, whatever the table. Numbers are packed before they are shuffled.
    """
    spark = chunks.sparkSession
    low = lambda c: F.lower(c.cast("string")) if c is not None else F.lit("")
    grams = lambda c: F.greatest(F.coalesce(F.length(c), F.lit(0)) - 2, F.lit(0))
    size = grams(F.col(text)) + (grams(F.col(heading)) if heading else F.lit(0))
    read = chunks.select(F.col(row_id).cast("long").alias("row_id"), size.cast("int").alias("size"), low(F.col(text)).alias("text"), low(F.col(heading) if heading else None).alias("heading"))
    counts = read.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    slices = slices or -(-counts["size"] // (parts * TASK_SIGNS)) or 1
    blocks = read.mapInArrow(_blocks, _POSTINGS).withColumn("part", _part(F.col("gram"), parts).cast("int"))
    dealt = blocks.repartition(parts * slices, "part", F.pmod(F.xxhash64("packed"), F.lit(slices)))
    dealt.sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{to}/postings")
    read.where(F.coalesce(F.length("text"), F.lit(0)) < 3).select("row_id").write.mode("overwrite").parquet(f"{to}/short")
    spark.createDataFrame([(counts.n, counts["size"], parts)], "n long, size long, parts int").coalesce(1).write.mode("overwrite").parquet(f"{to}/counts")
    return opened(spark, to)


def opened(spark: SparkSession, folder: str) -> GramIndex:
    counts = spark.read.parquet(f"{folder}/counts").first()
    return GramIndex(spark, folder, counts.n, counts["size"] / counts.n if counts.n else 0.0, counts.parts)


def dictionary(index: GramIndex) -> DataFrame:
    """(gram, docs, places) of every gram; reads counts, no entries."""
    return index.postings.groupBy("gram").agg(F.sum("docs").alias("docs"), F.sum("n").alias("places"))


def _of(index: GramIndex, keys: list[int]) -> DataFrame:
    """The blocks of some grams: both filters reach the scan, one as folders, one as statistics of row groups."""
    return index.postings.where(F.col("part").isin(sorted({_part(k, index.parts) for k in keys})) & F.col("gram").isin(keys))


def frequencies(index: GramIndex, keys: list[int]) -> dict[int, tuple[int, int]]:
    """(rows, places) of each of these grams that occurs."""
    counted = _of(index, keys).groupBy("gram").agg(F.sum("docs").alias("docs"), F.sum("n").alias("places"))
    return {r.gram: (r.docs, r.places) for r in counted.collect()}


def cover(phrase: str) -> list[tuple[int, int]]:
    """(place, key) of the fewest grams that touch every character of a phrase of three or more."""
    starts = [*range(0, len(phrase) - 2, 3)]
    if starts[-1] != len(phrase) - 3:
        starts.append(len(phrase) - 3)
    return [(i, gram_key(phrase[i : i + 3])) for i in starts]


def occurrences(index: GramIndex, phrase: str, known: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """(row_id, size, tf) of the rows that hold a lower-cased phrase; overlapping places count.

    ``known``: frequencies of its grams, where they have been asked for.
    """
    wanted = cover(phrase)
    known = frequencies(index, [k for _, k in wanted]) if known is None else known
    if any(k not in known for _, k in wanted):
        return index.spark.createDataFrame([], "row_id long, size int, tf int")
    rows = None
    for at, key in sorted(wanted, key=lambda w: (known[w[1]], w)):
        part = entries(_of(index, [key]))
        begins = part.select("row_id", "size", F.filter(F.transform("places", lambda p: p - at), lambda p: p >= 0).alias("begins"))
        if rows is None:
            rows, most = begins, known[key][1]
            continue
        left = F.broadcast(rows) if most <= BROADCAST_PLACES else rows
        both = left.join(begins.select("row_id", F.col("begins").alias("more")), "row_id")
        rows = both.select("row_id", "size", F.array_intersect("begins", "more").alias("begins")).where(F.size("begins") > 0)
    return rows.select("row_id", "size", F.size("begins").alias("tf"))


def bm25(index: GramIndex, query: str) -> DataFrame:
    """(row_id, score) of the rows with any phrase of a query, the same as a scan of all texts gives."""
    hits, known = None, frequencies(index, sorted({k for p in phrases(query) for _, k in cover(p)}))
    for i, phrase in enumerate(phrases(query)):
        part = occurrences(index, phrase, known).withColumn("phrase", F.lit(i))
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return index.spark.createDataFrame([], "row_id long, score double")
    df = F.broadcast(hits.groupBy("phrase").agg(F.count("*").alias("df")))  # a row for each phrase of the query
    idf = F.log((F.lit(index.rows) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(index.mean or 1.0)))
    scored = hits.join(df, "phrase").select("row_id", "phrase", (F.when(idf > 0, idf).otherwise(1e-6) * weight).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("phrase", "part")))
    return scored.groupBy("row_id").agg(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["part"]).alias("score"))


def holding(index: GramIndex, chunks: DataFrame, query: str, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """(row_id, score 0) of the chunks that hold a query of any length, letters A-Z without case.

    Candidates come from the index: rows with every gram of the query or, if it is shorter than a gram, with any gram
    that holds it and rows too short for grams. Their texts alone are read. Where that is most of the table, or letters
    beyond A-Z make case matter, all texts are.
    """
    low = query.lower()
    if not low or not all(c.isascii() or c.lower() == c.upper() for c in query):
        return like(chunks, query, row_id, text)
    if len(low) >= 3:
        found = occurrences(index, low).select("row_id")
    else:
        keys = dictionary(index).where(F.contains(gram_text(F.col("gram")), F.lit(low)))
        if (keys.agg(F.sum("docs")).first()[0] or 0) > index.rows:
            return like(chunks, query, row_id, text)
        found = entries(index.postings.join(keys.select("gram"), "gram", "left_semi")).select("row_id").distinct().unionByName(index.short)
    return like(chunks.join(found.withColumnRenamed("row_id", row_id), row_id, "left_semi"), query, row_id, text)

