"""SimHash near-dedup: pigeonring filtering of 64-bit fingerprints.

With at most 3 differing bits over a ring of 16 segments of 4 bits, some segment starts a chain whose first l segments
together differ in at most floor(3 l / 16) bits, for every l. So its first 5 segments are equal and its next 5 differ
in at most one bit, which leaves one half of those 20 bits equal. Fingerprints are therefore dealt by 32 keys (16 chain
starts, 2 halves) of 30 equal bits; the chain's later budgets prune what meets there, then the full Hamming distance
decides. Equal fingerprints are one class, so copies never make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import components, discard, local_forest, spool, tile_pairs

SEGMENTS, SEGMENT_BITS, MAX_BITS = 16, 4, 3
#: Rows of one tile of a hot key; a task compares two tiles.
TILE_ROWS = 4096

_LANES = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], dtype=np.uint8).view(np.uint64).ravel()


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: bits that over half of them set; zero for none."""
    if not len(hashes):
        return 0
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    counts = sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, A-Z lowered; fewer words make one run, none makes nothing."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = [b" ".join(words)] if len(words) < size else list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(r, 42) for r in runs), np.uint64, len(runs))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed 64-bit number; null and empty texts have zero."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(t.as_py(), size)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(each, "doc_id long, fp long")


def _rotated(fp: Column, start: int) -> Column:
    by = start * SEGMENT_BITS
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def chain_keys(fp: Column) -> Column:
    """The 32 keys of a fingerprint: chain start and half (5 bits), 20 equal bits, 10 bits of the half."""
    keys = []
    for start in range(SEGMENTS):
        turned = _rotated(fp, start)
        for half, shift in enumerate((34, 24)):
            bits = F.shiftleft(F.shiftrightunsigned(turned, 44), 10).bitwiseOR(F.shiftrightunsigned(turned, shift).bitwiseAND(F.lit(0x3FF)))
            keys.append(bits.bitwiseOR(F.lit((start * 2 + half) << 30)))
    return F.array(*keys)


def _within(difference: Column, start: Column) -> Column:
    """Whether a difference keeps to the chain's budgets from its start, then to the whole distance."""
    by = start * SEGMENT_BITS
    turned = F.when(by == 0, difference).otherwise(F.call_function("shiftleft", difference, by).bitwiseOR(F.call_function("shiftrightunsigned", difference, 64 - by)))
    prefix = lambda bits: F.bit_count(F.shiftrightunsigned(turned, 64 - bits))
    return (prefix(40) <= 1) & (prefix(60) <= 2) & (F.bit_count(difference) <= MAX_BITS)


def _tile_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, tile_a, tile_b, fps, tiles): a spanning forest of the links between or within two tiles."""
    for batch in batches:
        ends: list[np.ndarray] = [np.empty(0, np.int64)]
        roots: list[np.ndarray] = [np.empty(0, np.int64)]
        for key, a, b, fps, tiles in zip(*(batch.column(i) for i in range(5))):
            own = fps.values.to_numpy(zero_copy_only=False)
            tile = tiles.values.to_numpy(zero_copy_only=False)
            turn = np.uint64((key.as_py() >> 31) * SEGMENT_BITS)
            one, two = (own[tile == a.as_py()], own[tile == b.as_py()]) if a.as_py() != b.as_py() else (own, own)
            both = np.concatenate([one, two])
            left, right = [], []
            x, y = one.view(np.uint64), two.view(np.uint64)
            for at in range(0, len(x), 256):
                d = x[at : at + 256, None] ^ y[None, :]
                near = np.bitwise_count(d) <= MAX_BITS
                i, j = np.nonzero(near)
                d = d[i, j]
                turned = d << turn | d >> (np.uint64(64) - turn) if turn else d
                kept = (np.bitwise_count(turned >> np.uint64(24)) <= 1) & (np.bitwise_count(turned >> np.uint64(4)) <= 2)
                left.append(i[kept] + at)
                right.append(j[kept] + len(x))
            moved, root = local_forest(len(both), np.concatenate(left or [[]]).astype(int), np.concatenate(right or [[]]).astype(int))
            ends.append(both[moved])
            roots.append(both[root])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ends)), pa.array(np.concatenate(roots))], ["a", "b"])


def links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` exactly as all pairs of at most 3 differing bits do.

    ``classes`` is read twice. A key with two fingerprints is one pair, found in the aggregate itself. A key with more goes through tiles, whose
    tasks return spanning forests instead of pairs.
    """
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, 32 keys each: too few tasks by size
    dealt = classes.repartition(tasks, "fp").select("fp", F.explode(chain_keys(F.col("fp"))).alias("key"))
    met = spool(dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "simhash-keys")
    pairs = met.where("n = 2").where(_within(F.col("a").bitwiseXOR(F.col("b")), F.shiftright("key", 31).cast("int"))).select("a", "b")
    tiled = tile_pairs(dealt, met.where("n > 2").select("key", "n"), "key", F.col("fp"), TILE_ROWS)
    groups = tiled.groupBy("key", "tile_a", "tile_b").agg(F.collect_list("fp").alias("fps"), F.collect_list("tile").alias("tiles"))
    return pairs.unionByName(groups.mapInArrow(_tile_edges, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row: documents whose fingerprints differ in at most 3 bits are linked.

    component_id is the smallest doc_id reachable over links, itself included. Texts without words have fingerprint
    zero and link like any other; a null doc_id takes its group's component_id (null if the group has no other).
    Repeated rows come back as often as they came; other columns are ignored; an empty table gives an empty table.
    """
    printed = spool(fingerprints(docs, doc_id, text, size), "simhash-fingerprints")
    classes = spool(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    linked = components(links(classes), "simhash-components").withColumnRenamed("node", "fp")
    grouped = linked.join(classes, "fp")
    smallest = grouped.groupBy("root").agg(F.min("first").alias("smallest"))
    named = linked.join(smallest, "root").select("fp", "smallest")
    # Written, so that adaptive execution can split a fingerprint that a large part of all rows have.
    placed = spool(classes.join(named, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id")), "simhash-placed")
    discard(classes)
    return printed.join(placed, "fp").select("doc_id", "fp", "component_id")
