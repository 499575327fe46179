"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, all of them.

Set similarity join by prefix filtering (Chaudhuri et al., 2006) with the positional filter of PPJoin. Two sets that
are similar enough share a shingle among the first n - ceil(0.8 n) + 1 of each in any common order; the place of the
first one they share bounds how much they can have in common. The order puts shingles of many documents last, by a
sketch of document frequencies; a poor sketch costs time, never a pair. Fingerprints of 64 bits can't do this: at 0.8
some 10 bits differ, and no key of equal bits is left that tells documents apart.

Each key's documents are first compared with the key's least one; what that links is one component. Only pairs of
different components are then compared with each other, in tiles. Every candidate is decided on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import components, discard, spool, tile_pairs
from folio.llm.simhash import shingle_hashes

#: Similar are two sets if PART * all >= OF * common, in whole numbers: 0.8 is 4 of 5.
PART, OF = 4, 5
SIZE = 5
TILE_ROWS = 4096
#: The sketch: buckets of shingle hashes, and the documents of one partition from which a bucket is reported.
SKETCH_BITS, REPORTED = 22, 4


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def enough(common, one, two):
    """Whether ``common`` shingles make sets of ``one`` and ``two`` similar; for numbers, arrays and Columns."""
    return common * (PART + OF) >= (one + two) * PART


def _buckets(found: np.ndarray, bits: int) -> np.ndarray:
    return (found >> np.uint64(64 - bits)).astype(np.int64)


def sketch(docs: DataFrame, text: str, size: int) -> bytes:
    """For each bucket the order of magnitude of its documents, in bytes; zero for rare ones."""
    bits = SKETCH_BITS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(counts, _buckets(shingle_set(t.as_py(), size), bits), 1)
        told = np.flatnonzero(counts >= REPORTED)
        yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(counts[told])], ["bucket", "n"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(each, "bucket long, n long")
    table = found.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= 2 * REPORTED).toArrow()
    levels = np.zeros(1 << bits, np.uint8)
    levels[table.column("bucket").to_numpy()] = np.log2(np.maximum(table.column("n").to_numpy(), 1)).astype(np.uint8)
    return levels.tobytes()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_key"), t.alias("text"))


def _named(found: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have one name."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def prefixes(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, text_key, fp, size, keys): name, size and prefix of each text's shingle set."""
    levels, bits = docs.sparkSession.sparkContext.broadcast(sketch(docs, text, size)), SKETCH_BITS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, sizes, keys = [], [], []
                for t in part.column(2):
                    found = shingle_set(t.as_py(), size)
                    n = len(found)
                    names.append(_named(found))
                    sizes.append(n)
                    order = np.argsort(level[_buckets(found, bits)], kind="stable")[: n + 1 - -(-n * PART // OF) if n else 0]
                    keys.append(found[order].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "fp", "size", "keys"])

    return _keyed(docs, doc_id, text).mapInArrow(each, "doc_id long, text_key long, fp long, size long, keys array<long>")


def _possible(size: Column, pos: Column, other: Column, at: Column) -> Column:
    """Whether two sets whose first common shingle stands at these places of theirs can be similar."""
    return enough(F.least(size - pos, other - at), size, other)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for one, two in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
            kept.append(bool(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """Those of the pairs (a, b) of set names whose whole sets are similar; spooled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), size) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_named(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["fp", "found"])

    needed = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    texts = classes.join(needed, "fp").select("text_key").distinct()
    sets = _keyed(docs, doc_id, text).join(texts, "text_key", "left_semi").select("text").mapInArrow(each, "fp long, found binary")
    sets = spool(sets.groupBy("fp").agg(F.first("found").alias("found")), "near-sets")
    both = pairs.join(sets.select(F.col("fp").alias("b"), F.col("found").alias("two")), "b").join(sets.select(F.col("fp").alias("a"), F.col("found").alias("one")), "a")
    kept = spool(both.select("a", "b", "one", "two").mapInArrow(_similar, "a long, b long"), "near-similar")
    discard(sets)
    return kept


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (tile_a, tile_b, members): pairs of members of different components that can be similar."""
    for batch in batches:
        for a, b, members in zip(*(batch.column(i) for i in range(3))):
            tile, fp, root, size, pos = (members.values.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            one, two = np.flatnonzero(tile == a.as_py()), np.flatnonzero(tile == b.as_py())
            for at in range(0, len(one), 64):
                i = one[at : at + 64, None]
                most = np.minimum(size[i] - pos[i], size[two] - pos[two])
                x, y = np.nonzero(enough(most, size[i], size[two]) & (root[i] != root[two]))
                left, right = fp[i[x, 0]], fp[two[y]]
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])


def links(classes: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """Edges (a, b) that connect the set names exactly as all similar pairs do. ``classes``: (fp, text_key, size, keys)."""
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, many keys each: too few tasks by size
    dealt = classes.repartition(tasks, "fp").select("fp", "size", F.posexplode("keys").alias("pos", "key"))
    least = F.min(F.struct("fp", "size", "pos"))
    met = spool(dealt.groupBy("key").agg(F.count("*").alias("n"), least.alias("least")).where("n > 1"), "near-keys")
    shared = spool(dealt.join(met, "key"), "near-shared")  # what other sets have too: the only part that goes on
    discard(met)
    star = shared.where("fp <> least.fp").where(_possible(F.col("size"), F.col("pos"), F.col("least.size"), F.col("least.pos")))
    star = spool(star.select(F.col("least.fp").alias("a"), F.col("fp").alias("b")).distinct(), "near-star")
    first = similar(star, classes, docs, doc_id, text, size)
    roots = components(first, "near-first").withColumnRenamed("node", "fp")
    rest = shared.where("n > 2").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rest = spool(rest.select("key", "fp", "root", "size", "pos"), "near-rest")
    discard(shared)
    split = rest.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "n")
    tiled = tile_pairs(rest, split, "key", F.col("fp"), TILE_ROWS)
    groups = tiled.groupBy("key", "tile_a", "tile_b").agg(F.collect_list(F.struct("tile", "fp", "root", "size", F.col("pos").cast("long").alias("pos"))).alias("members"))
    crossing = groups.select("tile_a", "tile_b", "members").mapInArrow(_crossing, "a long, b long").distinct().join(star, ["a", "b"], "left_anti")
    second = similar(spool(crossing, "near-crossing"), classes, docs, doc_id, text, size)
    discard(rest)
    return first.unionByName(second)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, component_id) per row: documents that are similar are linked, at any length.

    component_id is the smallest doc_id reachable over links, itself included. Shingles are runs of ``size`` words, A-Z
    lowered; a text of fewer words is one shingle, and texts without words are alike. A null doc_id takes its group's
    component_id (null if the group has no other).
    """
    printed = spool(prefixes(docs, doc_id, text, size), "near-prefixes")
    least = printed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    classes = spool(least, "near-classes")
    with_keys, printed = printed, spool(printed.select("doc_id", "fp"), "near-printed")
    discard(with_keys)
    linked = components(links(classes, docs, doc_id, text, size), "near-components").withColumnRenamed("node", "fp")
    grouped = linked.join(classes.select("fp", "first"), "fp")
    smallest = grouped.groupBy("root").agg(F.min("first").alias("smallest"))
    named = linked.join(smallest, "root").select("fp", "smallest")
    # Written, so that adaptive execution can split a set that a large part of all rows have.
    placed = spool(classes.select("fp", "first").join(named, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id")), "near-placed")
    return printed.join(placed, "fp").select("doc_id", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest doc_id, a null one last.

    Groups are groups of texts: rows without a doc_id stay as long as their texts are no copies, and so do rows of one
    doc_id with different texts. Of repeated rows one stays. Columns stay as they were. ``also``: another grouping, a
    function from rows (doc_id, text) to (doc_id, component_id), whose links count as well.
    """
    keyed = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("folio_key"), F.col(text).cast("string").alias("text"))
    texts = keyed.select(F.col("folio_key").alias("doc_id"), "text")
    marks = near_copies(texts, size=size)
    if also is not None:
        marks = marks.unionByName(also(texts).select("doc_id", "component_id"))
    edges = spool(marks.where("doc_id <> component_id").distinct().toDF("a", "b"), "near-marks")
    roots = components(edges, "near-groups").select(F.col("node").alias("folio_key"), "root")
    discard(edges)
    # What rows there are, and how often; both sides of the join are small, however many rows a text has.
    kinds = keyed.groupBy("id", "folio_key").agg(F.count("*").alias("n"))
    placed = kinds.join(roots, "folio_key", "left").withColumn("root", F.coalesce("root", "folio_key"))
    first = F.struct(F.col("id").isNull(), "id", "folio_key")
    kept = placed.groupBy("root").agg(F.min_by(F.struct("id", "folio_key", "n"), first).alias("k"))
    kept = spool(kept.select(F.col("k.id").alias("folio_id"), F.col("k.folio_key").alias("folio_key"), F.col("k.n").alias("folio_n")), "near-kept")
    rows = docs.withColumn("folio_key", F.xxhash64(F.col(text).cast("string"))).join(kept, "folio_key").where(F.col(doc_id).cast("long").eqNullSafe(F.col("folio_id")))
    once = rows.where("folio_n = 1")
    return once.unionByName(rows.where("folio_n > 1").dropDuplicates(["folio_key"])).select(docs.columns)
