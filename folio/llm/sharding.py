"""Sharding by sampled splitters: all records into a fixed number of shards of nearly equal bytes.

A record's key is the hash of its text, then of its id, then a row number, so equal texts, a group, lie side by side and
no key is held twice. A sample weighted by size (and, to a like part, by rows) gives quantile boundaries that cut the
keys into ``shards * RANGES`` ranges; a heavy record gets a range of its own. The bytes and rows of the ranges are then
counted; overfull ranges are sampled anew, from their own records only, and subdivided until none can be. Whole ranges
go to shards, the largest first to the emptiest shard, so the law held is ``bytes``: sizes are as near equal as the
records allow. Groups of under a ``GROUP``-th of a shard stay in one shard, larger ones are divided like any range. Slots
are numbered range by range, so no task holds a shard.

The driver sees the sample (at most some ``4 * ranges * DRAWN`` keys a round), and one row for each range: both are set
by the number of shards, not by the table. The result depends on the rows alone, except among rows of equal id and text.

Defined results: a null text has no bytes and the checksum 0, a null id is an id like any other; repeated rows are placed
one by one; a table without rows gives none, one with fewer rows than shards leaves shards empty. Further columns are
ignored, or carried along by ``carry`` under their own names unless these are taken.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import spool

SHARDS = 24
#: Ranges for each shard, keys drawn for each range, part of a shard above which a group is divided.
RANGES, DRAWN, GROUP = 64, 16, 4
#: A range is overfull beyond so many times its even part.
OVERFULL = 2.0
#: Every record adds so many bytes to its shard.
RECORD_BYTES = 8
#: Behind all keys that begin like this one.
AFTER = "~"


@dataclass(frozen=True)
class Placement:
    """What the driver knows: the first key of each range, its shard, and its first slot there."""

    starts: list[str]
    shards: list[int]
    slots: list[int]


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, text_hash, id_hash, row, carried), written: the row number must not change later."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = {"doc_id": F.col(doc_id), "size": F.octet_length(t).cast("long") + RECORD_BYTES, "text_crc32": F.crc32(t.cast("binary")), "text_hash": F.xxhash64(t), "id_hash": F.xxhash64(F.col(doc_id).cast("string")), "row": F.monotonically_increasing_id()}
    if carry:
        own["carried"] = F.struct(*[F.col(f"`{c}`") for c in carry])
    return spool(docs.select(*[c.alias(name) for name, c in own.items()]), "shard-rows")


def _hex(c: Column) -> Column:
    return F.lpad(F.hex(c), 16, "0")


def _key() -> Column:
    return F.concat(_hex(F.col("text_hash")), _hex(F.col("id_hash")), _hex(F.col("row")))


def _range(starts: list[str]) -> Column:
    """The number of the range that the column key lies in, by halving; ``starts`` begins with ''."""
    known = F.lit(starts) if len(starts) > 1 else F.array(F.lit(""))
    steps = [1 << b for b in reversed(range(len(starts).bit_length()))]
    key = F.col("key")
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(1), lambda at, s: F.when((at + s <= len(starts)) & (F.get(known, at + s - 1) <= key), at + s).otherwise(at))
    return found - 1


def _ranged(rows: DataFrame, starts: list[str]) -> DataFrame:
    return rows.withColumn("key", _key()).withColumn("range", _range(starts))


def _measured(rows: DataFrame, starts: list[str]) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each range; a row for each range comes to the driver."""
    return {r["range"]: (r["bytes"], r["n"]) for r in _ranged(rows, starts).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}


def _drawn(rows: DataFrame, weight: Column, times: float, round_: int) -> list[tuple[str, float, float]]:
    """(key, weight, weight it stands for) of records drawn with probability weight * times, by a hash of the key."""
    chance = F.least(F.lit(1.0), F.col("weight") * times)
    place = F.pmod(F.xxhash64("text_hash", "id_hash", "row", F.lit(round_)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    taken = rows.withColumn("key", _key()).withColumn("weight", weight).where(place < chance).select("key", "weight", (F.col("weight") / chance).alias("stands"))
    return sorted(tuple(r) for r in taken.collect())


def _cuts(drawn: list[tuple[str, float, float]], each: float) -> set[str]:
    """First keys of ranges of some weight ``each``, out of a sorted sample.

    A group that stands for less than an overfull range is one unit, else each of its records is one and the group is
    cut off from its neighbours; so is a unit of half a range or more.
    """
    whole: dict[str, float] = {}
    for key, _, stands in drawn:
        whole[key[:16]] = whole.get(key[:16], 0.0) + stands
    units: dict[str, tuple[float, float]] = {}
    for key, weight, stands in drawn:
        unit = key[:16] if whole[key[:16]] < OVERFULL * each else key
        so_far, most = units.get(unit, (0.0, 0.0))
        units[unit] = so_far + stands, max(most, weight)
    found = {cut for text, stands in whole.items() if stands >= OVERFULL * each for cut in (text, text + AFTER)}
    held = 0.0
    for unit, (stands, most) in units.items():
        heavy = max(most, stands if len(unit) == 16 else 0.0) >= each / 2
        if heavy or held + stands > each:
            found.add(unit)
            held = 0.0
        if heavy:
            found.add(unit + AFTER)
        else:
            held += stands
    return found


def _bundles(starts: list[str], sizes: dict[int, tuple[int, int]], group: float) -> list[list[int]]:
    """Ranges that go to one shard together: the ranges of one group of less than ``group`` bytes; else each alone."""
    out: list[list[int]] = []
    for i, start in enumerate(starts):
        inside = len(start) > 16 and out and starts[out[-1][0]][:16] == start[:16] and not start.startswith(start[:16] + AFTER)
        if inside and sum(sizes.get(r, (0, 0))[0] for r in [*out[-1], i]) < group:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def place(rows: DataFrame, shards: int = SHARDS) -> Placement:
    """Splitters, their subdivision, and the shard and first slot of every range."""
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    if not total["n"]:
        return Placement([""], [0], [0])
    ranges = shards * RANGES
    weight = (F.col("size") / F.lit(float(total["bytes"])) + F.lit(1.0 / total["n"])) / 2
    each = 1.0 / ranges
    starts = sorted({""} | _cuts(_drawn(rows, weight, ranges * DRAWN, 0), each))
    sizes = _measured(rows, starts)

    def load(r: int) -> float:
        return (sizes[r][0] / total["bytes"] + sizes[r][1] / total["n"]) / 2

    round_, fixed = 0, set()  # fixed: first keys of overfull ranges that have one record or one group only
    while over := [r for r in sizes if sizes[r][1] > 1 and load(r) > OVERFULL * each and starts[r] not in fixed]:
        round_ += 1
        again = _ranged(rows, starts).where(F.col("range").isin(over))
        new = _cuts(_drawn(again, weight, 4 * ranges * DRAWN, round_), each) - set(starts)
        fixed |= {starts[r] for r in over if not any(starts[r] < c and (r + 1 == len(starts) or c < starts[r + 1]) for c in new)}
        starts = sorted({*starts, *new})
        sizes = _measured(rows, starts)
    bundles = _bundles(starts, sizes, total["bytes"] / shards / GROUP)
    weighed = sorted(((sum(sizes.get(r, (0, 0))[0] for r in b), b) for b in bundles), key=lambda x: (-x[0], x[1]))
    emptiest = [(0, s) for s in range(shards)]
    shard_of, slots, filled = [0] * len(starts), [0] * len(starts), [0] * shards
    for size, bundle in weighed:
        bytes_, s = heapq.heappop(emptiest)
        for r in bundle:
            shard_of[r], slots[r] = s, filled[s]
            filled[s] += sizes.get(r, (0, 0))[1]
        heapq.heappush(emptiest, (bytes_ + size, s))
    return Placement(starts, shard_of, slots)


def placed(rows: DataFrame, found: Placement) -> DataFrame:
    """``rows`` with shard and slot; slots are gapless in every shard."""
    ranged = _ranged(rows, found.starts).drop("key").withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy("text_hash", "id_hash", "row")) - 1)
    shards, slots = (F.array(*[F.lit(x) for x in y]) if len(y) < 2 else F.lit(y) for y in (found.shards, found.slots))
    numbered = ranged.withColumn("shard", F.get(shards, F.col("range")).cast("int")).withColumn("slot", F.get(slots, F.col("range")).cast("long") + F.col("at"))
    return numbered.drop("at", "range", "text_hash", "id_hash", "row")


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) and the columns ``carry`` for every row of ``docs``."""
    rows = keyed(docs, doc_id, text, carry)
    out = placed(rows, place(rows, shards)).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    own = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return out.select(*own, *[F.col(f"carried.`{c}`") for c in carry or [] if c not in own])


def write_shards(docs: DataFrame, to: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with shard and slot as Parquet in folders shard=0, shard=1, ..., by slot inside each file.

    Columns of ``docs`` stay, except those named like what this adds: size, text_crc32, law, shard, slot, grown_shard.
    """
    made = shard(docs, shards, doc_id, text, docs.columns)
    made.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(to)
    return docs.sparkSession.read.parquet(to)
