"""What the operators share: the shared folder, spooled tables, connected components, tiles of hot groups."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; an error off a local master where ``spark.checkpoint.dir`` is unset."""
    return shared_folder(spark)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folio/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends, no executor holds the only copy."""
    to = new_folder(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def discard(df: DataFrame) -> None:
    """Delete a spooled table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for name in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        with contextlib.suppress(Exception):
            path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, root) per node, root the smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges form stars. A node's minimum is
    pre-aggregated before the shuffle; the join that hands it back is one that adaptive execution can split. Each
    round is written to the shared folder, so lost executors cost one round.
    """
    now = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = spool(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = spool(moved.select("e.a", "e.b").where("a <> b").distinct(), name)
        discard(large)
        discard(now)
        now = new
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def tile_pairs(rows: DataFrame, sizes: DataFrame, key: str, member: Column, tile_rows: int) -> DataFrame:
    """Deal the members of each key to pairs of tiles, so that no task gets an unbounded group.

    ``sizes``: (key, n). A key of n rows has ceil(n / tile_rows) tiles; every member goes to one tile by the hash of
    ``member`` and meets each tile, itself included, in exactly one pair (tile_a <= tile_b). Adds tile, tile_a, tile_b.
    """
    k = F.ceil(F.col("n") / F.lit(tile_rows)).cast("int")
    dealt = rows.join(sizes.select(key, k.alias("tiles")), key).withColumn("tile", F.pmod(F.xxhash64(member), F.col("tiles")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return met.select("*", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b")).drop("other", "tiles")


def local_forest(n: int, left, right):
    """Edges (i, smallest index of its part) of the parts that the pairs left[i] - right[i] make of 0 .. n - 1."""
    import numpy as np

    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def join_small(rows: DataFrame, side: DataFrame, on: list[str], most: int = 100_000, how: str = "inner") -> DataFrame:
    """``rows`` joined with a written ``side``, broadcast if it has ``most`` rows at most, else by a shuffle."""
    return rows.join(F.broadcast(side) if side.limit(most + 1).count() <= most else side, on, how)
