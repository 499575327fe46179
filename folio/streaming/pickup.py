"""Incremental pick-up of sources: a stream over an input folder that passes on only what has changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRINTS = "path string, sha256 string, version string"


def changed(inputs: DataFrame, known: DataFrame, version: str) -> DataFrame:
    """Inputs (path, sha256, …) whose content or converter version isn't among the known prints."""
    return inputs.withColumn("version", F.lit(version)).join(known.select("path", "sha256", "version"), ["path", "sha256", "version"], "left_anti")


def pick_up(spark: SparkSession, root: str, prints: str, checkpoint: str, convert: Callable[[DataFrame], None], version: str = "1"):
    """Start a stream over the files of ``root``: each batch's new and changed files go to ``convert``, then their prints are kept.

    A batch that is run again after a failure finds the prints it has kept and passes on only the rest.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)

    def batch(rows: DataFrame, _: int) -> None:
        session = rows.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(prints)
        there = path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).exists(path)
        known = session.read.schema(PRINTS).parquet(prints) if there else session.createDataFrame([], PRINTS)
        fresh = changed(rows.select("path", F.sha2("content", 256).alias("sha256"), "content"), known, version)
        convert(fresh)
        fresh.select("path", "sha256", "version").write.mode("append").parquet(prints)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_by_window(events: DataFrame, at: str, stage: str, cost: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, stage, cost, calls) per window of a stream or table of usage records; late records within ``late`` count."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    sums = rows.groupBy(F.window(at, width).alias("w"), stage).agg(F.sum(cost).alias("cost"), F.count("*").alias("calls"))
    return sums.select(F.col("w.start").alias("start"), stage, "cost", "calls")
