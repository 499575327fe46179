"""Session settings that the library expects; everything else stays with the cluster."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "folio") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return re.sub("^file:/(?!/)", "file:///", given.get().rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='folio-shared-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def version_of(spark: SparkSession, path: str) -> str:
    """A name for what lies under a path now: of its files' paths, sizes and times, as the file system lists them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while files.hasNext():
        file = files.next()
        found.append(f"{file.getPath()}|{file.getLen()}|{file.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def large(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: texts made from a small file are not small, though Spark judges them by it, and no driver may hold them."""
    return rows.hint("merge")


def written(rows: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again: work that several consumers need is done once, and survives lost executors."""
    to = f"{shared_folder(rows.sparkSession)}/folio/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(to)
    return rows.sparkSession.read.schema(rows.schema).parquet(to)
