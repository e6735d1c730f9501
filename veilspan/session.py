"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "veilspan", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording a call site costs round trips to the JVM for every column operation;
        # the expressions here have hundreds.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Partitioned writes here have two directories: keep both open, skip the sort.
        .config("spark.sql.maxConcurrentOutputFileWriters", "4")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    Only a session without that setting (a local test) gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str, *partition_by: str, folders: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared work folder and read it back; ``folders`` is told the place, for its removal.

    For results that are used several times: costly steps above it run once, and a
    lost executor re-reads the files instead of repeating them.
    """
    folder = work_folder(df.sparkSession, purpose)
    if folders is not None:
        folders.append(folder)
    df.write.partitionBy(*partition_by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@cache
def _local_folder(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="veilspan-")


def remove_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete work folders; their data frames cannot be read any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to as many partitions as the session sets in ``veilspan.input.partitions``; unset, as it was read.

    For small tables in a single scan split, which only the caller can know of. Data at scale has a split per core and
    texts should stay where they are read.
    """
    partitions = df.sparkSession.conf.get("veilspan.input.partitions", None)
    return df.repartition(int(partitions), key) if partitions else df


def dealt_rows(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows of which long texts are made, dealt to four tasks a core.

    A table of millions of such rows can be one scan split, and one task would then match all the texts; the rows are short, so
    dealing them costs little. ``veilspan.input.partitions`` sets another number.
    """
    wide = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(int(df.sparkSession.conf.get("veilspan.input.partitions", None) or wide), key)
