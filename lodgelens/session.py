"""Session settings the plans count on, and the checkpoint folder."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution picks join strategies from measured sizes, merges small partitions and splits
# oversized ones.  ``forceOptimizeSkewedJoin`` lets it split a hot key even where that costs one more
# exchange of the (small) result after the join.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # A task that writes a table in a few parts keeps a file open for each and need not sort its rows first.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}
# Settings that only a new session takes.  Call-site capture costs several JVM round trips per column function
# while a plan is built.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, shuffled_bytes: int, partition_bytes: int = 128 << 20) -> int:
    """Let shuffles start with enough partitions for ``shuffled_bytes``; adaptive execution merges what is small.

    The default of 200 is far too low for terabytes: one partition has to fit into a task's memory or it spills.
    """
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shuffled_bytes // partition_bytes))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
    return partitions


def input_bytes(frames: Iterable[DataFrame]) -> int:
    """Size of the files that the DataFrames read, each counted once; 0 for rows that come from no file."""
    readers = {file: frame.sparkSession for frame in frames for file in frame.inputFiles()}

    def size(file: str, spark: SparkSession) -> int:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()

    return sum(size(file, spark) for file, spark in readers.items())


@contextlib.contextmanager
def small_tasks(spark: SparkSession, shuffled_bytes: int, task_bytes: int) -> Iterator[None]:
    """While jobs run in this block, a task reads at most about ``task_bytes`` of a file or a shuffle, however large these are.

    For aggregates with nearly as many groups as rows, whose hash tables take many times the compressed bytes read.
    Smaller sizes that the session sets stay (Spark's own are 128 and 64 MB).
    """
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {key: spark.conf.get(key, None) for key in (*sizes, "spark.sql.adaptive.coalescePartitions.initialPartitionNum")}
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    try:
        for key in sizes:
            spark.conf.set(key, str(min(task_bytes, as_bytes(before[key])) if before[key] else task_bytes))
        size_shuffles(spark, shuffled_bytes, task_bytes)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodgelens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    for key, value in {**SETTINGS, **STATIC_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lodgelens-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the session runs in one process (tests) is a temporary folder used; on a cluster
    a machine-local folder would lose data, so an unset folder is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return _local_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and read it from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


ROW_GROUP = 64 << 20  # bytes that a task holds back before it writes them


class StoredTables:
    """Intermediate tables as Parquet in the shared folder, so that a lost executor costs no recomputation.

    ``put`` writes and rereads a table; ``drop`` deletes one that nothing reads any more.  What a returned DataFrame
    still reads stays until the folder is cleared after the application.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
        """``by`` names columns that get a folder per value, ``label/column=value``, which can be dropped by itself."""
        # several files are open at a time where there are folders by value, so each buffers less
        writer = df.write.option("parquet.block.size", ROW_GROUP // 4 if by else ROW_GROUP)
        writer.partitionBy(*by).parquet(f"{self.folder}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{label}")

    def read_by(self, df: DataFrame) -> bool:
        """Whether ``df`` still reads one of these tables."""
        name = self.folder.rsplit("/", 1)[-1]
        return any(f"/{name}/" in file for file in df.inputFiles())

    def clear(self) -> None:
        """Delete all of these tables."""
        self.drop("")

    def drop(self, *labels: str) -> None:
        for label in labels:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{label}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
