"""Shared working folder, lineage cuts and small helpers of the operators in this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a Java/RE2 character class body.
SPACE = r"\x20\x09-\x0D"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch between the JVM and a Python worker, each of which holds several at a time.
BATCH_BYTES, BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session (tests) leaves it unset a folder of the driver is made and set; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="brindle-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by BATCH_BYTES where it has no setting of its own: rows alone are no bound for whole texts and sets of shingles."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


class Workspace:
    """Tables written under one fresh folder of :func:`shared_root`.

    A written table is committed by Spark's own protocol, so a lost executor costs a re-read of
    files, never a recomputation of what came before; nothing is kept on one machine's disk.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        bounded_batches(spark)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return it read back, with its lineage cut."""
        path = self.path(name)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # the shuffle files of this write are of no use after it
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before) if before else self.spark.conf.unset(CLEANUP)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._brindle_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table of this workspace that nothing reads any more."""
        path = getattr(df, "_brindle_path", None)
        if path:
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system (local, HDFS, S3, GCS ...) of a URI or plain absolute path, and the path there."""
    if "://" in uri or uri.startswith("file:"):
        fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[len("file:"):])
        return fs, path
    return pafs.LocalFileSystem(), uri


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(docs: DataFrame, *names: str) -> tuple:
    """docs with its columns called c0, c1 ... by position, so that no name of the user's meets one of an operator's; then the new names of some."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), *(f"c{docs.columns.index(n)}" for n in names)


def named_as(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that numbered() made, under their names in docs."""
    return out.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
