"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; one of our own only where the setting is absent and all runs in one process."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandwise-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers of this machine import the library from where the driver did.

    On a cluster the library is installed or shipped with ``--py-files``; a path that isn't there does no harm.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


class Workspace:
    """Written tables of one operator run.

    ``save`` writes a DataFrame and returns a reader of the files, so a lost executor
    costs a re-read, not a recomputation.  ``drop`` deletes what later steps no longer read;
    ``close`` deletes everything but the named tables.
    """

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.saved: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "zstd", batch: int | None = None) -> DataFrame:
        """``batch``: rows that Python workers get at once, for tables whose rows have megabytes."""
        # What is written is read from now on, so the shuffles behind it go as soon as the write is done.
        wanted = {CLEANUP_KEY: "true"} | ({BATCH_KEY: str(batch)} if batch else {})
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        self.saved.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)
            self.saved.discard(name)

    def close(self, *keep: str) -> None:
        self.drop(*(self.saved - set(keep)))
        self.release()

    def release(self) -> None:
        """Let shuffle files of frames that nothing refers to go now; they stay until both collectors have run."""
        gc.collect()
        self.spark._jvm.System.gc()
