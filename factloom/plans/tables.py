"""Stage tables of plans that call a model: written once, so that no call is made again."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_folder(spark: SparkSession) -> str:
    """A new place in the folder of spark.checkpoint.dir; where that is unset, in a temporary one on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stages-")
    return f"{folder.rstrip('/')}/stages-{uuid.uuid4().hex}"


class Writer:
    """Writes tables in a ``stage_folder`` and reads them again; the shuffle files of a table are freed when it is written.

    Without that they stay until the driver's heap happens to be collected, those
    of all tables together. Tables hold texts mostly, so they are packed with Zstandard.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.folders = spark, stage_folder(spark), []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.folders)}"
        self.folders.append(path)
        before = self.spark.conf.get(CLEANUP, None)
        with contextlib.suppress(Exception):  # older sessions don't have the setting
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            with contextlib.suppress(Exception):
                self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.folder = path
        return table

    def drop(self, table: DataFrame) -> None:
        """Frees a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(table.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def writer(spark: SparkSession) -> Writer:
    return Writer(spark)
