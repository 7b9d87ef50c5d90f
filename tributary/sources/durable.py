"""Intermediate tables that end a lineage: written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch for removing a job's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; unset, local mode (as in tests) gets a folder of its own, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tributary-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Durable:
    """Parquet tables of one job. A lost executor costs no work before them, and their sizes are known to the planner.

    Those that nothing needs any more can be dropped; the last ones belong to the result and stay with it. With tidy, the
    shuffle files of a table's job go as soon as it is written, not when the driver's memory happens to be collected.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.tidy = tidy
        self.spark, self.root = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.tables)}"
        if self.tidy:
            before = self.spark.conf.get(CLEANUP, "false")
            self.spark.conf.set(CLEANUP, "true")
            try:
                df.write.parquet(path)
            finally:
                self.spark.conf.set(CLEANUP, before)
        else:
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for kept, path in self.tables:
            if any(kept is df for df in tables):
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
