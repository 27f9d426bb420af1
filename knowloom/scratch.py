"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .cluster import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="knowloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


#: Whether Spark deletes an execution's shuffle files at its end, and not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables that cut lineage. They live in the shared folder, so a lost executor loses none of them.

    The folder goes when the driver's Python ends, since results are lazy and may read it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = ship(spark)
        self.root = f"{shared_dir(spark)}/knowloom-{name}-{uuid.uuid4().hex}"
        atexit.register(self._drop)

    def _drop(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass

    def keep(self, df: DataFrame, name: str, compression: str | None = None, free: bool = False) -> DataFrame:
        """Write df and read it back. free: its shuffle files go once it is written."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(FREE_SHUFFLES, "false")
        try:
            if free:
                self.spark.conf.set(FREE_SHUFFLES, "true")
            df.write.parquet(path, compression=compression)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete_path(self.spark, f"{self.root}/{name}")
