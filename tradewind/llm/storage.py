"""Tables that cut lineage, in the folder which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine only where none is set and all tasks run here, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tradewind-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Stored:
    """A table written once: its rows survive the loss of executors, and later jobs don't make them again."""

    def __init__(self, rows: DataFrame, name: str) -> None:
        self.spark = rows.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(self.path)
        self.rows = self.spark.read.schema(rows.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files.  Only for rows that no later job reads."""
        java = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        java.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(java, True)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written and read again."""
    return Stored(rows, name).rows


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
