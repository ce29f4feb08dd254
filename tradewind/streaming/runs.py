"""Reading tables as streams, and running a stream over what has arrived so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.sinks.shared import shared_path
from tradewind.sources.tables import table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A table of the folder as a stream of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet*")


def in_batches(rows: DataFrame, arrived: Column, batches: int, name: str, rows_per_file: int = 500_000) -> DataFrame:
    """Replays a table as a stream: its rows in order of arrival, batch by batch; what rows say of their time isn't changed.

    Every batch is as many files, so a trigger that takes that number of files
    takes one batch; larger tables have more of them, and no task writes or
    reads a whole batch.
    """
    spark = rows.sparkSession
    path, at = shared_path(spark, name), F.unix_micros(arrived.cast("timestamp"))
    first, last, count = rows.agg(F.min(at), F.max(at), F.count("*")).first()
    step = 1 if first is None else (last - first + batches) // batches
    files = max(1, -(-count // (rows_per_file * batches)))
    stamped = rows.withColumn("_batch", F.coalesce(F.floor((at - F.lit(first)) / step), F.lit(0)))
    for i in range(batches):
        batch, folder = stamped.where(F.col("_batch") == i).drop("_batch"), f"{path}/{i:04d}"
        (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.parquet(folder)
        # a part without rows isn't written: empty files take the places that are left
        for _ in range(files - len(spark.read.schema(rows.schema).parquet(folder).inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)


def _writer(rows: DataFrame, name: str):
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.writeStream.outputMode("append").option("checkpointLocation", shared_path(spark, f"{name}-log")).trigger(availableNow=True)


def run_once(rows: DataFrame, name: str) -> DataFrame:
    """Runs a stream until it has read all there is, and reads what it has appended, exactly once by the sink's own log."""
    return run_until(rows, name)[0]


def run_until(rows: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """The same with the watermark at the end, up to which all has been given out."""
    spark = rows.sparkSession
    out = shared_path(spark, name)
    query = _writer(rows, name).format("parquet").option("path", out).start()
    query.awaitTermination()
    times = (query.lastProgress or {"eventTime": {}})["eventTime"] or {}
    return spark.read.schema(rows.schema).parquet(out), F.lit(times.get("watermark", "1970-01-01T00:00:00.000Z")).cast("timestamp")


def each_batch(rows: DataFrame, name: str, write: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream until it has read all there is and gives each batch with its number to write(), which must bear a batch twice."""
    _writer(rows, name).foreachBatch(write).start().awaitTermination()
