"""A table of Parquet folders whose versions are swapped in by one small file, for merges that may run twice or die.

The rows lie in folders that are written once and never changed, dealt to
``buckets`` by their keys.  A log of one-row Parquet files says, for each
version, which folder holds which bucket; a version counts once its log file is
there, and Spark's committer moves that file into place whole.  So a reader sees
the version before or the one after, a write that died leaves folders that
nothing names, and a batch whose number the log holds already changes nothing.
A merge reads and writes only the buckets that its batch touches.

One writer at a time; readers need none of the writer's state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tradewind.sinks.merge import upserted

LOG = "version bigint, batch bigint, folder string, touched array<int>"


class VersionedTable:
    """A table at a path, with its columns and the keys that its rows are dealt by."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 8) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema
        if not self._logged():
            self._log(0, None, "", [])

    def _logged(self) -> bool:
        try:
            self.spark.read.schema(LOG).parquet(f"{self.path}/log").limit(1).collect()
            return True
        except Exception as error:  # a new table has no log yet
            if "PATH_NOT_FOUND" in str(error):
                return False
            raise

    def _log(self, version: int, batch: int | None, folder: str, touched: list[int]) -> None:
        self.spark.createDataFrame([(version, batch, folder, touched)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _versions(self) -> list:
        """The log, one row a version."""
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log").orderBy("version").collect()

    def holds(self, batch: int) -> bool:
        """Whether a batch has been committed."""
        return any(v.batch == batch for v in self._versions())

    def version(self) -> int:
        return self._versions()[-1].version

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def rows(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The newest version's rows, or those before a batch was committed; of some buckets if given."""
        newest: dict[int, str] = {}
        for v in self._versions():
            if before is not None and v.batch == before:
                break
            newest |= dict.fromkeys(v.touched, v.folder)
        paths = [f"{self.path}/{newest[b]}/_bucket={b}" for b in sorted(newest) if newest[b] and (buckets is None or b in buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _commit(self, rows: DataFrame, touched: list[int] | None, batch: int | None) -> None:
        folder = f"rows-{uuid.uuid4().hex}"
        rows.select(self.schema.fieldNames()).withColumn("_bucket", self._bucket()).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(StructType([*self.schema.fields]).add("_bucket", IntegerType())).parquet(f"{self.path}/{folder}")
        held = {r[0] for r in written.select("_bucket").distinct().collect()}
        version = self.version() + 1
        # buckets that have become empty point nowhere; both entries are one file
        emptied = sorted(set(range(self.buckets) if touched is None else touched) - held)
        log = [(version, batch, folder, sorted(held))] + ([(version, batch, "", emptied)] if emptied else [])
        self.spark.createDataFrame(log, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def merge(self, batch: DataFrame, order: list[str], number: int | None = None) -> bool:
        """Upserts a batch, its last row of each key by ``order``; returns whether anything was done."""
        return self.change(lambda stored: upserted(stored, batch, self.keys, order), batch, number)

    def change(self, change: Callable[[DataFrame], DataFrame], batch: DataFrame, number: int | None = None) -> bool:
        """Replaces the buckets that a batch's keys fall into by what change() makes of their rows."""
        if number is not None and self.holds(number):
            return False
        touched = [r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect()]  # no more than buckets
        if touched:
            self._commit(change(self.rows(touched)), touched, number)
        return bool(touched)

    def replace(self, rows: DataFrame, number: int | None = None) -> bool:
        """Swaps in other rows for the whole table, as a refresh does."""
        if number is not None and self.holds(number):
            return False
        self._commit(rows, None, number)
        return True


def refreshed(table: VersionedTable, attempts: list[Callable[[], DataFrame]]) -> int:
    """Replaces the table by the first attempt that can be computed and written whole; returns its place.

    Readers keep the old version until then, and for good if every attempt fails.
    """
    for i, attempt in enumerate(attempts):
        try:
            table.replace(attempt())
            return i
        except Exception:
            if i == len(attempts) - 1:
                raise
    raise ValueError("no attempt given")
