"""Merges of a batch into a stored table, and the writes that follow.

Plain Parquet has no MERGE: merged rows are written beside the table and swapped
in (sinks.versions), or the touched partitions alone are overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_of_batch(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in order; partial aggregation keeps one row per key and task before the shuffle."""
    rest = [c for c in batch.columns if c not in keys]
    best = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("best")
    return batch.groupBy(*keys).agg(best).select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest)).select(batch.columns)


def upserted(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table after the batch: its last row of each key replaces the stored one."""
    new = last_of_batch(batch, keys, order)
    return stored.join(new.select(*keys), keys, "left_anti").select(stored.columns).unionByName(new.select(stored.columns))


def inserted(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The batch's rows to append: first in order of each key that the table doesn't hold."""
    rest = [c for c in batch.columns if c not in keys]
    first = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("first")
    new = batch.groupBy(*keys).agg(first).select(*keys, *(F.col(f"first.{c}").alias(c) for c in rest)).select(batch.columns)
    return new.join(stored.select(*keys), keys, "left_anti").select(batch.columns)


def trusted(fetched: int, upcoming: int | None, least: int = 4000, ratio: float = 0.7) -> bool:
    """Whether a pull is whole enough to delete by: not under a floor, and no less than a share of the upcoming rows on file.

    Without the number of these nothing is deleted: then the share can't be judged.
    """
    return fetched >= least and upcoming is not None and fetched >= ratio * upcoming


def fates(stored: DataFrame, seen: str, starts: str, run: str, whole: bool, grace_hours: int = 36, keep_days: int = 30) -> DataFrame:
    """Each row's fate: delisted (upcoming, unseen for ``grace_hours`` before the run), archived (past by ``keep_days``) or kept.

    All are kept after a pull that isn't whole.
    """
    at = F.lit(run).cast("timestamp")
    hours = lambda n: F.make_interval(hours=F.lit(n))
    delisted = (F.col(starts) >= at) & (F.col(seen) < at - hours(grace_hours))
    past = F.col(starts) < at - hours(24 * keep_days)
    return stored.withColumn("fate", F.when(F.lit(whole) & delisted, "delisted").when(F.lit(whole) & past, "archived").otherwise("kept"))


def reread_plan(stored: DataFrame, fetched: DataFrame, events: DataFrame, event: str, member: str, least: int = 3, share: float = 0.5) -> DataFrame:
    """Per event that was read what the re-read changes: members to add and to delete by name, and whether deletes are held back.

    An event that came back empty though rows are on file is untrusted: nothing
    is deleted.  One that would lose more than ``least`` rows and more than
    ``share`` of them is held back.  Events that weren't read aren't in the plan.
    """
    gather = lambda rows, name: rows.where(F.col(member).isNotNull()).groupBy(event).agg(F.array_sort(F.collect_set(member)).alias(name))
    both = events.select(event).distinct().join(gather(stored, "had"), event, "left").join(gather(fetched, "has"), event, "left")
    empty = F.array().cast(stored.select(F.array(member)).schema[0].dataType)
    both = both.withColumns({"had": F.coalesce("had", empty), "has": F.coalesce("has", empty)})
    gone = F.array_except("had", "has")
    state = F.when((F.size("has") == 0) & (F.size("had") > 0), "untrusted").when(F.size(gone) > F.greatest(F.lit(least), F.floor(F.size("had") * share)), "held back").otherwise("apply")
    return both.select(event, state.alias("state"), F.array_except("has", "had").alias("adds"), F.when(state == "apply", gone).otherwise(empty).alias("deletes"))


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that the rows belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header line, quotes doubled."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
