"""Stores by season: events, tickets and distinct people, exact for any window of seasons.

People can't be added up over seasons: a regular of four sets is one person.
So everyone gets a dense number once, and for every store and season the
numbers are kept as bitmaps of 32,768 bits; a window's people are the bits of
the union of its seasons' bitmaps.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.functions.keys import played

#: Tiers by least events, people and tickets, the best first.
TIERS = (("Legendary", 50, 50, 500), ("Standard", 25, 25, 250))


def main_sets(sets: DataFrame, today: str) -> list[tuple[str, dt.date]]:
    """(name, released) of the released sets(name, code, released_at) whose code is a plain number, the newest first; a row a set."""
    rows = sets.where(F.trim("code").rlike("^[0-9]+$") & (F.col("released_at") <= F.lit(today).cast("date"))).select("name", F.to_date("released_at").alias("d")).orderBy(F.desc("d"), "name").collect()
    return [(r.name, r.d) for r in rows]


def season_window(sets: list[tuple[str, dt.date]], n: int = 4, skip_current: bool = True) -> tuple[dt.date, dt.date | None, list[str]]:
    """(since, until, names) of the newest n seasons; the running one is left out at both ends, so until is its release and isn't in the window."""
    until = None
    if skip_current and len(sets) > n:
        until, sets = sets[0][1], sets[1:]
    kept = sets[:n]
    if not kept:
        raise ValueError("no numbered set is released")
    return kept[-1][1], until, [name for name, _ in kept]


def season_of(day: str, sets: list[tuple[str, dt.date]]) -> F.Column:
    """The name of the newest set that is released by a day; null before the first."""
    season = F.lit(None).cast("string")
    for name, released in reversed(sets):  # the oldest first
        season = F.when(F.col(day) >= F.lit(released), name).otherwise(season)
    return season


def person_of(user_id: str = "user_id", identifier: str = "identifier") -> F.Column:
    """The account, or the trimmed lower-case name of a guest."""
    name = F.lower(F.regexp_replace(F.coalesce(identifier, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(F.col(user_id).isNotNull(), F.concat(F.lit("u:"), F.col(user_id).cast("string"))).otherwise(F.concat(F.lit("n:"), name))


def held_events(events: DataFrame, attendance: DataFrame, tracked: DataFrame) -> DataFrame:
    """events(event_id, store_id, day, cancelled) of tracked stores with has_results; cancelled ones only if anyone has a result."""
    results = attendance.where(played("place", "won", "lost", "drawn")).select("event_id").distinct().withColumn("has_results", F.lit(True))
    own = events.join(tracked.select("store_id").distinct(), "store_id", "left_semi").join(results, "event_id", "left")
    return own.withColumn("has_results", F.coalesce("has_results", F.lit(False))).where(F.col("has_results") | ~F.coalesce("cancelled", F.lit(False)))


def tickets(held: DataFrame, attendance: DataFrame, scans: DataFrame) -> DataFrame:
    """(event_id, store_id, day, person, recorded): one row a person and event.

    Those who played where an event has results; else, where it was scanned, the
    complete registrations.
    """
    rows = held.select("event_id", "store_id", "day", "has_results").join(attendance, "event_id")
    scanned = scans.select("event_id").distinct().withColumn("scanned", F.lit(True))
    status = F.upper(F.coalesce("status", F.lit("")))
    counted = F.when(F.col("has_results"), played("place", "won", "lost", "drawn")).otherwise(F.coalesce("scanned", F.lit(False)) & ((status == "") | (status == "COMPLETE")))
    return rows.join(scanned, "event_id", "left").where(counted).select("event_id", "store_id", "day", person_of().alias("person"), F.col("has_results").alias("recorded"))


def store_tiers(held: DataFrame, ticket_rows: DataFrame, scans: DataFrame, since: dt.date, until: dt.date | None, tiers: tuple = TIERS) -> DataFrame:
    """Per store in the window: events, those without a scan (gap), tickets, unrecorded ones among them, people, and the tier."""
    inside = (F.col("day") >= F.lit(since)) & (F.lit(True) if until is None else F.col("day") < F.lit(until))
    scanned = scans.select("event_id").distinct().withColumn("scanned", F.lit(True))
    run = held.where(inside).join(scanned, "event_id", "left").groupBy("store_id").agg(F.count("*").alias("events"), F.count_if(F.col("scanned").isNull()).alias("gap"))
    came = ticket_rows.where(inside).groupBy("store_id").agg(F.count("*").alias("tickets"), F.count_if(~F.col("recorded")).alias("unrecorded"), F.countDistinct("person").alias("people"))
    found = run.join(came, "store_id", "left").na.fill(0, ["tickets", "unrecorded", "people"])
    tier = F.lit("Welcome")
    for name, events, people, sold in reversed(tiers):
        tier = F.when((F.col("events") >= events) & (F.col("people") >= people) & (F.col("tickets") >= sold), name).otherwise(tier)
    return found.withColumn("tier", tier)


def numbered(people: DataFrame, parts: int = 64) -> DataFrame:
    """(person, number): distinct people numbered from 1 without gaps, part by part; only the parts' sizes meet in one task."""
    dealt = people.select("person").distinct().withColumn("part", F.pmod(F.xxhash64("person"), F.lit(parts)))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "offset")
    return dealt.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy("person"))).join(sizes, "part").select("person", (F.col("offset") + F.col("k")).alias("number"))


def season_bitmaps(ticket_rows: DataFrame, people: DataFrame, season: F.Column) -> DataFrame:
    """(store_id, season, bucket, bits, tickets): the numbers of a season's people at a store, a bitmap for each bucket of numbers; tickets count in the bucket of their person."""
    rows = ticket_rows.withColumn("season", season).where("season IS NOT NULL").join(people, "person")
    return rows.groupBy("store_id", "season", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"), F.count("*").alias("tickets"))


def window_people(bitmaps: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, store_id, people, tickets) for windows(window_id, season), out of the stored bitmaps alone."""
    per = bitmaps.join(windows, "season").groupBy("window_id", "store_id", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("people"), F.sum("tickets").alias("tickets"))
    return per.groupBy("window_id", "store_id").agg(F.sum("people").alias("people"), F.sum("tickets").alias("tickets"))
