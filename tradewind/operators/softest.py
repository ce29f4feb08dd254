"""Upcoming championships by how hard their rooms are likely to be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.keys import played
from tradewind.operators.spatial import within


def softest_events(
    upcoming: DataFrame,
    history: DataFrame,
    attendance: DataFrame,
    scans: DataFrame,
    people: DataFrame,
    origins: DataFrame,
    now: str,
    tracked: DataFrame,
    kind: str = "championship",
    shark: float = 1600.0,
    min_matches: int = 5,
    lookback_months: int = 24,
    bubble_miles: float = 75.0,
    cell_degrees: float = 1.0,
) -> DataFrame:
    """Each origin's upcoming events of a kind within its radius, with what is known of their stores and a score; the lowest is the softest.

    The field is the median of the store's own events of the kind, else that of
    its others times the lift of the kind over all stores, else 12, and no less
    than are registered.  A rated regular counts as one body more, a shark as
    two more.  attendance(event_id, person, ...) counts those who played;
    people(name, rating, n_matches) rates them, several names of one person by
    rows of their own.
    """
    then = F.lit(now).cast("timestamp")
    sat = attendance.where(played()).select("event_id", "person")
    # what the store held: events with players, of the kind and of others
    fields = history.select("event_id", "store_id", "kind", "start_datetime").join(sat.groupBy("event_id").agg(F.count("*").cast("double").alias("players")), "event_id")
    own, other = F.col("kind") == kind, ~F.col("kind").eqNullSafe(F.lit(kind))
    recent = F.col("start_datetime") > then - F.make_interval(months=F.lit(lookback_months))
    only = lambda c, v: F.when(c, F.col(v))
    stores = fields.groupBy("store_id").agg(
        F.count_if(own).alias("past_own"), F.percentile(only(own, "players"), 0.5).alias("med_own"), F.max(only(own, "players")).alias("max_own"),
        F.count_if(other & recent).alias("past_other"), F.percentile(only(other & recent, "players"), 0.5).alias("med_other"),
    )
    lift = fields.agg(F.coalesce(F.percentile(only(own, "players"), 0.5) / F.nullif(F.percentile(only(other, "players"), 0.5), F.lit(0.0)), F.lit(1.0)).alias("lift"))
    rated = people.where(F.col("n_matches") >= min_matches).groupBy(F.lower("name").alias("name")).agg(F.max("rating").alias("rating"))
    came = history.where(recent).select("event_id", "store_id").join(sat, "event_id").select("store_id", "person").distinct()
    faces = came.join(rated, F.lower("person") == F.col("name")).groupBy("store_id").agg(F.count("*").alias("rated_seen"), F.count_if(F.col("rating") >= shark).alias("sharks_seen"), F.max("rating").alias("top_rating"))
    scanned = history.select("event_id", "store_id").join(scans.select("event_id"), "event_id").groupBy("store_id").agg(F.count("*").alias("scanned_events"))
    known = stores.join(faces, "store_id", "full").join(scanned, "store_id", "full")
    near = within(upcoming.where((F.col("kind") == kind) & (F.col("start_datetime") > then)), origins, cell_degrees=cell_degrees)
    near = near.join(known, "store_id", "left").join(tracked.select("store_id").distinct().withColumn("is_tracked", F.lit(True)), "store_id", "left").crossJoin(F.broadcast(lift))  # one row
    none = lambda c: F.coalesce(c, F.lit(0))
    expected = F.greatest(F.coalesce("med_own", F.col("med_other") * F.col("lift"), F.lit(12.0)), none("registered").cast("double"))
    whole = lambda c: F.rint(c).cast("int")
    return near.select(
        "origin_id", "event_id", "store_id", whole("miles").alias("miles"), F.to_date("start_datetime").alias("event_date"), ((F.col("miles") <= bubble_miles) | F.col("is_tracked").isNotNull()).alias("in_bubble"),
        none("past_own").alias("past_own"), whole("med_own").alias("med_own"), none("past_other").alias("past_other"), whole("med_other").alias("med_other"), whole(expected).alias("est_field"),
        none("rated_seen").alias("rated_seen"), none("sharks_seen").alias("sharks_seen"), whole("top_rating").alias("top_rating"), none("scanned_events").alias("scanned_events"),
        whole(expected + none("rated_seen") + 2 * none("sharks_seen")).alias("score"),
    )


def tracked_upcoming(upcoming: DataFrame, tracked: DataFrame, now: str, kind: str = "championship") -> DataFrame:
    """Upcoming events of a kind at tracked stores."""
    return upcoming.where((F.col("kind") == kind) & (F.col("start_datetime") > F.lit(now).cast("timestamp"))).join(tracked.select("store_id").distinct(), "store_id", "left_semi")
