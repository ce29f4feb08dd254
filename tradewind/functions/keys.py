"""Keys of people and places, local times and network buckets."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def person_key(user_id: str, identifier: str, secret: str) -> Column:
    """A pseudonym: 32 hex digits of the keyed hash of the account, or of the trimmed lower-case name where there is none.

    The key is HMAC-SHA-256, written out with the built-in hash: the secret is
    padded to a block and combined with the two fixed bytes.
    """
    block = secret.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    who = F.when(F.col(user_id).isNotNull(), F.concat(F.lit("u:"), F.col(user_id).cast("string"))).otherwise(F.concat(F.lit("n:"), F.lower(F.regexp_replace(F.coalesce(identifier, F.lit("")), r"^\s+|\s+$", ""))))
    first = F.sha2(F.concat(F.lit(inner), who.cast("binary")), 256)
    return F.substring(F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256), 1, 32)


def player_key(name: str) -> Column:
    """A player's name as a key: lower case, white space collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")))


def played(place: str = "place", won: str = "matches_won", lost: str = "matches_lost", drawn: str = "matches_drawn") -> Column:
    """Whether an entry has a place or any match."""
    return F.expr(f"coalesce({place} >= 0, false) OR coalesce({won} > 0, false) OR coalesce({lost} > 0, false) OR coalesce({drawn} > 0, false)")


def with_local_time(rows: DataFrame, at: str, zone: str, to: str = "local_ts") -> DataFrame:
    """The rows with the wall clock of their zone; unknown or missing zones count as UTC.

    Spark fails on a zone that it doesn't know, so zones are looked up in a
    list of fixed size first.
    """
    known = rows.sparkSession.createDataFrame([(z,) for z in sorted(available_timezones())], "zone string").withColumnRenamed("zone", "_zone")
    joined = rows.join(F.broadcast(known), F.col(zone) == F.col("_zone"), "left")
    return joined.withColumn(to, F.from_utc_timestamp(at, F.coalesce("_zone", F.lit("UTC")))).drop("_zone")


def network_bucket(address: str) -> Column:
    """What rate limits count by: an IPv4 address itself, the first four groups of an IPv6 address."""
    a = F.col(address)
    groups = F.split(a, ":")
    full = F.expr(f"regexp_replace({address}, '::', concat(':', repeat('0:', 8 - size(filter(split({address}, ':'), x -> x <> '')))))")
    return F.when(~a.contains(":"), a).otherwise(F.concat(F.array_join(F.transform(F.slice(F.when(a.contains("::"), F.split(full, ":")).otherwise(groups), 1, 4), lambda g: F.lower(F.regexp_replace(g, "^0+(?=.)", ""))), ":"), F.lit("::/64")))
