"""Streams give the same whatever files their rows lie in, and forget what is over."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tradewind.sinks.shared import shared_path
from tradewind.streaming import events as E
from tradewind.streaming.alerts import cooled_alerts
from tradewind.streaming.runs import run_once

START = dt.datetime(2024, 1, 1)
SCHEMA = "user_id bigint, pool string, ts timestamp, value double"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Every partition is a state store that each batch commits."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(rng.randrange(6), "p", START + dt.timedelta(minutes=rng.randrange(12 * 1440)), float(rng.randrange(100))) for _ in range(600)]


def stream(spark, given, files):
    """The rows in order of time, some an hour late, cut into files that a batch each reads."""
    path = shared_path(spark, "cut")
    late = sorted(given, key=lambda r: r[2] + dt.timedelta(minutes=hash(r[2].minute * 7) % 60))
    step = -(-len(late) // files)
    for i in range(files):
        spark.createDataFrame(late[i * step : (i + 1) * step], SCHEMA).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def loop(given, threshold, days, until):
    last, out = {}, []
    for user, _, at, value in sorted(given, key=lambda r: (r[2], r[3])):
        if value >= threshold and at <= until and (user not in last or (at.date() - last[user]).days >= max(1, days)):
            last[user] = at.date()
            out.append((user, at, value))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 4, 10])
def test_alerts_dont_depend_on_files(spark, rows, files):
    got = run_once(cooled_alerts(stream(spark, rows, files), "user_id", "value", "ts", 60.0, 2, "2 hours"), "alerts")
    until = max(r[2] for r in rows if r[3] >= 60) - dt.timedelta(hours=2)
    assert sorted(tuple(r) for r in got.collect()) == loop(rows, 60.0, 2, until)


def test_alerts_of_one_day_in_two_files(spark):
    """Rows at 10:00 and 01:00 of a day fire at 01:00, in whatever order they come; without a cooldown a day fires once."""
    at = lambda d, h: START + dt.timedelta(days=d, hours=h)
    given = [(1, "p", at(0, 10), 90.0), (1, "p", at(0, 1), 80.0), (1, "p", at(1, 5), 70.0), (1, "p", at(9, 0), 99.0)]
    path = shared_path(spark, "two")
    for i, r in enumerate(given):
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.parquet(f"{path}/{i}")
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    for cooldown, want in ((2, [80.0]), (0, [80.0, 70.0])):
        got = run_once(cooled_alerts(rows, "user_id", "value", "ts", 50.0, cooldown, "1 day"), "alerts").orderBy("fired_at").collect()
        assert [r.observed for r in got] == want


def test_state_is_bounded(spark, rows):
    """Over 20 batches with late rows, each stream's state holds no more than what the watermark hasn't passed."""
    made = {
        "alerts": lambda s: cooled_alerts(s, "user_id", "value", "ts", 60.0, 2, "2 hours"),
        "sessions": lambda s: E.sessions(s, "user_id", "6 hours", delay="2 hours"),
        "limits": lambda s: E.rate_limits(s, "user_id", "pool", most=2, pool_most=9, pool_busy=6, light=1, delay="2 hours"),
    }
    for name, make in made.items():
        writer = make(stream(spark, rows, 20)).writeStream.outputMode("append").option("checkpointLocation", shared_path(spark, "log")).trigger(availableNow=True)
        query = writer.format("parquet").option("path", shared_path(spark, "out")).start()
        query.awaitTermination()
        held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in map(dict, query.recentProgress) if p["stateOperators"]]
        assert len(held) >= 20 and max(held[5:]) <= 2 * max(held[:8]) + 10, (name, held)


def test_report_windows(spark):
    day = lambda d: (START + dt.timedelta(days=d),)
    got = E.report_windows(spark.createDataFrame([day(0), day(1), day(3), day(8)], "built_at timestamp")).orderBy("built_at").collect()
    assert [(r.built_at - r.cutoff).days for r in got] == [1, 1, 2, 3]
