"""The spatial join against all pairs: borders of cells, the date line, poles, and rows without a place."""

import math
import random

from tradewind.operators.spatial import EARTH_MILES, within


def apart(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return EARTH_MILES * 2 * math.asin(math.sqrt(min(1.0, h)))


def test_within_equals_all_pairs(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)] + [(400, 40.0, -75.0), (401, 89.9, 10.0), (402, -89.5, -170.0), (403, 10.0, 179.9), (404, 10.0, -179.9), (405, None, 1.0), (406, float("nan"), 1.0), (407, 0.0, 180.0), (408, 0.0, -180.0)]
    circles = [(i, rng.uniform(-85, 85), rng.uniform(-180, 180), rng.choice([0.0, 50.0, 400.0, 1500.0])) for i in range(40)] + [(40, 40.0, -75.0, 0.0), (41, 89.0, 0.0, 300.0), (42, -89.0, 90.0, 200.0), (43, 10.0, 180.0, 60.0), (44, 0.0, 0.0, 13000.0), (45, None, 0.0, 10.0), (46, 0.0, 179.99, 5.0)]
    p = spark.createDataFrame(points, "event_id int, latitude double, longitude double")
    c = spark.createDataFrame(circles, "origin_id int, origin_lat double, origin_lon double, radius_miles double")
    want = {(i, j) for i, a, b in points if a is not None and not math.isnan(a) for j, x, y, r in circles if x is not None and apart(x, y, a, b) <= r}
    for cell in (1.0, 7.5, 30.0):
        got = [(r.event_id, r.origin_id) for r in within(p, c, cell_degrees=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plan = within(p, c)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_softest_events(spark):
    """A store with events of the kind, one with others only, one with neither; scores as the rule says."""
    from tradewind.operators.softest import softest_events

    day = "2024-06-01"
    events = spark.createDataFrame([(i, s, k, f"{d} 10:00:00", 41.9, -87.6, n) for i, s, k, d, n in [(1, 1, "championship", "2024-07-01", None), (2, 2, "championship", "2024-07-01", 3), (3, 3, "championship", "2024-07-01", 50), (10, 1, "championship", "2024-01-01", None), (11, 1, "weekly", "2024-01-01", None), (12, 2, "weekly", "2024-01-01", None), (13, 2, "weekly", "2020-01-01", None), (14, 1, "weekly", "2024-02-01", None)]], "event_id int, store_id int, kind string, start_datetime string, latitude double, longitude double, registered int").selectExpr("* EXCEPT (start_datetime)", "CAST(start_datetime AS TIMESTAMP) AS start_datetime")
    came = [(10, f"p{i}", 1, 0, 0, 0) for i in range(20)] + [(11, f"p{i}", 1, 0, 0, 0) for i in range(10)] + [(12, f"P{i}", None, 1, 0, 0) for i in range(8)] + [(12, "noshow", None, 0, 0, 0)] + [(13, f"p{i}", 1, 0, 0, 0) for i in range(99)] + [(14, "p1", 1, 0, 0, 0)]
    attendance = spark.createDataFrame(came, "event_id int, person string, place int, matches_won int, matches_lost int, matches_drawn int")
    people = spark.createDataFrame([("P1", 1700.0, 9), ("p2", 1500.0, 5), ("p3", 1900.0, 4)], "name string, rating double, n_matches int")
    one = lambda sql: spark.sql(sql)
    got = softest_events(events, events.where("start_datetime < '2024-06-01'"), attendance, one("SELECT 12 AS event_id"), people, one("SELECT 1 AS origin_id, 41.9D AS origin_lat, -87.6D AS origin_lon, 5D AS radius_miles"), day, one("SELECT 3 AS store_id"))
    by = {r.store_id: r for r in got.collect()}
    assert len(by) == 3 and all(r.in_bubble and r.miles == 0 for r in by.values())
    # medians over all stores: 20 of the kind, 9 of the others (1, 8, 10 and 99)
    assert (by[1].past_own, by[1].med_own, by[1].est_field, by[1].rated_seen, by[1].sharks_seen, by[1].top_rating, by[1].score) == (1, 20, 20, 2, 1, 1700, 24)
    assert (by[2].past_own, by[2].med_own, by[2].past_other, by[2].med_other, by[2].est_field, by[2].scanned_events, by[2].score) == (0, None, 1, 8, round(8 * 20 / 9), 1, round(8 * 20 / 9 + 2 + 2))
    assert (by[3].est_field, by[3].rated_seen, by[3].score) == (50, 0, 50)
