"""Joins of points with circles, by cells of a grid over the globe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radius of the earth and length of a degree of latitude in miles; the shorter one, so that boxes are never too small.
EARTH_MILES, DEGREE_MILES = 3958.7613, 69.0


def miles_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_MILES) -> Column:
    """Great-circle distance."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return F.lit(radius) * 2 * F.asin(F.sqrt(F.least(F.lit(1.0), half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2))))


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))


def within(points: DataFrame, circles: DataFrame, lat: str = "latitude", lon: str = "longitude", cell_degrees: float = 1.0) -> DataFrame:
    """Every pair of a point and a circle(origin_id, origin_lat, origin_lon, radius_miles) that holds it, with miles.

    A point lies in one cell, and a circle is dealt to the cells that its box
    meets, so a pair meets once; distances are computed within cells only.  The
    box widens with the latitude and spans the globe where it holds a pole;
    longitudes wrap.  Rows without a finite place are in no pair.
    """
    finite = lambda *names: F.expr(" AND ".join(f"coalesce({n} BETWEEN -{m} AND {m} AND NOT isnan({n}), false)" for n, m in names))
    around = round(360 / cell_degrees)
    placed = points.where(finite((lat, 90), (lon, 360))).withColumn("_x", F.pmod(F.floor(F.col(lon) / cell_degrees), F.lit(around)).cast("int")).withColumn("_y", F.floor(F.col(lat) / cell_degrees).cast("int"))
    high = F.col("radius_miles") / DEGREE_MILES
    top = F.greatest(F.abs(F.col("origin_lat") - high), F.abs(F.col("origin_lat") + high))
    # the widest place of a circle lies nearer to the pole than its middle
    reach = F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.least(high, F.lit(90.0)))) / F.cos(F.radians(F.least(F.abs("origin_lat"), F.lit(89.999))))))
    wide = F.when(top >= 90, 180.0).otherwise(F.least(F.degrees(reach) * 1.001, F.lit(180.0)))
    boxed = circles.where(finite(("origin_lat", 90), ("origin_lon", 360)) & (F.col("radius_miles") >= 0)).withColumn("_wide", wide)
    xs = F.array_distinct(F.transform(_cells(F.col("origin_lon") - F.col("_wide"), F.col("origin_lon") + F.col("_wide"), cell_degrees), lambda x: F.pmod(x, F.lit(around))))
    dealt = boxed.withColumn("_x", F.explode(xs)).withColumn("_y", F.explode(_cells(F.col("origin_lat") - high, F.col("origin_lat") + high, cell_degrees))).drop("_wide")
    miles = miles_between(F.col("origin_lat"), F.col("origin_lon"), F.col(lat), F.col(lon))
    return placed.join(dealt, ["_x", "_y"]).withColumn("miles", miles).where("miles <= radius_miles").drop("_x", "_y")
