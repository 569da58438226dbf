"""Published sample points of projections, and systems that nobody defined."""

import pytest
from pyspark.sql import functions as F

from tilescope.functions import geodesy
from tilescope.functions.projection import add_degrees, parse_definition, system_table

FOOT = 1200 / 3937
# Worked examples of EPSG Guidance Note 7-2 and of Snyder's manual: definition, x, y, latitude, longitude, and what
# the printed digits of x and y allow.
SAMPLES = {
    "lcc two parallels": (
        f"+proj=lcc +lat_1=28.383333333333333 +lat_2=30.283333333333333 +lat_0=27.833333333333333 +lon_0=-99 +x_0={2e6 * FOOT!r} +y_0=0 +ellps=clrk66 +units=us-ft",
        2963503.91, 254759.80, 28.5, -96.0, 1e-7,
    ),
    "lcc one parallel": (
        "+proj=lcc +lat_1=18 +lat_0=18 +lon_0=-77 +k_0=1 +x_0=250000 +y_0=150000 +ellps=clrk66",
        255966.58, 142493.51, 17 + 55 / 60 + 55.80 / 3600, -(76 + 56 / 60 + 37.26 / 3600), 1e-7,
    ),
    "stereographic by scale": ("+proj=stere +lat_0=90 +lon_0=0 +k=0.994 +x_0=2000000 +y_0=2000000 +ellps=WGS84", 3320416.75, 632668.43, 73.0, 44.0, 2e-7),
    "stereographic by latitude": ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000 +ellps=WGS84", 7255380.79, 7053389.56, -75.0, 120.0, 2e-7),
    "transverse mercator": (
        "+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy",
        577274.99, 69740.50, 50.5, 0.5, 1e-7,
    ),
    "albers": ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66", 1885472.7, 1535925.0, 35.0, -75.0, 1e-6),
    "degrees": ("+proj=longlat +ellps=WGS84", 12.5, -7.25, -7.25, 12.5, 1e-12),
}


@pytest.fixture(scope="module")
def systems(spark):
    extra = {"EPSG:32643": "+proj=utm +zone=43 +datum=WGS84", "EPSG:32743": "+proj=utm +zone=43 +south +datum=WGS84", "EPSG:3857": "+proj=merc +a=6378137 +rf=0 +lon_0=0"}
    return system_table(spark, {k: v[0] for k, v in SAMPLES.items()} | extra)


def test_published_points(spark, systems):
    rows = [(k, v[1], v[2]) for k, v in SAMPLES.items()]
    df = spark.createDataFrame(rows, "crs string, x double, y double")
    for r in add_degrees(df, systems, F.col("x"), F.col("y")).collect():
        _, _, _, lat, lng, near = SAMPLES[r["crs"]]
        assert r["crs_known"] and abs(r["lat"] - lat) < near and abs(r["lng"] - lng) < near, r


def test_equals_the_built_in_systems(spark, systems):
    rows = [(c, [x - 5.0, y - 5.0, x + 5.0, y + 5.0], x, y) for c in ("EPSG:32643", "epsg:32743 ", "EPSG:3857") for x in (210_000.0, 500_000.0, 730_000.0) for y in (1000.0, 2e6, 8e6)]
    df = spark.createDataFrame(rows, "crs string, bounds array<double>, x double, y double")
    want = geodesy.add_center_wgs84(df, lat="want_lat", lng="want_lng")
    for r in add_degrees(want, systems, F.col("x"), F.col("y")).collect():
        apart = (r["lng"] - r["want_lng"] + 180) % 360 - 180  # longitudes here are within half a turn
        assert r["lat"] == pytest.approx(r["want_lat"], abs=2e-9) and abs(apart) < 2e-9


def test_unknown_systems_and_nulls_are_flagged(spark, systems):
    df = spark.createDataFrame([("EPSG:9", 1.0, 2.0), (None, 1.0, 2.0), ("albers", None, 2.0)], "crs string, x double, y double")
    got = add_degrees(df, systems, F.col("x"), F.col("y")).collect()
    assert [(r["lat"], r["lng"], r["crs_known"]) for r in got] == [(None, None, False), (None, None, False), (None, None, True)]
    assert parse_definition("+proj=utm +zone=43 +south") == {"proj": "utm", "zone": "43", "south": "true"}
    with pytest.raises(ValueError, match="robin"):
        system_table(spark, {"x": "+proj=robin"})
