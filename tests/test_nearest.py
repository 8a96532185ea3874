"""Nearest places within a limit, against every pair, at all latitudes."""

import math
import random

import pytest

from lumiquarry.operators import joins

SCHEMA = "{}id long, {}lat double, {}lon double, radius double, _x string"


def apart(measure, a, b):
    (y, x), (v, u) = a, b
    if measure == "degrees":
        return math.hypot(y - v, x - u)
    if measure == "flat":
        return 1000 * math.hypot((y - v) * 111.0, (x - u) * 111.32 * math.cos(math.radians((y + v) / 2)))
    h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def around(r, lat, lon, metres):
    """A point some way off."""
    return max(-90.0, min(90.0, lat + r.uniform(-1, 1) * metres / 111_000)), lon + r.uniform(-1, 1) * metres / 111_000 / max(0.0005, math.cos(math.radians(lat)))


@pytest.mark.parametrize("measure", ["degrees", "flat", "arc"])
@pytest.mark.parametrize("latitude", [0, 48, -60, 85, 89.95])
def test_against_every_pair(spark, measure, latitude):
    r = random.Random(latitude)
    limit = 0.05 if measure == "degrees" else 1500.0
    homes = [(latitude + r.uniform(-0.02, 0.02), r.choice([10.0, 179.999, -179.999, 0.0])) for _ in range(25)]
    wrap = lambda p: (p[0], (p[1] + 180) % 360 - 180)
    places = [(k, *wrap(around(r, *h, 900)), r.choice([300.0, 900.0, limit] if measure != "degrees" else [0.01, 0.05])) for k, h in enumerate(homes)] + [(90, None, 1.0, 1.0), (91, latitude + 0.001, 10.0, None)]
    points = [(k, *wrap(around(r, *r.choice(homes), 2500))) for k in range(150)] + [(500, None, None), (501, 1.0, None)]
    p = spark.createDataFrame([(*x, None, None) for x in points], SCHEMA.format("", "", ""))
    q = spark.createDataFrame([(*x, None) for x in places], SCHEMA.format("place_", "p", "p"))
    for top, strict in (("radius", False), (limit, True)):
        got = joins.nearest_within(p.drop("radius"), q, key="id", lat="lat", lon="lon", place_lat="plat", place_lon="plon", limit=top, measure=measure, strict=strict, order=["place_id"], take="place_id", digits=6)
        want = {}
        for k, y, x in points:
            near = [(round(apart(measure, (y, x), (v, u)), 6), n) for n, v, u, own in places for cap in [own if top == "radius" else limit] if None not in (y, x, v, u, cap) and (apart(measure, (y, x), (v, u)) < cap)]
            if near:
                want[k] = min(near)[1]
        assert {row["id"]: row["place_id"] for row in got.collect()} == want and len(want) > 2


def test_far_apart_in_degrees_and_near(spark):
    """A place 0.05 degrees of longitude away at 85 degrees, and one across the date line."""
    p = spark.createDataFrame([(1, 85.0, 10.0), (2, 0.0, 179.9999)], "id long, lat double, lon double")
    q = spark.createDataFrame([(7, 85.0, 10.05), (8, 0.0, -179.9999)], "pid long, plat double, plon double")
    run = lambda measure: {tuple(x) for x in joins.nearest_within(p, q, key="id", lat="lat", lon="lon", place_lat="plat", place_lon="plon", limit=1000, measure=measure, strict=True, order=["pid"], take="pid").collect()}
    assert run("flat") == {(1, 7)} and run("arc") == {(1, 7), (2, 8)}


def test_no_rows(spark):
    p = spark.createDataFrame([(1, 85.0, 10.0)], "id long, lat double, lon double")
    q = spark.createDataFrame([], "pid long, plat double, plon double, radius double")
    for limit in ("radius", 5.0):
        assert joins.nearest_within(p, q, key="id", lat="lat", lon="lon", place_lat="plat", place_lon="plon", limit=limit, measure="flat", strict=True, order=["pid"], take="pid").count() == 0
