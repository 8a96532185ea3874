"""Numbers of places that share a name: against plain loops, with crowded names, poles and missing places."""

import math
import random

import numpy as np
import pytest

from lumiquarry.operators import cluster

SCHEMA = "visit_id long, day string, name string, lat double, lon double, arrived_at double, base string, place int"


def far(a, b, km=2.0):
    if None in (*a, *b):
        return None
    return math.hypot((a[0] - b[0]) * 111.0, (a[1] - b[1]) * 111.32 * math.cos(math.radians((a[0] + b[0]) / 2))) > km


def held(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)


def scattered(seed, n, lat, spread):
    r = random.Random(seed)
    lon_spread = spread / max(0.001, math.cos(math.radians(lat)))
    rows = []
    for k in range(n):
        place = (lat + r.uniform(-spread, spread), 20 + r.uniform(-lon_spread, lon_spread))
        if r.random() < 0.3 and rows:
            place = rows[r.randrange(len(rows))][3:5]
        rows.append((k, r.choice("ab"), r.choices(["Lake", "Fort", None], [6, 2, 1])[0], *place, float(r.randrange(200))))
    return rows


def plain_days(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1:3], []).append(r)
    out = {}
    for (_, name), own in groups.items():
        own.sort(key=lambda r: (r[5], r[0]))
        apart = name is not None and any(far(a[3:5], b[3:5]) for i, a in enumerate(own) for b in own[i + 1 :])
        out |= {r[0]: f"{name} ({k + 1})" if apart and k else name for k, r in enumerate(own)}
    return out


def plain_all(rows):
    out, heads = {}, {}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        own = heads.setdefault(r[2], [])
        hit = next((k for k, h in enumerate(own) if far(h, r[3:5]) is False), None)
        if hit is None:
            own.append(r[3:5])
            hit = len(own) - 1
        out[r[0]] = r[2] if r[2] is None or hit == 0 else f"{r[2]} ({hit + 1})"
    return out


@pytest.mark.parametrize("lat,spread", [(34, 0.2), (34, 0.008), (34, 0.0095), (-70, 0.0101), (0, 0.0089), (89.5, 0.02), (34, 0.0001)])
def test_against_plain_loops(spark, lat, spread):
    rows = scattered(int(lat * 7 + spread * 1e4), 300, lat, spread)
    rows += [(900, "a", "Lake", None, 20.0, 3.0), (901, "b", "Lake", None, None, 4.0), (902, "a", "Lake", None, 20.0, 5.0)]
    df = held(spark, rows)
    assert {r["visit_id"]: r["name"] for r in cluster.numbered_per_day(df).collect()} == plain_days(rows)
    assert {r["visit_id"]: r["name"] for r in cluster.numbered_places(df).collect()} == plain_all(rows)


def test_corners_hold_the_farthest():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 50):
        p = r.integers(0, 6, (n, 2)).astype(float)
        c = cluster.hull(p)
        assert {tuple(x) for x in c} <= {tuple(x) for x in p}
        most = lambda q: max(np.hypot(*(a - b)) for a in q for b in q)
        assert most(c) == most(p)


def test_crowded_names(spark):
    """Tens of thousands of visits of one name, all near, and all apart."""
    near = spark.range(50_000).selectExpr("id AS visit_id", "'d' AS day", "'Lake' AS name", "34 + (id % 173) * 1e-5 AS lat", "77 + (id % 991) * 1e-5 AS lon", "id * 7 % 50000 AS arrived_at")
    assert cluster.numbered_per_day(near).where("name = 'Lake'").count() == 50_000 == cluster.numbered_places(near).where("name = 'Lake'").count()
    apart = spark.range(20_000).selectExpr("id AS visit_id", "'d' AS day", "'Lake' AS name", "-60 + (id % 200) * 0.5 AS lat", "(id div 200) * 1.5 AS lon", "id AS arrived_at")
    assert cluster.numbered_places(apart).where("name = concat('Lake (', visit_id + 1, ')') OR visit_id = 0").count() == 20_000
    assert cluster.numbered_per_day(apart).where("name = concat('Lake (', visit_id + 1, ')') OR visit_id = 0").count() == 20_000


def test_no_rows(spark):
    df = held(spark, [])
    assert cluster.numbered_per_day(df).count() == cluster.numbered_places(df).count() == 0
