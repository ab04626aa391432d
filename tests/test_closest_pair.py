"""Closest pairs by a sweep in latitude order: exact, with few points left for the cell join."""

import math
import random

from tracklens.operators import near


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    t = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(t)))


def groups():
    rng = random.Random(11)
    yield "spread", [(40.6 + rng.random() / 5, -80 + rng.random() / 4) for _ in range(400)]
    line = [(10.0 + i * 1e-9, i * 0.01) for i in range(60)]  # one latitude: the close pair is far apart in latitude order
    yield "line", line + [(10.0 + 61e-9, 0.3001)]
    yield "edge", [(0.0499999, 5.0), (0.03, 9.0), (0.0500001, 5.0), (0.07, 1.0)]
    yield "far", [(0.01, 0.0), (0.26, 0.0), (5.0, 0.0)]
    yield "date line", [(1.0, 179.9999), (1.00001, -179.9999), (1.000005, 0.0)]
    yield "same", [(3.0, 3.0), (3.0, 3.0), (4.0, 4.0)]


def test_sweep_equals_brute_force_and_leaves_few_points_to_cells(spark, monkeypatch):
    seen, whole = [], near.near_pairs
    monkeypatch.setattr(near, "near_pairs", lambda points, *a, **k: seen.append(points) or whole(points, *a, **k))
    data = dict(groups())
    rows = [(g, f"A{i}", p, q) for g, points in data.items() for i, (p, q) in enumerate(points)]
    got = {r.g: r.d for r in near.closest_pair(spark.createDataFrame(rows, "g string, aircraft_id string, lat_deg double, lon_deg double"), ["g"], "d").collect()}
    for g, points in data.items():
        want = min(metres(a, b) for i, a in enumerate(points) for b in points[:i])
        assert abs(got[g] - want) < 1e-6, g
    assert seen[0].filter("g = 'spread'").count() < 40  # before: all 400


def test_nested_groups_equal_their_copies(spark):
    rng = random.Random(3)
    rows = [(f"g{i % 3}", f"A{i}", 40 + rng.random() / 5, rng.random(), float(rng.randrange(9000)), rng.randint(1, 4)) for i in range(150)]
    schema = "g string, aircraft_id string, lat_deg double, lon_deg double, altitude_m double, d long"
    points = spark.createDataFrame(rows, schema)
    copies = spark.createDataFrame([(*r[:5], d) for r in rows for d in range(r[5], 5)], schema)
    for make in (lambda df, **k: near.closest_pair(df, ["g", "d"], "out", **k), lambda df, **k: near.closest_gap(df, ["g", "d"], "altitude_m", "out", 100.0, **k)):
        assert sorted(map(tuple, make(points, nested=("d", 4)).collect())) == sorted(map(tuple, make(copies).collect()))
