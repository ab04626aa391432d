"""Ticks, labels and features against hand-made trajectories and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracklens import constants as K
from tracklens.config import SceneConfig
from tracklens.operators import features as ft, near, targets as tg, ticks as tk

SCHEMA = "airport_id string, source_file_id string, source_day string, aircraft_id string, timestamp_us long, lat_deg double, lon_deg double, altitude_m double, speed_mps double, heading_rad double"


def report(aircraft, second, lat, lon=-79.95, alt=500.0, speed=50.0, heading=0.0, source="S0"):
    return ("AP1", source, "2021-01-01", aircraft, second * 1_000_000, lat, lon, alt, speed, heading)


def hav(a, b):
    la, lb = math.radians(a[5]), math.radians(b[5])
    v = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[6] - a[6]) / 2) ** 2
    return 2 * K.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(v)))


def naive(rows, cfg):
    """The label definition, cutoff by cutoff and tick by tick."""
    step, stale = cfg.step_us, cfg.stale_us
    t0, t1 = min(r[4] for r in rows), max(r[4] for r in rows)

    def shown(t):
        best = {}
        for r in rows:
            if r[4] <= t and (r[3] not in best or (r[4], r[1]) > (best[r[3]][4], best[r[3]][1])):
                best[r[3]] = r
        return {a: r for a, r in best.items() if t - r[4] <= stale}

    def pairs(visible, keep):
        ids = sorted(a for a, r in visible.items() if keep(r))
        return [(visible[a], visible[b]) for i, a in enumerate(ids) for b in ids[i + 1:]]

    def active(found):
        return {(a[3], b[3]) for a, b in found if hav(a, b) < cfg.horizontal_m and abs(a[7] - b[7]) < cfg.vertical_m}

    out = {}
    k = cfg.history_steps - 1
    while t0 + k * step <= t1 - max(cfg.horizons_us):
        c = t0 + k * step
        now = shown(c)
        if len(now) >= cfg.min_aircraft:
            first = active(pairs(now, lambda r: True))
            for h in cfg.horizons_us:
                legacy = onset = 0
                seen_legacy, seen_onset, hs, vs = set(), set(first), [], []
                for t in range(c + step, c + h + 1, step):
                    found = pairs(shown(t), lambda r: r[4] > c)
                    hs += [hav(a, b) for a, b in found]
                    vs += [abs(a[7] - b[7]) for a, b in found]
                    current = active(found)
                    legacy += len(current - seen_legacy)
                    onset += len(current - seen_onset)
                    seen_legacy = seen_onset = current
                out[k, h] = (len(first), legacy, onset, min(hs, default=None), min(vs, default=None))
        k += 1
    return out


CFG = SceneConfig(history_steps=4, min_aircraft=2)


def labels(spark, rows, cfg=CFG):
    ticks = tk.carry_forward(spark.createDataFrame(rows, SCHEMA), cfg)
    return {(r.k, r.horizon_us): r for r in tg.scene_targets(ticks, cfg).collect()}


@pytest.mark.parametrize("seed,stale", [(1, 30), (2, 30), (3, 15), (4, 60), (5, 0)])
def test_labels_match_the_definition(spark, seed, stale):
    rng = random.Random(seed)
    cfg = SceneConfig(history_steps=3, min_aircraft=2, stale_us=stale * K.MICROS, horizons_us=(10 * K.MICROS, 30 * K.MICROS, 120 * K.MICROS), horizontal_m=4000.0, vertical_m=150.0)
    rows = list({(a, s): report(f"A{a}", s, 40.78 + rng.uniform(-0.05, 0.05), -79.95 + rng.uniform(-0.05, 0.05), rng.uniform(300, 900), source=f"S{rng.randint(0, 1)}")
                 for a in range(7) for s in rng.sample(range(0, 420), 22)}.values())
    got, want = labels(spark, rows, cfg), naive(rows, cfg)
    assert set(got) == set(want) and want
    for key, (active, legacy, onset, h, v) in want.items():
        row = got[key]
        assert (row.cutoff_active, row.legacy_events, row.onset_events) == (active, legacy, onset), key
        assert row.pair_observed == (h is not None)
        if h is None:
            assert row.min_horizontal_m is None and row.min_vertical_m is None
        else:
            assert row.min_horizontal_m == pytest.approx(h, rel=1e-6, abs=1e-3) and row.min_vertical_m == pytest.approx(v)


def steady(aircraft, lat_at, seconds):
    return [report(aircraft, s, lat_at(s)) for s in seconds]


def test_persistent_pair_is_not_an_onset(spark):
    rows = steady("A", lambda s: 40.0, range(0, 500, 10)) + steady("B", lambda s: 40.01, range(0, 500, 10))
    row = labels(spark, rows)[3, 30 * K.MICROS]
    assert (row.cutoff_active, row.legacy_events, row.onset_events) == (1, 1, 0)


def test_reentry_counts_again(spark):
    cfg = SceneConfig(history_steps=12, min_aircraft=2, horizons_us=(120 * K.MICROS,))
    rows = steady("A", lambda s: 40.0, range(0, 300, 10)) + steady("B", lambda s: 41.0 if s == 130 else 40.01, range(0, 300, 10))
    row = labels(spark, rows, cfg)[11, 120 * K.MICROS]
    assert (row.cutoff_active, row.legacy_events, row.onset_events) == (1, 2, 1)


def test_new_pair_is_an_onset(spark):
    rows = steady("A", lambda s: 40.0, range(0, 500, 10)) + steady("B", lambda s: 41.0 if s <= 30 else 40.01, range(0, 500, 10))
    row = labels(spark, rows)[3, 30 * K.MICROS]
    assert (row.cutoff_active, row.onset_events) == (0, 1)


def test_later_source_wins_equal_times(spark):
    rows = [report("A", 0, 40.0, source="S1"), report("A", 0, 41.0, source="S2"), report("B", 100, 40.0)]
    got = tk.carry_forward(spark.createDataFrame(rows, SCHEMA), CFG).filter("aircraft_id = 'A'").collect()
    assert {r.k: r.lat_deg for r in got} == {0: 41.0, 1: 41.0, 2: 41.0, 3: 41.0}


POINTS = [
    ("equator", lambda r: (r.uniform(-1, 1), r.uniform(-1, 1))), ("antimeridian", lambda r: (r.uniform(10, 12), r.choice([-1, 1]) * r.uniform(179, 180))),
    ("pole", lambda r: (r.uniform(88, 90), r.uniform(-180, 180))), ("south pole", lambda r: (-r.uniform(89.5, 90), r.uniform(-180, 180))),
]


@pytest.mark.parametrize("name,draw", POINTS)
def test_near_pairs_find_every_pair(spark, name, draw):
    rng = random.Random(name)
    points = [("g", f"P{i:03d}", *draw(rng)) for i in range(120)]
    full = [(None,) * 5 + (p[2], p[3]) for p in points]
    df = spark.createDataFrame(points, "g string, aircraft_id string, lat_deg double, lon_deg double")
    for radius in (20_000.0, 90_000.0):
        found = near.near_pairs(df, ["g"], radius, [], [near.term_distance(near.pair_term()).alias("d")], near.within(radius)).collect()
        want = {(points[i][1], points[j][1]) for i in range(120) for j in range(i + 1, 120) if hav(full[i], full[j]) < radius}
        got = [(r.a_id, r.b_id) for r in found]
        assert len(got) == len(set(got)) and set(got) == want and want
    closest = near.closest_pair(df, ["g"], "d").first().d
    assert closest == pytest.approx(min(hav(full[i], full[j]) for i in range(120) for j in range(i)), rel=1e-5)


def test_closest_gap(spark):
    rng = random.Random(3)
    rows = [(g, rng.uniform(0, 5000)) for g in "abc" for _ in range(40)] + [("d", 7.0), ("d", 7.0), ("e", 1.0)]
    got = {r.g: r.gap for r in near.closest_gap(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "gap", 100.0).collect()}
    for g in "abc":
        values = sorted(v for k, v in rows if k == g)
        assert got[g] == pytest.approx(min(b - a for a, b in zip(values, values[1:])))
    assert got["d"] == 0.0 and got["e"] is None


def scene(spark, rows, cfg=None):
    cfg = cfg or SceneConfig(history_steps=12, min_aircraft=2)
    ticks = tk.carry_forward(spark.createDataFrame(rows + [report("Z", 2000, 10.0)], SCHEMA), cfg)
    return ft.scene_aircraft(ticks, cfg), cfg


def test_converging_and_diverging_pairs(spark):
    for sign, closing, projected in ((1, 1, 1), (-1, 0, 0)):
        rows = []
        for s in range(0, 111, 10):
            gap = 0.12 - sign * 0.0004 * (s - 110)
            rows += [report("A", s, 40.78), report("B", s, 40.78 + gap)]
        aircraft, cfg = scene(spark, rows)
        row = ft.pair_features(ft.scene_pairs(aircraft), cfg).filter("k = 11").first()
        assert row.closing_pair_count_10nm == closing
        assert row.cpa_pair_count_300s == projected


def crowd(spark, n, seed=5):
    draw = random.Random(seed)
    rows = [report(f"A{i:03d}", s, 40.78 + draw.uniform(-0.3, 0.3), -79.95 + draw.uniform(-0.3, 0.3), draw.uniform(0, 3000.0), draw.uniform(40, 120), draw.uniform(-3, 3))
            for i in range(n) for s in (80, 110)]
    rows += [report("A000", 0, 40.78), report("B", 110, 40.78), report("B2", 110, 40.78)]
    return scene(spark, rows)


def test_tiles_meet_every_pair_once(spark):
    """However small the tiles, a scene's pairs are those of one tile, and a row holds members of two tiles only."""
    aircraft, cfg = crowd(spark, 60)
    ids = sorted(r.aircraft_id for r in aircraft.filter("k = 11").collect())
    want = sorted((a, b) for i, a in enumerate(ids) for b in ids[i + 1:])
    for tile in (1, 7, 1000):
        rows = ft.scene_pairs(aircraft, tile=tile).filter("k = 11").select("a.aircraft_id", F.col("b.aircraft_id").alias("b_id")).collect()
        assert sorted((r.aircraft_id, r.b_id) for r in rows) == want
    tiles = ft.scene_tiles(aircraft, ["aircraft_id"], 7).filter("k = 11")
    assert tiles.count() == 9 * 10 // 2 and tiles.agg(F.max(F.size("members"))).first()[0] < 40
    counts = ["observed_pair_count", "current_active_pair_count_5nm_1000ft", "closing_pair_count_10nm", "cpa_pair_count_300s"]
    one, many = ([tuple(r) for r in ft.pair_features(ft.scene_pairs(aircraft, tile=t), cfg).filter("k = 11").select(*counts).collect()] for t in (1000, 7))
    assert one == many and one[0][0] == len(want)
    with pytest.raises(ValueError):
        ft.scene_pairs(aircraft, tile=0)


def test_nearest_neighbours_of_tiled_scenes(spark):
    aircraft, _ = crowd(spark, 40)
    rows = aircraft.filter("k = 11").collect()
    where = {r.aircraft_id: (None,) * 5 + (r.lat_deg, r.lon_deg) for r in rows}
    got = {}
    for r in ft.nearest_neighbours(aircraft, 3, tile=7).filter("k = 11").orderBy("aircraft_id", "rank").collect():
        got.setdefault(r.aircraft_id, []).append(r.neighbour_id)
    assert got == {a: [b for _, b in sorted((hav(where[min(a, b)], where[max(a, b)]), b) for b in where if b != a)[:3]] for a in where}


def test_coverage_with_missing_prior(spark):
    rows = [report(a, s, 40.78 + i / 100) for i, a in enumerate(("A", "B")) for s in range(0, 111, 10)] + [report("C", 110, 40.9)]
    aircraft, _ = scene(spark, rows)
    row = ft.scene_coverage(aircraft).filter("k = 11").first()
    assert (row.current_pairs, row.cpa_eligible_pairs, row.missing_prior_pairs, row.degenerate_pairs) == (3, 1, 2, 1)


def test_stale_report_serves_as_current_and_prior(spark):
    rows = [report("A", 85, 40.78), report("B", 85, 40.8), report("A", 0, 40.7), report("B", 0, 40.9)]
    aircraft, _ = scene(spark, rows)
    row = ft.scene_coverage(aircraft).filter("k = 11").first()
    assert (row.aircraft_with_prior_30, row.same_report_aircraft) == (2, 2)


def test_cap_keeps_first_identifiers(spark):
    cfg = SceneConfig(history_steps=1, min_aircraft=2, max_aircraft=3)
    aircraft, _ = scene(spark, [report(f"A{i}", 0, 40.0 + i / 50) for i in range(6)], cfg)
    assert sorted(r.aircraft_id for r in aircraft.filter("k = 0").collect()) == ["A0", "A1", "A2"]


def test_terminal_volume(spark):
    from tracklens.operators.canonical import terminal_audit

    rows = [report("in", 0, 40.78), report("far", 0, 41.78), report("high", 0, 40.78, alt=5000.0), report("low", 0, 40.78, alt=-900.0)]
    volumes = spark.createDataFrame([("AP1", 40.78, -79.95, 0.0, 18_520.0, -150.0, 1_524.0)], "airport_id string, volume_lat double, volume_lon double, elevation_m double, radius_m double, floor_m double, ceiling_m double")
    accepted, audit = terminal_audit(spark.createDataFrame(rows, SCHEMA), volumes)
    row = audit.first()
    assert [r.aircraft_id for r in accepted.collect()] == ["in"]
    assert (row.input_reports, row.accepted_reports, row.outside_horizontal, row.outside_vertical) == (4, 1, 1, 2)


def test_configuration_is_checked():
    for bad in ({"step_us": 0}, {"stale_us": -1}, {"min_aircraft": 1}, {"horizons_us": ()}, {"horizontal_m": 0.0}):
        with pytest.raises(ValueError):
            SceneConfig(**bad)


def test_plans_avoid_nested_loops(spark, small):
    from tracklens.plans import registry

    for name in ("agg_31_reconstruction", "win_08_min_separations", "agg_26_cpa_features", "win_01_membership", "agg_08_duplicate_summary"):
        plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        for word in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
            assert word not in plan, (name, word)
    scan = registry.queries()["src_14_column_scan"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in scan and "l_extendedprice" not in scan
