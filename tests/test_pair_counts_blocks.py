"""Pairs counted in blocks equal pairs listed one by one, whatever the tiles, repeats and missing values."""

import random

import pytest
from pyspark.sql import functions as F

from tracklens.config import SceneConfig
from tracklens.functions import geo
from tracklens.operators import pairs as P, targets as tg, ticks as tk
from tracklens.plans import registry

CFG = SceneConfig()
SCHEMA = "airport_id string, source_day string, k long, aircraft_id string, t0_us long, timestamp_us long, source_file_id string, lat_deg double, lon_deg double, altitude_m double"


def ticks(spark, n=60, steps=4):
    r = random.Random(5)
    rows = []
    for k in range(steps):
        for i in r.sample(range(n), n - 7):
            # Heights on a grid of the limit, so that some differ by exactly the limit.
            rows.append(("X", "d", k, f"A{i:03}", 0, k * CFG.step_us - r.randrange(CFG.stale_us), "S", 40 + r.randrange(30) / 100, -80 + r.randrange(30) / 100, r.randrange(6) * 304.8))
    rows += [("X", "d", 1, "lost", 0, CFG.step_us, "S", None, -80.0, 0.0), ("X", "d", 1, "high", 0, CFG.step_us, "S", 40.0, -80.0, None), ("X", "d", 1, None, 0, CFG.step_us, "S", 40.0, -80.0, 0.0)]
    return spark.createDataFrame(rows, SCHEMA)


def listed(spark, df, h, v):
    p, q = df.alias("p"), df.alias("q")
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in tk.TICK]
    met = p.join(q, [*same, F.col("p.aircraft_id") < F.col("q.aircraft_id")])
    inside = (geo.haversine_m(F.col("p.lat_deg"), F.col("p.lon_deg"), F.col("q.lat_deg"), F.col("q.lon_deg")) < h) & (F.abs(F.col("p.altitude_m") - F.col("q.altitude_m")) < v)
    return {(r.k, r.a, r.b): r.older for r in met.filter(inside).select("p.k", F.col("p.aircraft_id").alias("a"), F.col("q.aircraft_id").alias("b"), F.least("p.timestamp_us", "q.timestamp_us").alias("older")).collect()}


@pytest.mark.parametrize("tile", [P.TILE, 9])
def test_counts_equal_listed_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(P.tiled, "__defaults__", (tile,))
    monkeypatch.setattr(P.mapped, "__defaults__", (False, tile))
    df = ticks(spark).cache()
    settings = [(9260.0, 304.8), (5000.0, 700.0)]
    got = {}
    for r in tg.pair_ages(df, CFG, settings).collect():
        got[r.setting, r.k, r.age, r.age_prev] = r.n
    want = {}
    for s, (h, v) in enumerate(settings):
        older = listed(spark, df, h, v)
        for (k, a, b), us in older.items():
            was = older.get((k - 1, a, b))
            age = lambda t: (k * CFG.step_us - t) // CFG.step_us
            key = (s, k, age(us), None if was is None else age(was))
            want[key] = want.get(key, 0) + 1
    assert got == want and any(w is not None for *_, w in want)
    assert {(r.k, r.a_id, r.b_id): r.older_us for r in tg.active_pairs(df, CFG).collect()} == listed(spark, df, CFG.horizontal_m, CFG.vertical_m)


def test_pairs_at_other_heights_leave_a_zero(spark):
    rows = [("X", "d", 0, a, 0, 0, "S", 40.0, -80.0, h) for a, h in (("a", 0.0), ("b", 5000.0))] + [("Y", "d", 0, a, 0, 0, "S", lat, -80.0, 0.0) for a, lat in (("a", 40.0), ("b", 50.0))]
    got = tg.pair_ages(spark.createDataFrame(rows, SCHEMA), CFG, previous=False, reach=True).collect()
    assert [(r.airport_id, r.n) for r in got] == [("X", 0)]


def test_pairs_do_not_become_rows_to_be_counted(spark, small):
    for name in ("agg_31_reconstruction", "win_07_onset_targets", "smp_05_stratified_sample", "set_05_ofat_settings"):
        plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "SortMergeJoin [key_" not in plan, name
