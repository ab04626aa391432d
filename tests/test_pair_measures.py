"""Pair features measured in blocks equal those of pairs as rows, for tiles, missing states and last-digit ties."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tracklens.config import SceneConfig
from tracklens.operators import features as ft, pairs as P
from tracklens.plans import registry

CFG = SceneConfig(history_steps=1, min_aircraft=2)
SCHEMA = "airport_id string, source_day string, k long, aircraft_id string, lat_deg double, lon_deg double, heading_rad double, " + ", ".join(f"{c} double" for c in P.STATES)


def aircraft(spark):
    r = random.Random(3)
    rows = []
    for k, n in ((0, 150), (1, 2), (2, 1)):
        for i in range(n):
            x, y, z = r.randrange(-9, 10) * 1113.2, r.randrange(-9, 10) * 1113.2, r.randrange(20) * 100.0
            seen = r.random() < 0.8 or k == 1
            moved = r.random() < 0.7
            nx, ny = (r.randrange(-9, 10) * 1113.2, r.randrange(-9, 10) * 1113.2) if moved else (x, y)
            state = (nx, ny, (x - nx) / 30, (y - ny) / 30, r.uniform(-5, 5)) if seen else (None,) * 5
            if i == 7:
                x, y, z, state = None, None, None, (None,) * 5
            rows.append(("X", "d", k, f"A{i:03}", 40 + (y or 0) / 111320, -80 + (x or 0) / 85000, 0.0, x, y, z, *state))
    return spark.createDataFrame(rows, SCHEMA).withColumn("n_aircraft", F.count(F.lit(1)).over(Window.partitionBy("k")))


@pytest.mark.parametrize("tile", [P.TILE, 40])
def test_measures_equal_pairs_as_rows(spark, monkeypatch, tile):
    monkeypatch.setattr(P.tiled, "__defaults__", (tile,))
    monkeypatch.setattr(P.mapped, "__defaults__", (False, tile))
    df = aircraft(spark).cache()
    columns = ft.ladder_columns(CFG)
    want = {r.k: r for r in ft.pair_features(ft.scene_pairs(df), CFG).collect()}
    got = {r.k: r for r in ft.pair_measures(df, CFG, columns).collect()}
    assert set(got) == set(want) == {0, 1}
    for k in want:
        for c in columns:
            assert got[k][c] == pytest.approx(want[k][c], rel=1e-9, abs=1e-6), (k, c)
            if "count" in c:
                assert got[k][c] == want[k][c], (k, c)


def test_last_digit_is_the_jvms(spark):
    r = np.random.default_rng(1)
    x, y = r.uniform(-2e4, 2e4, 20000), r.uniform(-2e4, 2e4, 20000)
    y[:50] = 0.0
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    want = [v[0] for v in df.select(F.hypot("x", "y")).collect()]
    assert (P.java_hypot(x, y) == np.array(want)).all()


def test_features_do_not_make_pairs_rows(spark, small):
    for name in ("agg_25_pair_features", "agg_27_baseline_features", "agg_28_task_indicators"):
        plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "members" not in plan, name
