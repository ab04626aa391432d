"""Streams whose state is bounded by what is live: keyed ticks and matured labels against their batch forms."""

import pytest
from pyspark.sql import functions as F

from tracklens.config import EVENT_CONFIG as CFG
from tracklens.operators import targets as tg, ticks as tk
from tracklens.plans import stream_queries as Q
from tracklens.sources.tables import event_reports
from tracklens.streaming import jobs as J


@pytest.fixture(scope="module")
def anchored(spark, small):
    J.use_durable_state(spark)
    reports = event_reports(spark, small)
    return reports.join(tk.day_bounds(reports).drop("t1_us"), tk.DAY)


START = 1_700_000_000_000_000  # an unset watermark is the epoch, so nothing may be as old as that


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_keyed_ticks_equal_the_batch_and_wait_for_the_watermark(spark, small, anchored):
    reports = event_reports(spark, small)
    columns = [*tk.TICK, "aircraft_id", "t0_us", "timestamp_us", "source_file_id", *tk.STATE]
    batch = tk.carry_forward(reports, CFG)
    job = lambda s: J.keyed_ticks(s["reports"], CFG, "10 minutes")
    whole = J.replay_in_order({"reports": anchored}, job, "whole", slices=2)
    ended = whole.join(tk.day_bounds(reports).select(*tk.DAY, "t1_us"), tk.DAY).filter(tk.tick_time(CFG) <= F.col("t1_us"))
    assert rows(ended.select(*columns)) == rows(batch.select(*columns))
    age = tk.tick_time(CFG) - F.col("timestamp_us")
    assert whole.filter((age < 0) | (age > CFG.stale_us)).count() == 0
    newest = reports.agg(F.max("timestamp_us")).first()[0]
    early = J.replay_in_order({"reports": anchored}, job, "early", slices=1, finish=False)
    assert early.count() and early.agg(F.max(tk.tick_time(CFG))).first()[0] <= newest - 600_000_000


def test_keyed_ticks_of_ties_and_late_rows_within_the_delay(spark):
    """Reports at one time: the greater source wins; one report that comes in the same slice before an older one changes nothing."""
    J.use_durable_state(spark)
    step = CFG.step_us
    times = [(a, START + t, s) for a, t, s in (("A", 0, "S1"), ("A", 0, "S2"), ("A", 2 * step + 5, "S1"), ("A", step, "S1"), ("B", step - 1, "S0"))]
    given = spark.createDataFrame([("X", "2024-01-01", a, START, t, s, *[float(t)] * 5) for a, t, s in times],
                                  "airport_id string, source_day string, aircraft_id string, t0_us long, timestamp_us long, source_file_id string, " + ", ".join(f"{c} double" for c in tk.STATE))
    got = J.replay_in_order({"r": given}, lambda s: J.keyed_ticks(s["r"], CFG, "10 minutes"), "ties", slices=1)
    want = []
    for aircraft in "AB":
        for k in range(12):
            seen = [(t, s) for a, t, s in times if a == aircraft and k * step - CFG.stale_us <= t - START <= k * step]
            want += [(aircraft, k, *max(seen))] if seen else []
    assert rows(got.select("aircraft_id", "k", "timestamp_us", "source_file_id")) == sorted(want)


def test_labels_mature_with_their_horizon(spark, small):
    inputs = Q.label_inputs(spark, small)
    job = lambda s: J.matured_labels(s["cutoffs"], s["pairs"], CFG, "10 minutes")
    got = J.replay_in_order(inputs, job, "labels", slices=2)
    batch = tg.scene_targets(tk.carry_forward(event_reports(spark, small), CFG), CFG, separations=False)
    columns = [*tk.TICK, "cutoff_us", "horizon_us", "onset_events"]
    assert rows(got.select(*columns)) == rows(batch.select(*columns))


def test_a_cutoff_without_pairs_matures_to_zero_and_not_before(spark):
    step, longest = CFG.step_us, max(CFG.horizons_us)
    cut = "airport_id string, source_day string, k long, timestamp_us long"
    cutoffs = spark.createDataFrame([("X", "d", k, START + k * step) for k in (0, 40)], cut)
    # Active at ticks 1 and 2 (one onset), again at 5; a pair that was active at the cutoff starts nothing.
    seen = [("p", 1, None), ("p", 2, START + step - 1), ("p", 5, None), ("q", 1, START - 1), ("q", 9, None)]
    pairs = spark.createDataFrame([("X", "d", k, n, n, START + k * step - 1, o, START + k * step) for n, k, o in seen],
                                  "airport_id string, source_day string, k long, a_id string, b_id string, older_us long, older_prev long, timestamp_us long")
    job = lambda s: J.matured_labels(s["cutoffs"], s["pairs"], CFG, "10 minutes")
    got = {(r.k, r.horizon_us): r.onset_events for r in J.replay_in_order({"cutoffs": cutoffs, "pairs": pairs}, job, "zero", slices=1).collect()}
    ends = [1, 5, 9]
    want = {(0, h): sum(1 for e in ends if e * step <= h) for h in CFG.horizons_us} | {(40, h): 0 for h in CFG.horizons_us}
    assert got == want
    # Pairs up to tick 9 only: the longest horizon has not passed, nothing is released.
    assert 9 * step < longest and J.replay_in_order({"cutoffs": cutoffs, "pairs": pairs}, job, "soon", slices=1, finish=False).count() == 0
