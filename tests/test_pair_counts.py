"""Pairs are counted where they are joined: nothing that grows with the pairs of a scene is shuffled."""

from pyspark.sql import Window, functions as F

from tracklens.config import EVENT_CONFIG as CFG
from tracklens.operators import targets as tg, ticks as tk
from tracklens.plans import registry
from tracklens.sources.tables import event_reports


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_pairs_are_not_shuffled(spark, small):
    for name in ("agg_31_reconstruction", "win_07_onset_targets", "smp_05_stratified_sample", "set_03_new_pairs"):
        found = exchanges(registry.queries()[name](spark, small))
        assert found and not any("a_id" in line for line in found), name


def test_earlier_state_of_a_pair_equals_its_own_earlier_row(spark, small):
    ticks = tk.carry_forward(event_reports(spark, small), CFG)
    track = Window.partitionBy(*tk.DAY, "a_id", "b_id").orderBy("k")
    held = F.lag("k").over(track) == F.col("k") - 1
    want = tg.active_pairs(ticks, CFG).withColumn("older_prev", F.when(held, F.lag("older_us").over(track)))
    rows = lambda df: sorted((tuple(r) for r in df.select(*tk.TICK, "a_id", "b_id", "older_us", "older_prev").collect()), key=str)
    assert rows(tg.active_pairs(ticks, CFG, previous=True)) == rows(want)
    assert want.filter("older_prev IS NOT NULL").count()
