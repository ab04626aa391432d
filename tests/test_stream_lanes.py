"""State keys of streams are lanes of aircraft, so their number does not grow with the aircraft."""

from pyspark.sql import functions as F

from tracklens.config import EVENT_CONFIG as CFG
from tracklens.operators import ticks as tk
from tracklens.plans import stream_queries as Q
from tracklens.sources.tables import event_reports
from tracklens.streaming import jobs as J


def test_one_key_serves_many_aircraft(spark, small):
    """All aircraft of a day in one lane: ticks are those of the batch."""
    J.use_durable_state(spark)
    reports = event_reports(spark, small)
    bounds = tk.day_bounds(reports)
    anchored = reports.join(bounds.drop("t1_us"), tk.DAY)
    got = J.replay_in_order({"r": anchored}, lambda s: J.keyed_ticks(s["r"], CFG, "10 minutes", lanes=1), "lane", slices=1)
    ended = got.join(bounds.select(*tk.DAY, "t1_us"), tk.DAY).filter(tk.tick_time(CFG) <= F.col("t1_us"))
    rows = lambda df: sorted(map(tuple, df.select(*tk.TICK, "aircraft_id", "timestamp_us", "source_file_id", *tk.STATE).collect()))
    assert rows(ended) == rows(tk.carry_forward(reports, CFG))


def test_label_pairs_are_counted_before_they_stream(spark, small):
    """Rows of a tick are its few report-age classes, whatever the number of its pairs."""
    pairs = Q.label_inputs(spark, small)["pairs"]
    classes = (CFG.carry_steps + 1) * (CFG.carry_steps + 2)
    assert pairs.groupBy(*tk.TICK).count().agg(F.max("count")).first()[0] <= classes
    assert "a_id" not in pairs.columns and pairs.agg(F.sum("n")).first()[0] > 0
