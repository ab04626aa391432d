"""Scene, pair and label queries over the event table."""

from pyspark.sql import functions as F

from tracklens.config import EVENT_CONFIG as CFG
from tracklens.operators import near, targets as tg, ticks as tk
from tracklens.plans import sql as S
from tracklens.session import stage_table
from tracklens.sources.tables import event_reports

QUERIES: dict = {}
ORACLE: dict = {}


def _ticks(spark, folder):
    return tk.carry_forward(tk.finite_reports(event_reports(spark, folder)), CFG)


def join_01_carry_forward(spark, folder):
    return _ticks(spark, folder).select(
        "airport_id", "source_day", "k", "aircraft_id", "timestamp_us", "source_file_id",
        F.round("lat_deg", 6).alias("lat_deg"), "altitude_m",
    )


QUERIES["join_01_carry_forward"] = join_01_carry_forward
ORACLE["join_01_carry_forward"] = f"""WITH {S.TICKS}
SELECT airport_id, source_day, k, aircraft_id, timestamp_us, source_file_id, round(lat_deg, 6) AS lat_deg, altitude_m FROM ticks"""


def join_02_pair_opportunities(spark, folder):
    counts = _ticks(spark, folder).groupBy(*tk.TICK).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("airport_id", "source_day").agg(
        F.count(F.lit(1)).alias("ticks"), F.max("n").alias("max_aircraft"),
        F.sum(F.expr("n * (n - 1) div 2")).alias("pair_ticks"),
    )


QUERIES["join_02_pair_opportunities"] = join_02_pair_opportunities
ORACLE["join_02_pair_opportunities"] = f"""WITH {S.PAIRS}, p AS (SELECT source_day, k, count(*) AS np FROM pairs GROUP BY ALL)
SELECT t.airport_id, t.source_day, count(*) AS ticks, max(n) AS max_aircraft, CAST(coalesce(sum(np), 0) AS BIGINT) AS pair_ticks
FROM (SELECT airport_id, source_day, k, count(*) AS n FROM ticks GROUP BY ALL) t LEFT JOIN p ON p.source_day = t.source_day AND p.k = t.k GROUP BY ALL"""


def join_03_active_pairs(spark, folder):
    return tg.active_pairs(_ticks(spark, folder), CFG).select(*tk.TICK, "a_id", "b_id", "older_us")


QUERIES["join_03_active_pairs"] = join_03_active_pairs
ORACLE["join_03_active_pairs"] = f"""WITH {S.PAIRS} SELECT airport_id, source_day, k, a_id, b_id, older_us FROM act"""


def win_07_onset_targets(spark, folder):
    labels = tg.scene_targets(stage_table(_ticks(spark, folder), "ticks"), CFG, separations=False)
    return labels.select(*tk.TICK, "cutoff_us", "horizon_s", "n_aircraft", "cutoff_active", "legacy_events", "onset_events")


QUERIES["win_07_onset_targets"] = win_07_onset_targets
ORACLE["win_07_onset_targets"] = f"""WITH {S.TARGETS}
SELECT airport_id, source_day, k, cutoff_us, horizon_s, n_aircraft, CAST(cutoff_active AS BIGINT) AS cutoff_active,
 CAST(legacy_events AS BIGINT) AS legacy_events, CAST(onset_events AS BIGINT) AS onset_events FROM targets"""


def win_08_min_separations(spark, folder):
    labels = tg.scene_targets(stage_table(_ticks(spark, folder), "ticks"), CFG)
    return labels.select(
        *tk.TICK, "horizon_s", F.round("min_horizontal_m", 3).alias("min_horizontal_m"),
        F.round("min_vertical_m", 3).alias("min_vertical_m"),
    )


QUERIES["win_08_min_separations"] = win_08_min_separations
ORACLE["win_08_min_separations"] = f"""WITH {S.TARGETS}
SELECT airport_id, source_day, k, horizon_s, round(h_m, 3) AS min_horizontal_m, round(v_m, 3) AS min_vertical_m FROM targets"""


def agg_31_reconstruction(spark, folder):
    return tg.reconstruction_summary(tg.scene_targets(stage_table(_ticks(spark, folder), "ticks"), CFG, separations=False))


QUERIES["agg_31_reconstruction"] = agg_31_reconstruction
ORACLE["agg_31_reconstruction"] = f"""WITH {S.TARGETS}
SELECT horizon_s, count(*) AS scene_count, count(DISTINCT source_day) AS independent_days,
 CAST(sum(legacy_events) AS BIGINT) AS legacy_event_sum, CAST(sum(onset_events) AS BIGINT) AS future_onset_sum,
 CAST(sum(legacy_events - onset_events) AS BIGINT) AS legacy_minus_onset_sum,
 CAST(sum(cutoff_active) AS BIGINT) AS cutoff_active_pair_sum, count(*) FILTER (WHERE h_m IS NULL) AS missing_future_pair_scenes
FROM targets GROUP BY ALL"""
