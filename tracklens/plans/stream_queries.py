"""Streaming queries over the event table, each against its batch definition."""

from pyspark.sql import functions as F

from tracklens.config import EVENT_CONFIG as CFG
from tracklens.operators import targets as tg, ticks as tk
from tracklens.plans import sql as S
from tracklens.session import stage_table
from tracklens.sources.tables import as_reports, event_reports, load
from tracklens.streaming import jobs as J

QUERIES: dict = {}
ORACLE: dict = {}


def _reports(spark, folder):
    return as_reports(J.stream_table(spark, folder, "events")).withColumn("event_time", F.timestamp_micros("timestamp_us"))


def _delay(spark, folder):
    """The table's files may come in any order, so the replay waits for all of them."""
    return J.replay_delay(as_reports(load(spark, folder, "events")))


def str_01_carry_forward(spark, folder):
    delay = _delay(spark, folder)
    out = J.run_to_end(_reports(spark, folder), lambda r: J.carry_forward(r, CFG, delay), "carry")
    return out.select("airport_id", "aircraft_id", "k", "timestamp_us", "altitude_m")


QUERIES["str_01_carry_forward"] = str_01_carry_forward
_GRID = S.REPORTS + f""", x AS (SELECT *, unnest(range((timestamp_us + {S.STEP - 1}) // {S.STEP}, (timestamp_us + {S.STALE}) // {S.STEP} + 1)) AS k FROM reports),
 g AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY airport_id, aircraft_id, k ORDER BY timestamp_us DESC, source_file_id DESC) = 1)"""
ORACLE["str_01_carry_forward"] = f"WITH {_GRID} SELECT airport_id, aircraft_id, k, timestamp_us, altitude_m FROM g"


def _keyed_ticks(spark, folder):
    """Ticks from keyed state, up to the last report of each day as in batch; reports arrive in time order, ten minutes late at most."""
    J.use_durable_state(spark)
    reports = event_reports(spark, folder)
    bounds = tk.day_bounds(reports)
    anchored = stage_table(reports.join(bounds.drop("t1_us"), tk.DAY), "anchored")
    out = J.replay_in_order({"reports": anchored}, lambda s: J.keyed_ticks(s["reports"], CFG, "10 minutes"), "keyed")
    return out.join(bounds.select(*tk.DAY, "t1_us"), tk.DAY).filter(tk.tick_time(CFG) <= F.col("t1_us"))


def str_01_keyed_ticks(spark, folder):
    return _keyed_ticks(spark, folder).select("airport_id", "source_day", "k", "aircraft_id", "timestamp_us", "source_file_id", "altitude_m")


QUERIES["str_01_keyed_ticks"] = str_01_keyed_ticks
ORACLE["str_01_keyed_ticks"] = f"WITH {S.TICKS} SELECT airport_id, source_day, k, aircraft_id, timestamp_us, source_file_id, altitude_m FROM ticks"


def str_05_sliding_scenes(spark, folder):
    """Scenes of the last twelve ticks at every tick, from the ticks of keyed state: rows, aircraft and newest report of each."""
    recent = F.sequence(F.col("k"), F.col("k") + CFG.history_steps - 1)
    shown = _keyed_ticks(spark, folder).select(*tk.DAY, "aircraft_id", "timestamp_us", "t0_us", "t1_us", F.explode(recent).alias("k"))
    ended = shown.filter(tk.tick_time(CFG) <= F.col("t1_us"))
    per = ended.groupBy(*tk.TICK, "aircraft_id").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp_us").alias("newest"))
    return per.groupBy(*tk.TICK).agg(F.sum("n").alias("states"), F.count(F.lit(1)).alias("aircraft"), F.max("newest").alias("newest_us"))


QUERIES["str_05_sliding_scenes"] = str_05_sliding_scenes
ORACLE["str_05_sliding_scenes"] = f"""WITH {S.TICKS} SELECT g.airport_id, g.source_day, g.k, count(*) AS states, count(DISTINCT t.aircraft_id) AS aircraft, max(t.timestamp_us) AS newest_us
FROM grid g JOIN ticks t ON t.airport_id = g.airport_id AND t.source_day = g.source_day AND t.k > g.k - {S.HISTORY} AND t.k <= g.k GROUP BY ALL"""


def str_02_no_future_reports(spark, folder):
    """No tick shows a report newer than itself or older than the staleness bound."""
    delay = _delay(spark, folder)
    out = J.run_to_end(_reports(spark, folder), lambda r: J.carry_forward(r, CFG, delay), "causal")
    age = F.col("k") * CFG.step_us - F.col("timestamp_us")
    return out.groupBy("airport_id").agg(F.count(F.lit(1)).alias("ticks"), F.count_if(age < 0).alias("future"), F.count_if(age > CFG.stale_us).alias("stale"), F.max(age).alias("oldest_us"))


QUERIES["str_02_no_future_reports"] = str_02_no_future_reports
ORACLE["str_02_no_future_reports"] = f"WITH {_GRID} SELECT airport_id, count(*) AS ticks, CAST(0 AS BIGINT) AS future, CAST(0 AS BIGINT) AS stale, max(k * {S.STEP} - timestamp_us) AS oldest_us FROM g GROUP BY ALL"


def str_03_last_per_window(spark, folder):
    delay = _delay(spark, folder)
    out = J.run_to_end(_reports(spark, folder), lambda r: J.last_per_window(r, 1_800_000_000, delay), "last")
    return out.select("airport_id", "source_file_id", "aircraft_id", "window_us", "event_id")


QUERIES["str_03_last_per_window"] = str_03_last_per_window
ORACLE["str_03_last_per_window"] = f"""WITH {S.REPORTS} SELECT airport_id, source_file_id, aircraft_id, timestamp_us // 1800000000 * 1800000000 AS window_us, arg_max(event_id, (timestamp_us, event_id)) AS event_id FROM reports GROUP BY ALL"""


def str_04_activity(spark, folder):
    delay = _delay(spark, folder)
    return J.run_to_end(_reports(spark, folder), lambda r: J.activity(r, 3_600_000_000, delay), "activity")


QUERIES["str_04_activity"] = str_04_activity
ORACLE["str_04_activity"] = f"""WITH {S.REPORTS} SELECT airport_id, timestamp_us // 3600000000 * 3600000000 AS window_us, count(DISTINCT aircraft_id) AS aircraft, count(*) AS n_rows FROM reports GROUP BY ALL"""


def str_05_sliding_activity(spark, folder):
    delay = _delay(spark, folder)
    return J.run_to_end(_reports(spark, folder), lambda r: J.activity(r, 7_200_000_000, delay, 1_800_000_000), "sliding")


QUERIES["str_05_sliding_activity"] = str_05_sliding_activity
ORACLE["str_05_sliding_activity"] = f"""WITH {S.REPORTS}, w AS (SELECT *, (timestamp_us // 1800000000 - unnest(range(0, 4))) * 1800000000 AS window_us FROM reports)
SELECT airport_id, window_us, count(DISTINCT aircraft_id) AS aircraft, count(*) AS n_rows FROM w GROUP BY ALL"""


def str_06_order_violations(spark, folder):
    """Every eleventh event is shifted an hour back so that sources go out of order."""
    J.use_durable_state(spark)
    shifted = _reports(spark, folder).select(
        "source_file_id", F.floor(F.col("event_id") / 3).alias("ordinal"),
        (F.col("timestamp_us") - F.when(F.col("event_id") % 11 == 0, F.lit(3_600_000_000)).otherwise(F.lit(0))).alias("timestamp_us"),
    )
    return J.run_available(J.order_violations(shifted, 256), "order")


QUERIES["str_06_order_violations"] = str_06_order_violations
ORACLE["str_06_order_violations"] = f"""WITH {S.REPORTS}, s AS (SELECT source_file_id, event_id // 3 AS ordinal, timestamp_us - CASE WHEN event_id % 11 = 0 THEN 3600000000 ELSE 0 END AS timestamp_us FROM reports),
 l AS (SELECT *, lag(timestamp_us) OVER (PARTITION BY source_file_id ORDER BY ordinal) AS p FROM s) SELECT source_file_id, ordinal, timestamp_us FROM l WHERE timestamp_us < p"""


def str_07_resolve_keys(spark, folder):
    """Times cut to the hour so that natural keys repeat."""
    coarse = _reports(spark, folder).withColumn("timestamp_us", F.expr("timestamp_us div 3600000000 * 3600000000")).withColumn("event_time", F.timestamp_micros("timestamp_us"))
    delay = _delay(spark, folder)
    return J.run_to_end(coarse, lambda r: J.resolve_keys(r, delay), "resolve")


QUERIES["str_07_resolve_keys"] = str_07_resolve_keys
ORACLE["str_07_resolve_keys"] = f"""WITH {S.REPORTS}, c AS (SELECT *, timestamp_us // 3600000000 * 3600000000 AS h FROM reports)
SELECT airport_id, aircraft_id, h AS timestamp_us, count(*) AS group_size, arg_min(event_id, (CASE WHEN age_s IS NULL THEN 2 WHEN age_s >= 0 THEN 0 ELSE 1 END, coalesce(abs(age_s), 0), event_id)) AS event_id
FROM c GROUP BY ALL"""


def str_08_matured_days(spark, folder):
    delay = _delay(spark, folder)
    return J.run_to_end(_reports(spark, folder), lambda r: J.matured_days(r, delay), "matured")


QUERIES["str_08_matured_days"] = str_08_matured_days
ORACLE["str_08_matured_days"] = f"""WITH {S.REPORTS} SELECT airport_id, timestamp_us // 86400000000 * 86400000000 AS day_us, count(*) AS n_rows, max(timestamp_us) AS last_us FROM reports GROUP BY ALL"""


def label_inputs(spark, folder):
    """Scene cutoffs and active pairs as arrivals, each at the time of its tick.

    Cutoffs lie on ticks, so a pair's report times matter by the ticks they are newer than only: pairs alike in that are one row.
    """
    ticks = stage_table(tk.carry_forward(event_reports(spark, folder), CFG), "ticks")
    cutoffs = tk.eligible_cutoffs(ticks, CFG).select(*tk.TICK, F.col("cutoff_us").alias("timestamp_us"))
    shown = lambda c: F.col("t0_us") + (F.col("k") - F.col(c)) * F.lit(CFG.step_us)
    days = ticks.groupBy(*tk.DAY).agg(F.min("t0_us").alias("t0_us"))
    pairs = tg.pair_ages(ticks, CFG).join(days, tk.DAY).withColumns({"older_us": shown("age"), "older_prev": shown("age_prev")})
    return {
        "cutoffs": stage_table(cutoffs, "cutoffs"),
        "pairs": stage_table(pairs.select(*tk.TICK, "older_us", "older_prev", "n", tk.tick_time(CFG).alias("timestamp_us")), "pairs"),
    }


def str_08_label_maturity(spark, folder):
    out = J.replay_in_order(label_inputs(spark, folder), lambda s: J.matured_labels(s["cutoffs"], s["pairs"], CFG, "10 minutes"), "labels")
    return out.select(*tk.TICK, "cutoff_us", "horizon_us", "onset_events")


QUERIES["str_08_label_maturity"] = str_08_label_maturity
ORACLE["str_08_label_maturity"] = f"WITH {S.TARGETS} SELECT airport_id, source_day, k, cutoff_us, CAST(horizon_us AS BIGINT) AS horizon_us, CAST(onset_events AS BIGINT) AS onset_events FROM targets"


def str_09_state_runs(spark, folder):
    J.use_durable_state(spark)
    delay = _delay(spark, folder)
    value = F.floor(F.col("event_id") * 7 % 10 / 6).alias("value")
    valued = _reports(spark, folder).select("aircraft_id", "event_id", "timestamp_us", value, "event_time")
    return J.joined_runs(J.run_to_end(valued, lambda r: J.run_pieces(r, delay), "runs"))


QUERIES["str_09_state_runs"] = str_09_state_runs
ORACLE["str_09_state_runs"] = f"""WITH {S.REPORTS}, v AS (SELECT aircraft_id, event_id, timestamp_us, CASE WHEN event_id * 7 % 10 >= 6 THEN 1 ELSE 0 END AS value FROM reports),
 f AS (SELECT *, CASE WHEN lag(value) OVER w IS DISTINCT FROM value THEN 1 ELSE 0 END AS s FROM v WINDOW w AS (PARTITION BY aircraft_id ORDER BY timestamp_us, event_id)),
 r AS (SELECT *, sum(s) OVER (PARTITION BY aircraft_id ORDER BY timestamp_us, event_id) AS run FROM f), g AS (SELECT aircraft_id, run, CAST(any_value(value) AS BIGINT) AS value, min(timestamp_us) AS first_us, max(timestamp_us) AS last_us, count(*) AS n FROM r GROUP BY ALL)
SELECT aircraft_id, value, first_us, last_us, n FROM g"""
