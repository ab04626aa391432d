"""Regular time grid per (airport, day): bounded carry-forward of the latest report to each tick."""

from pyspark.sql import DataFrame, Window, functions as F

from tracklens.config import SceneConfig

DAY = ["airport_id", "source_day"]
TICK = DAY + ["k"]
STATE = ["lat_deg", "lon_deg", "altitude_m", "speed_mps", "heading_rad"]


def finite_reports(reports: DataFrame) -> DataFrame:
    """Keep reports whose state is complete and finite and whose position is in its domain."""
    keep = F.lit(True)
    for name in STATE:
        keep = keep & F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(F.col(name)) < float("inf"))
    return reports.filter(keep & F.col("lat_deg").between(-90, 90) & F.col("lon_deg").between(-180, 180))


def day_bounds(reports: DataFrame) -> DataFrame:
    return reports.groupBy(*DAY).agg(
        F.min("timestamp_us").alias("t0_us"), F.max("timestamp_us").alias("t1_us")
    )


def carry_forward(reports: DataFrame, cfg: SceneConfig) -> DataFrame:
    """One row per aircraft visible at each tick: its latest report no older than the staleness bound.

    Ticks are t0 + k * step, anchored at the first report of the day. Reports that first become visible
    at the same tick are reduced to the latest one before the shuffle, so a chatty aircraft costs at most
    one row per tick. A report then covers the ticks up to its own expiry or its successor's first tick,
    whichever is earlier; those intervals are disjoint, so the expansion needs no second aggregation.
    """
    step, stale = cfg.step_us, cfg.stale_us
    placed = reports.join(day_bounds(reports), DAY).withColumn(
        "k_in", F.expr(f"(timestamp_us - t0_us + {step - 1}) div {step}")
    )
    latest = placed.groupBy(*DAY, "aircraft_id", "k_in").agg(
        F.max(F.struct("timestamp_us", "source_file_id", *STATE)).alias("r"),
        F.min("t0_us").alias("t0_us"),
        F.min("t1_us").alias("t1_us"),
    )
    per_aircraft = Window.partitionBy(*DAY, "aircraft_id").orderBy("k_in")
    covered = latest.withColumn("k_next", F.lead("k_in").over(per_aircraft)).withColumn(
        "k_out",
        F.least(
            F.expr(f"(r.timestamp_us + {stale} - t0_us) div {step}"),
            F.col("k_next") - 1,
            F.expr(f"(t1_us - t0_us) div {step}"),
        ),
    )
    return covered.filter("k_out >= k_in").select(
        *DAY, "aircraft_id", "t0_us", "t1_us",
        F.explode(F.sequence("k_in", "k_out")).alias("k"), "r.*",
    )


def tick_time(cfg: SceneConfig):
    return F.col("t0_us") + F.col("k") * F.lit(cfg.step_us)


def age_class(cfg: SceneConfig):
    """Smallest d >= 1 for which the report is newer than the tick d steps earlier."""
    return F.expr(f"(t0_us + k * {cfg.step_us} - timestamp_us) div {cfg.step_us} + 1")


def eligible_cutoffs(ticks: DataFrame, cfg: SceneConfig) -> DataFrame:
    """Ticks with a full history, a full longest horizon and enough aircraft."""
    counts = ticks.groupBy(*TICK).agg(
        F.count(F.lit(1)).alias("n_aircraft"), F.min("t0_us").alias("t0_us"), F.min("t1_us").alias("t1_us")
    )
    longest = max(cfg.horizons_us)
    return (
        counts.withColumn("cutoff_us", tick_time(cfg))
        .filter(
            (F.col("k") >= cfg.history_steps - 1)
            & (F.col("cutoff_us") <= F.col("t1_us") - longest)
            & (F.col("n_aircraft") >= cfg.min_aircraft)
        )
        .select(*TICK, "cutoff_us", "n_aircraft", "t0_us")
    )


def capped_current(ticks: DataFrame, cutoffs: DataFrame, cfg: SceneConfig) -> DataFrame:
    """The reports a scene shows at its cutoff: all, or the first `max_aircraft` by identifier where a cap is set."""
    if cfg.max_aircraft is None:
        return ticks.drop("t0_us", "t1_us").join(cutoffs, TICK)
    first = Window.partitionBy(*TICK).orderBy("aircraft_id")
    kept = (
        ticks.withColumn("position", F.row_number().over(first))
        .filter(F.col("position") <= cfg.max_aircraft)
        .drop("position", "t0_us", "t1_us")
    )
    return kept.join(cutoffs, TICK)
