"""Future-onset labels: episode counts and minimum separations after each cutoff."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracklens.config import SceneConfig
from tracklens.operators import near, pairs
from tracklens.operators.ticks import DAY, TICK, age_class, eligible_cutoffs
from tracklens.session import stage_table


def with_previous(ticks: DataFrame) -> DataFrame:
    """Ticks with the aircraft's own state one tick earlier as struct `before`; null where it was not visible then."""
    track = Window.partitionBy(*DAY, "aircraft_id").orderBy("k")
    last = ticks.withColumn("before", F.lag(F.struct("k", "lat_deg", "lon_deg", "altitude_m", "timestamp_us")).over(track))
    return last.withColumn("before", F.when(F.col("before.k") == F.col("k") - 1, F.col("before").dropFields("k")))


def _paired(ticks: DataFrame, cfg: SceneConfig, previous: bool) -> tuple[DataFrame, list[str]]:
    """Ticks in the columns that pairs are made of: positions, report ages in whole steps, and the same one tick earlier."""
    source = with_previous(ticks) if previous else ticks.withColumn("before", F.lit(None).cast(STATE_BEFORE))
    age = lambda c: F.floor((F.col("t0_us") + F.col("k") * F.lit(cfg.step_us) - F.col(c)) / F.lit(cfg.step_us))
    made = {
        "age": age("timestamp_us"), "was_age": age("before.timestamp_us"), "was_us": F.col("before.timestamp_us"),
        "was_lat": F.col("before.lat_deg"), "was_lon": F.col("before.lon_deg"), "was_alt": F.col("before.altitude_m"),
    }
    return source.withColumns(made), ["lat_deg", "lon_deg", "altitude_m", "was_lat", "was_lon", "was_alt"]


STATE_BEFORE = "struct<lat_deg:double,lon_deg:double,altitude_m:double,timestamp_us:bigint>"


def active_pairs(ticks: DataFrame, cfg: SceneConfig, previous: bool = False) -> DataFrame:
    """Pairs inside both proximity limits at a tick, with the older of their two report times.

    `previous` adds `older_prev`, the same time one tick earlier where the pair was active there too. Both sides bring
    their own earlier state to the task that pairs them, so pairs are never shuffled to meet themselves.
    """
    rows, fields = _paired(ticks, cfg, previous)
    schema = "a_id string, b_id string, older_us long, t0_us long" + (", older_prev long" if previous else "")
    return pairs.mapped(rows, ["aircraft_id", *fields, "timestamp_us", "was_us", "t0_us"], pairs.found([(cfg.horizontal_m, cfg.vertical_m)], previous), schema)


def pair_ages(ticks: DataFrame, cfg: SceneConfig, settings: list[tuple[float, float]] | None = None, previous: bool = True, reach: bool = False) -> DataFrame:
    """How many pairs of a tick are inside the limits of each setting, by the age of their older report in whole steps.

    `age_prev` is the age, at this tick, of the older report the pair had one tick earlier, and null where it was not inside
    then. A cutoff lies on a tick, so these ages say all that a cutoff asks of a pair. `reach` adds a count of zero for a tick
    whose pairs are near enough but at other heights.
    """
    rows, fields = _paired(ticks, cfg, previous)
    limits = settings or [(cfg.horizontal_m, cfg.vertical_m)]
    parts = pairs.mapped(rows, ["aircraft_id", *fields, "age", "was_age"], pairs.counted(limits, previous, reach), "setting int, age long, age_prev long, n long")
    return parts.groupBy(*TICK, "setting", "age", "age_prev").agg(F.sum("n").alias("n"))


def onset_terms(cfg: SceneConfig) -> list[Column]:
    """Aggregates over the pair ages of a tick: episodes that start there, as seen from each of the nearest earlier cutoffs.

    A pair counts for a cutoff only when both reports are newer than it. Further back than the staleness
    bound that always holds, so one count serves every cutoff; only the first carry + 1 offsets differ.
    """
    edges = cfg.carry_steps + 1
    held = F.col("age_prev").isNotNull()
    number = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    terms = [F.sum("n").alias("active_n"), number(~held).alias("onset_far")]
    for d in range(1, edges + 1):
        usable = F.col("age") < d
        if d == 1:
            terms.append(number(usable & ~held).alias("onset_1"))
            terms.append(number(usable).alias("legacy_1"))
        else:
            before = F.coalesce(F.col("age_prev") < d, F.lit(False))
            terms.append(number(usable & ~before).alias(f"onset_{d}"))
    return terms


def episode_terms(ticks: DataFrame, cfg: SceneConfig) -> DataFrame:
    """Per tick: active pairs and episode starts. Pairs are counted in the task that tests them."""
    return pair_ages(ticks, cfg).groupBy(*TICK).agg(*onset_terms(cfg))


def separation_terms(ticks: DataFrame, cfg: SceneConfig) -> DataFrame:
    """Per tick and freshness class: closest horizontal and vertical separation of two aircraft."""
    edges = cfg.carry_steps + 1
    keys = TICK + ["d"]  # a report belongs to its own class and all later ones
    # Four passes read these rows; stored columns are also no literals, which would hide how the rows are dealt.
    classed = stage_table(ticks.withColumn("d", age_class(cfg)).select(*keys, "aircraft_id", "lat_deg", "lon_deg", "altitude_m"), "classed")
    horizontal = near.closest_pair(classed, keys, "h_m", nested=("d", edges))
    vertical = near.closest_gap(classed, keys, "altitude_m", "v_m", 100.0, nested=("d", edges))
    both = horizontal.join(vertical, keys)
    return both.groupBy(*TICK).agg(*[
        F.min(F.when(F.col("d") == d, F.col(name))).alias(f"{name}_{d}")
        for d in range(1, edges + 1) for name in ("h_m", "v_m")
    ])


def _span(first: int, last: int):
    return Window.partitionBy(*DAY).orderBy("k").rangeBetween(first, last)


def _summed(cfg: SceneConfig, steps: int, near_names: list[str]) -> Column:
    edges = cfg.carry_steps + 1
    parts = [F.coalesce(F.sum(near_names[d - 1]).over(_span(d, d)), F.lit(0)) for d in range(1, min(edges, steps) + 1)]
    if steps > edges:
        parts.append(F.coalesce(F.sum("onset_far").over(_span(edges + 1, steps)), F.lit(0)))
    return reduce(lambda a, b: a + b, parts)


def _least(parts: list[Column]) -> Column:
    return F.least(*parts) if len(parts) > 1 else parts[0]


def _minimum(cfg: SceneConfig, steps: int, name: str) -> Column:
    edges = cfg.carry_steps + 1
    parts = [F.min(f"{name}_{d}").over(_span(d, d)) for d in range(1, min(edges - 1, steps) + 1)]
    if steps >= edges:
        parts.append(F.min(f"{name}_{edges}").over(_span(edges, steps)))
    return _least(parts)


def scene_targets(ticks: DataFrame, cfg: SceneConfig, separations: bool = True, terms: DataFrame | None = None) -> DataFrame:
    """Long table of labels: one row per (scene, horizon). Pair work happens once per tick, not per cutoff.

    `terms` replaces the episode terms of the configuration, for studies that count several settings in one pair join.
    """
    edges = cfg.carry_steps + 1
    per_tick = ticks.groupBy(*TICK).agg(
        F.min("t0_us").alias("t0_us"), F.min("t1_us").alias("t1_us"), F.count(F.lit(1)).alias("n_aircraft"),
        *[F.sum((age_class(cfg) <= d).cast("long")).alias(f"fresh_{d}") for d in range(1, edges + 1)],
    )
    dense = per_tick.join(episode_terms(ticks, cfg) if terms is None else terms, TICK, "left")
    if separations:
        dense = dense.join(separation_terms(ticks, cfg), TICK, "left")
    onset = [f"onset_{d}" for d in range(1, edges + 1)]
    legacy = ["legacy_1"] + onset[1:]
    longest = max(cfg.horizons_us)
    per_horizon = []
    for horizon in sorted(set(cfg.horizons_us)):
        steps = cfg.horizon_steps(horizon)
        fresh = [F.coalesce(F.max(f"fresh_{d}").over(_span(d, d)), F.lit(0)) for d in range(1, min(edges - 1, steps) + 1)]
        if steps >= edges:
            fresh.append(F.coalesce(F.max(f"fresh_{edges}").over(_span(edges, steps)), F.lit(0)))
        observed = F.greatest(*fresh) if len(fresh) > 1 else fresh[0]
        fields = [
            F.lit(horizon // cfg.time_scale // 1_000_000).cast("long").alias("horizon_s"),
            F.lit(horizon).cast("long").alias("horizon_us"),
            _summed(cfg, steps, legacy).alias("legacy_events"),
            _summed(cfg, steps, onset).alias("onset_events"),
            (observed >= 2).alias("pair_observed"),
        ]
        if separations:
            fields += [_minimum(cfg, steps, "h_m").alias("min_horizontal_m"), _minimum(cfg, steps, "v_m").alias("min_vertical_m")]
        per_horizon.append(F.struct(*fields))
    cutoff = F.col("t0_us") + F.col("k") * F.lit(cfg.step_us)
    return (
        dense.withColumn("labels", F.array(*per_horizon))
        .withColumn("cutoff_us", cutoff)
        .filter(
            (F.col("k") >= cfg.history_steps - 1)
            & (F.col("cutoff_us") <= F.col("t1_us") - longest)
            & (F.col("n_aircraft") >= cfg.min_aircraft)
        )
        .select(*TICK, "cutoff_us", "n_aircraft", F.coalesce("active_n", F.lit(0)).alias("cutoff_active"), F.explode("labels").alias("label"))
        .select(*TICK, "cutoff_us", "n_aircraft", "cutoff_active", "label.*")
    )


def reconstruction_summary(targets: DataFrame) -> DataFrame:
    """Totals per horizon with the number of distinct days."""
    return targets.groupBy("horizon_s").agg(
        F.count(F.lit(1)).alias("scene_count"),
        F.countDistinct("source_day").alias("independent_days"),
        F.sum("legacy_events").alias("legacy_event_sum"),
        F.sum("onset_events").alias("future_onset_sum"),
        F.sum(F.col("legacy_events") - F.col("onset_events")).alias("legacy_minus_onset_sum"),
        F.sum("cutoff_active").alias("cutoff_active_pair_sum"),
        F.sum((~F.col("pair_observed")).cast("long")).alias("missing_future_pair_scenes"),
    )
