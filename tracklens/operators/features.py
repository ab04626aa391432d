"""Causal scene features: current state, pair geometry, closest approach, task indicators, history controls."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracklens import constants as K
from tracklens.config import SceneConfig
from tracklens.functions import geo
from tracklens.operators import near, pairs as P
from tracklens.operators.ticks import DAY, STATE, TICK, capped_current, eligible_cutoffs
from tracklens.session import stage_table

NOMINAL = lambda cfg, h: h // cfg.time_scale // K.MICROS


def _prior(cfg: SceneConfig, limits: tuple[int, int, int]) -> Column:
    """The shown report whose age is closest to the preferred one; ties go to the older report."""
    low, high, preferred = (F.lit(v) for v in limits)
    cutoff = F.col("t0_us") + F.col("k") * F.lit(cfg.step_us)
    usable = F.filter("shown", lambda r: (cutoff - r["timestamp_us"]).between(low, high))
    scored = F.transform(usable, lambda r: F.struct(
        F.abs(cutoff - r["timestamp_us"] - preferred).alias("gap"), *[r[c].alias(c) for c in ["timestamp_us"] + STATE]
    ))
    return F.array_min(scored)


def scene_aircraft(ticks: DataFrame, cfg: SceneConfig) -> DataFrame:
    """Aircraft of every scene with their current report and two earlier states, in local metres.

    Only the last few snapshots can hold a usable earlier state, so the frame is a handful of rows.
    """
    back = min(cfg.history_steps - 1, cfg.prior_far_us[1] // cfg.step_us)
    frame = Window.partitionBy(*DAY, "aircraft_id").orderBy("k").rangeBetween(-back, 0)
    with_prior = (
        ticks.withColumn("shown", F.collect_list(F.struct("timestamp_us", *STATE)).over(frame))
        .withColumn("near", _prior(cfg, cfg.prior_near_us))
        .withColumn("far", _prior(cfg, cfg.prior_far_us))
        .drop("shown")
    )
    kept = capped_current(with_prior, eligible_cutoffs(ticks, cfg), cfg)
    lat0 = lon0 = F.lit(None).cast("double")
    for airport, (lat, lon) in cfg.centers.items():
        lat0 = F.when(F.col("airport_id") == airport, F.lit(lat)).otherwise(lat0)
        lon0 = F.when(F.col("airport_id") == airport, F.lit(lon)).otherwise(lon0)
    located = kept.withColumn("lat0", lat0).withColumn("lon0", lon0)

    def xy(prefix: str) -> list[Column]:
        return [
            geo.plane_x(F.col(f"{prefix}lon_deg"), F.col("lat0"), F.col("lon0")),
            geo.plane_y(F.col(f"{prefix}lat_deg"), F.col("lat0")),
        ]

    x, y = xy("")
    nx, ny = xy("near.")
    fx, fy = xy("far.")
    elapsed = F.greatest((F.col("timestamp_us") - F.col("near.timestamp_us")) / F.lit(1e6), F.lit(1.0))
    elapsed = F.when(F.col("near").isNotNull(), elapsed)
    return located.withColumns({"x": x, "y": y, "nx": nx, "ny": ny, "fx": fx, "fy": fy}).withColumns({
        "vx": (F.col("x") - F.col("nx")) / elapsed,
        "vy": (F.col("y") - F.col("ny")) / elapsed,
        "vz": (F.col("altitude_m") - F.col("near.altitude_m")) / elapsed,
    })


_PAIR_FIELDS = ["aircraft_id", "lat_deg", "lon_deg", "altitude_m", "heading_rad", "x", "y", "nx", "ny", "vx", "vy", "vz"]
TILE_AIRCRAFT = 256
TILE_COPIES = 4
TILE_MOST = 16_384


def tile_count(tile: int | None) -> Column:
    """Tiles of a scene: of `tile` aircraft where given, else of 256 up to four tiles, which then grow to 16,384 aircraft."""
    if tile is not None and tile <= 0:
        raise ValueError("tile must be positive")
    of = lambda size: F.ceil(F.col("n_aircraft") / F.lit(size)).cast("int")
    return of(tile) if tile else F.least(of(TILE_AIRCRAFT), F.greatest(F.lit(TILE_COPIES), of(TILE_MOST)))


def scene_tiles(aircraft: DataFrame, fields: list[str], tile: int | None = None) -> DataFrame:
    """One row for each two tiles of a scene, with the members of both in identifier order.

    An aircraft's identifier decides its tile, so a row holds about two tiles, and the rows of one scene go to
    different tasks. An aircraft is sent once for each tile of its scene: at most four times up to 65,536 aircraft, so what
    travels grows with the aircraft and not with their pairs. `n_aircraft` is the scene's own count.
    """
    tiles = tile_count(tile)
    placed = aircraft.withColumn("tiles_", tiles).withColumn("tile", F.pmod(F.xxhash64("aircraft_id"), F.col("tiles_")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("tiles_") - 1), lambda j: F.struct(
        F.least(j, F.col("tile")).alias("low"), F.greatest(j, F.col("tile")).alias("high")))
    sent = placed.select(*TICK, "tile", *fields, F.explode(met).alias("t_"))
    return (
        sent.select(*TICK, F.col("t_.low").alias("low"), F.col("t_.high").alias("high"), F.struct(*fields, "tile").alias("m_"))
        .groupBy(*TICK, "low", "high").agg(F.sort_array(F.collect_list("m_")).alias("members"))
    )


def scene_pairs(aircraft: DataFrame, extra: list[str] | None = None, tile: int | None = None) -> DataFrame:
    """Unordered pairs of a scene, each once, expanded inside the rows of `scene_tiles` and never shuffled.

    Two aircraft of one tile meet in that tile's own row, others in the row of their two tiles. Aggregates by scene
    are reduced in the task that expands a row; one partial row for each two tiles travels.
    """
    fields = _PAIR_FIELDS + (extra or [])
    rows = scene_tiles(aircraft, fields, tile)
    left = rows.select(*TICK, (F.col("low") == F.col("high")).alias("own"), "members", F.posexplode("members").alias("i", "a"))
    pairs = left.select(*TICK, "own", "a", F.explode(F.slice("members", F.col("i") + 2, F.size("members"))).alias("b"))
    return pairs.filter(F.col("own") | (F.col("a.tile") != F.col("b.tile"))).drop("own")


def _geometry(pairs: DataFrame) -> DataFrame:
    rel = {n: F.col(f"a.{n}") - F.col(f"b.{n}") for n in ("x", "y", "nx", "ny", "vx", "vy", "vz")}
    return pairs.withColumns({
        "rx": rel["x"], "ry": rel["y"], "rz": F.col("a.altitude_m") - F.col("b.altitude_m"),
        "vx": rel["vx"], "vy": rel["vy"], "vz": rel["vz"],
        "was": F.hypot(rel["nx"], rel["ny"]),
    }).withColumn("h", F.hypot("rx", "ry")).withColumn("eligible", F.col("vx").isNotNull())


def _close(h: Column, v: Column) -> Column:
    return (h < K.PROXIMITY_HORIZONTAL_M) & (v < K.PROXIMITY_VERTICAL_M)


def pair_features(pairs: DataFrame, cfg: SceneConfig) -> DataFrame:
    """Pairwise additions and constant-velocity closest-approach additions per scene."""
    g = _geometry(pairs)
    terms = [
        F.count(F.lit(1)).alias("observed_pair_count"),
        F.count_if(_close(F.col("h"), F.abs("rz"))).alias("current_active_pair_count_5nm_1000ft"),
        F.count_if((F.col("h") < K.CLOSING_RANGE_M) & (F.col("was") > F.col("h"))).alias("closing_pair_count_10nm"),
        F.coalesce(F.avg("h"), F.lit(K.EMPTY_DISTANCE_M)).alias("mean_pair_horizontal_distance_m"),
        F.coalesce(F.min(F.abs("rz")), F.lit(K.EMPTY_DISTANCE_M)).alias("minimum_pair_vertical_separation_m"),
        F.min("h").alias("current_min_pair_distance_m"),
    ]
    for horizon in sorted(set(cfg.horizons_us)):
        name = f"{NOMINAL(cfg, horizon)}s"
        t = geo.cpa_seconds(F.col("rx"), F.col("ry"), F.col("vx"), F.col("vy"), horizon / K.MICROS)
        at = F.when(F.col("eligible"), t)
        g = g.withColumn(f"t_{name}", at).withColumns({
            f"ph_{name}": F.hypot(F.col("rx") + F.col("vx") * F.col(f"t_{name}"), F.col("ry") + F.col("vy") * F.col(f"t_{name}")),
            f"pv_{name}": F.abs(F.col("rz") + F.col("vz") * F.col(f"t_{name}")),
        })
        terms += [
            F.count_if(_close(F.col(f"ph_{name}"), F.col(f"pv_{name}"))).alias(f"cpa_pair_count_{name}"),
            F.coalesce(F.min(f"ph_{name}"), F.lit(K.EMPTY_DISTANCE_M)).alias(f"minimum_projected_horizontal_cpa_m_{name}"),
            F.coalesce(F.min(f"pv_{name}"), F.lit(K.EMPTY_DISTANCE_M)).alias(f"minimum_projected_vertical_separation_m_{name}"),
        ]
    return g.groupBy(*TICK).agg(*terms)


def pair_measures(aircraft: DataFrame, cfg: SceneConfig, wanted: list[str] | None = None, staged: bool = False) -> DataFrame:
    """`pair_features` of every scene, and the sphere's `cutoff_active_pair_count`, without pairs as rows.

    The task that holds two tiles of a scene measures their pairs in blocks. `wanted` names the columns; all are made where it is missing.
    `staged` says that reading the aircraft again is cheap.
    """
    seconds = {f"{NOMINAL(cfg, h)}s": h / K.MICROS for h in sorted(set(cfg.horizons_us))}
    empty = lambda c: F.coalesce(c, F.lit(K.EMPTY_DISTANCE_M))
    made = {
        "observed_pair_count": (None, F.sum("pairs")),
        "current_active_pair_count_5nm_1000ft": ("active", F.sum("active")),
        "closing_pair_count_10nm": ("closing", F.sum("closing")),
        "mean_pair_horizontal_distance_m": ("mean_h", empty(F.try_divide(F.sum("sum_h"), F.sum("n_h")))),
        "minimum_pair_vertical_separation_m": ("min_rz", empty(F.min("min_rz"))),
        "current_min_pair_distance_m": ("min_h", F.min("min_h")),
        "cutoff_active_pair_count": ("sphere", F.sum("sphere")),
    }
    for name in seconds:
        made |= {
            f"cpa_pair_count_{name}": (f"count_{name}", F.sum(f"count_{name}")),
            f"minimum_projected_horizontal_cpa_m_{name}": (f"min_ph_{name}", empty(F.min(f"min_ph_{name}"))),
            f"minimum_projected_vertical_separation_m_{name}": (f"min_pv_{name}", empty(F.min(f"min_pv_{name}"))),
        }
    chosen = list(made) if wanted is None else list(dict.fromkeys(wanted))
    run, schema = P.measured([m for m in (made[c][0] for c in chosen) if m], seconds, (cfg.horizontal_m, cfg.vertical_m))
    fields = ["aircraft_id", *P.STATES, "lat_deg", "lon_deg"]
    return P.mapped(aircraft, fields, run, schema, staged).groupBy(*TICK).agg(*[made[c][1].alias(c) for c in chosen])


LADDER = [
    "observed_pair_count", "current_active_pair_count_5nm_1000ft", "closing_pair_count_10nm", "mean_pair_horizontal_distance_m",
    "minimum_pair_vertical_separation_m", "current_min_pair_distance_m",
]


def ladder_columns(cfg: SceneConfig) -> list[str]:
    """Pair and closest-approach columns of the feature ladder."""
    names = ("cpa_pair_count_{}s", "minimum_projected_horizontal_cpa_m_{}s", "minimum_projected_vertical_separation_m_{}s")
    return LADDER + [n.format(NOMINAL(cfg, h)) for h in sorted(set(cfg.horizons_us)) for n in names]


def state_features(aircraft: DataFrame) -> DataFrame:
    """Per-scene count, means, population deviations, altitude range and low-altitude share."""
    return aircraft.groupBy(*TICK).agg(
        F.min("cutoff_us").alias("cutoff_us"),
        F.count(F.lit(1)).alias("current_aircraft_count"),
        F.avg("altitude_m").alias("current_altitude_mean_m"),
        F.stddev_pop("altitude_m").alias("current_altitude_std_m"),
        F.avg("speed_mps").alias("current_speed_mean_mps"),
        F.stddev_pop("speed_mps").alias("current_speed_std_mps"),
        (F.max("altitude_m") - F.min("altitude_m")).alias("current_altitude_range_m"),
        (F.count_if(F.col("altitude_m") < 3000.0) / F.count(F.lit(1))).alias("current_low_altitude_fraction"),
        (F.lit(1.0) - F.hypot(F.avg(F.sin("heading_rad")), F.avg(F.cos("heading_rad")))).alias("heading_dispersion"),
    )


def feature_ladder(aircraft: DataFrame, cfg: SceneConfig, wanted: list[str] | None = None) -> DataFrame:
    """Nested feature sets A (state), B (pairs) and C (closest approach) as one wide row per scene.

    `wanted` limits the pair and closest-approach columns to those a caller goes on with.
    """
    columns = [c for c in ladder_columns(cfg) if wanted is None or c in wanted]
    aircraft = stage_table(aircraft.select(*TICK, "aircraft_id", "cutoff_us", "lat_deg", "lon_deg", "speed_mps", "heading_rad", *P.STATES), "aircraft")
    return state_features(aircraft).join(pair_measures(aircraft, cfg, columns, True), TICK)


def baseline_features(aircraft: DataFrame, cfg: SceneConfig) -> DataFrame:
    """Persistence, exposure and 120-second closest-approach counts; persistence uses the sphere."""
    middle = f"cpa_pair_count_{NOMINAL(cfg, sorted(set(cfg.horizons_us))[1])}s"
    aircraft = stage_table(aircraft.select(*TICK, "aircraft_id", "lat_deg", "lon_deg", *P.STATES), "aircraft")
    pairs = pair_measures(aircraft, cfg, ["observed_pair_count", "cutoff_active_pair_count", middle], True).select(
        *TICK, F.col("observed_pair_count").alias("current_pair_opportunity"), "cutoff_active_pair_count", F.col(middle).alias("cpa_pair_count_120s"))
    counts = aircraft.groupBy(*TICK).agg(F.count(F.lit(1)).alias("current_aircraft_count"))
    return counts.join(pairs, TICK)


def task_indicators(aircraft: DataFrame, cfg: SceneConfig) -> DataFrame:
    """Nine demand proxies. Radial movement and maneuvers compare with the far state, else the near one."""
    aircraft = stage_table(aircraft.select(*TICK, "aircraft_id", "lat_deg", "lon_deg", "speed_mps", "heading_rad", "near", "far", "fx", "fy", *P.STATES), "aircraft")
    early = F.coalesce("far", "near")
    ex, ey = F.coalesce("fx", "nx"), F.coalesce("fy", "ny")
    radial = F.hypot("x", "y") - F.hypot(ex, ey)
    half = 0.5 * K.NAUTICAL_MILE_M
    turning = geo.angle_difference(F.col("heading_rad"), early["heading_rad"]) >= F.radians(F.lit(20.0))
    speeding = F.abs(F.col("speed_mps") - early["speed_mps"]) >= 10.0 * K.MANEUVER_KNOT_MPS
    climbing = F.abs(F.col("altitude_m") - early["altitude_m"]) >= 500.0 * K.FEET_TO_M
    single = aircraft.withColumn("radial", radial).groupBy(*TICK).agg(
        F.count(F.lit(1)).alias("current_aircraft_count"),
        F.count_if(F.col("radial") <= -half).alias("inbound_count_proxy"),
        F.count_if(F.col("radial") >= half).alias("outbound_count_proxy"),
        F.count_if(turning | speeding | climbing).alias("maneuvering_aircraft_count"),
        (F.lit(1.0) - F.hypot(F.avg(F.cos("heading_rad")), F.avg(F.sin("heading_rad")))).alias("heading_dispersion"),
    )
    pairs = pair_measures(aircraft, cfg, ["closing_pair_count_10nm", "cpa_pair_count_120s"], True)
    return single.join(pairs, TICK).select(
        *TICK, "current_aircraft_count",
        F.expr("current_aircraft_count * (current_aircraft_count - 1) div 2").alias("screening_pair_count"),
        "inbound_count_proxy", "outbound_count_proxy",
        (F.col("inbound_count_proxy") * F.col("outbound_count_proxy")).alias("mixed_inbound_outbound_pairs"),
        "closing_pair_count_10nm", F.col("cpa_pair_count_120s").alias("projected_separation_task_count_120s"),
        "maneuvering_aircraft_count", "heading_dispersion",
    )


def indicator_transform(indicators: DataFrame, names: list[str]) -> DataFrame:
    """log1p of every indicator except the bounded heading dispersion."""
    return indicators.withColumns({n: F.log1p(n) for n in names if n != "heading_dispersion"})


def scene_coverage(aircraft: DataFrame) -> DataFrame:
    """How many aircraft and pairs have the earlier state closest approach needs."""
    single = aircraft.groupBy(*TICK).agg(
        F.count(F.lit(1)).alias("current_aircraft"),
        F.count("near.timestamp_us").alias("aircraft_with_prior_30"),
        F.count_if(F.col("near.timestamp_us") == F.col("timestamp_us")).alias("same_report_aircraft"),
    )
    g = _geometry(scene_pairs(aircraft))
    pairs = g.groupBy(*TICK).agg(
        F.count(F.lit(1)).alias("current_pairs"),
        F.count_if("eligible").alias("cpa_eligible_pairs"),
        F.count_if(~F.col("eligible")).alias("missing_prior_pairs"),
        F.count_if(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") <= 1e-9).alias("degenerate_pairs"),
    )
    return single.join(pairs, TICK, "left").fillna(0)


COVERAGE_COUNTS = [
    "current_aircraft", "aircraft_with_prior_30", "same_report_aircraft", "current_pairs",
    "cpa_eligible_pairs", "missing_prior_pairs", "degenerate_pairs",
]


def coverage_summary(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Pair-weighted and scene-equal coverage fractions."""
    return coverage.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_scenes"),
        *[F.sum(c).alias(f"total_{c}") for c in COVERAGE_COUNTS],
        F.try_divide(F.sum("cpa_eligible_pairs"), F.sum("current_pairs")).alias("pair_weighted_eligible_fraction"),
        F.avg(F.try_divide("cpa_eligible_pairs", "current_pairs")).alias("scene_equal_eligible_fraction"),
        F.count_if(F.col("missing_prior_pairs") > 0).alias("scenes_with_missing_prior"),
        F.count_if(F.col("degenerate_pairs") > 0).alias("scenes_with_degenerate"),
        F.try_divide(F.sum("degenerate_pairs"), F.sum("cpa_eligible_pairs")).alias("degenerate_fraction"),
    )


def traditional_controls(aircraft: DataFrame) -> DataFrame:
    """Five current-state controls; the closest pair is found by map cells, not by listing pairs."""
    single = aircraft.groupBy(*TICK).agg(
        F.count(F.lit(1)).cast("double").alias("aircraft_count"),
        F.stddev_pop("altitude_m").alias("altitude_std_m"),
        F.stddev_pop("speed_mps").alias("speed_std_mps"),
        (F.lit(1.0) - F.hypot(F.avg(F.sin("heading_rad")), F.avg(F.cos("heading_rad")))).alias("heading_dispersion"),
    )
    closest = near.closest_pair(aircraft, TICK, "min_pair_distance_m")
    return single.join(closest, TICK, "left").withColumn("min_pair_distance_m", F.coalesce("min_pair_distance_m", F.lit(0.0)))


def history_rows(ticks: DataFrame, aircraft: DataFrame, cfg: SceneConfig) -> DataFrame:
    """The history a scene shows: its aircraft at each of the last `history_steps` ticks (step 0 = oldest)."""
    wanted = aircraft.select(*DAY, F.col("k").alias("cutoff_k"), "aircraft_id").withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(cfg.history_steps - 1)))
    ).withColumn("k", F.col("cutoff_k") - (cfg.history_steps - 1) + F.col("step"))
    shown = ticks.select(*TICK, "aircraft_id", "timestamp_us", "source_file_id", *STATE)
    return wanted.join(shown, TICK + ["aircraft_id"]).drop("k").withColumnRenamed("cutoff_k", "k")


def temporal_controls(ticks: DataFrame, aircraft: DataFrame, cfg: SceneConfig) -> DataFrame:
    """Eight history summaries: means, population deviation, per-step trends and share of occupied steps."""
    history = history_rows(ticks, aircraft, cfg)
    step_keys = TICK + ["step"]
    per_step = history.groupBy(*step_keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.stddev_pop("altitude_m").alias("alt"), F.stddev_pop("speed_mps").alias("spd")
    )
    closest = near.closest_pair(history, step_keys, "dist")
    filled = (
        aircraft.select(*TICK).distinct()
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(cfg.history_steps - 1))))
        .join(per_step, step_keys, "left").join(closest, step_keys, "left").fillna(0.0)
    )
    spread = max(1, cfg.history_steps - 1)
    return filled.groupBy(*TICK).agg(
        F.avg("n").alias("count_mean"), F.stddev_pop("n").alias("count_std"),
        ((F.max_by("n", "step") - F.min_by("n", "step")) / spread).alias("count_trend"),
        F.avg("dist").alias("distance_mean"),
        ((F.max_by("dist", "step") - F.min_by("dist", "step")) / spread).alias("distance_trend"),
        F.avg("alt").alias("altitude_std_mean"), F.avg("spd").alias("speed_std_mean"),
        F.avg((F.col("n") > 0).cast("double")).alias("active_fraction"),
    )


def nearest_neighbours(aircraft: DataFrame, top_k: int, tile: int | None = None) -> DataFrame:
    """Each scene aircraft's nearest others by (distance, identifier).

    Each task keeps the nearest `top_k` of the rows it expands before anything travels, so candidates are shuffled, not pairs.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    pairs = scene_pairs(aircraft, tile=tile)
    distance = geo.haversine_m(F.col("a.lat_deg"), F.col("a.lon_deg"), F.col("b.lat_deg"), F.col("b.lon_deg"))
    both = pairs.select(*TICK, F.explode(F.array(
        F.struct(F.col("a.aircraft_id").alias("aircraft_id"), F.col("b.aircraft_id").alias("neighbour_id"), distance.alias("distance_m")),
        F.struct(F.col("b.aircraft_id").alias("aircraft_id"), F.col("a.aircraft_id").alias("neighbour_id"), distance.alias("distance_m")),
    )).alias("n")).select(*TICK, "n.*")
    order = Window.partitionBy(*TICK, "aircraft_id").orderBy("distance_m", "neighbour_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def relational_edges(aircraft: DataFrame) -> DataFrame:
    """Six edge features on pairs with both earlier states: log distances, heading similarity, closure."""
    pairs = scene_pairs(aircraft.withColumn("past_altitude_m", F.col("near.altitude_m")), ["speed_mps", "past_altitude_m"])
    g = _geometry(pairs).filter("eligible")
    return g.select(
        *TICK, F.col("a.aircraft_id").alias("a_id"), F.col("b.aircraft_id").alias("b_id"),
        (F.log1p("h") / 10.0).alias("log_horizontal"), (F.log1p(F.abs("rz")) / 8.0).alias("log_vertical"),
        (F.abs(F.col("a.speed_mps") - F.col("b.speed_mps")) / 100.0).alias("speed_gap"),
        F.cos(F.col("a.heading_rad") - F.col("b.heading_rad")).alias("heading_similarity"),
        ((F.log1p("was") - F.log1p("h")) / 3.0).alias("horizontal_closure"),
        ((F.abs(F.col("a.past_altitude_m") - F.col("b.past_altitude_m")) - F.abs("rz")) / 1000.0).alias("vertical_closure"),
    )
