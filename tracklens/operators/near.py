"""Proximity joins that visit neighbouring map cells only, and exact per-group closest gaps."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracklens import constants as K
from tracklens.functions import geo
from tracklens.session import stage_table


def _band_width(radius: Column) -> Column:
    return F.degrees(F.greatest(radius, F.lit(0.001)) / F.lit(K.EARTH_RADIUS_M)) * F.lit(1.000001)


def _cells_in_band(band: Column, width: Column, radius: Column) -> Column:
    """How many longitude cells a latitude band has, so that near points are at most one cell apart."""
    edge = F.greatest(F.abs((band - 1) * width - 90.0), F.abs((band + 1) * width - 90.0))
    ratio = F.sin(F.greatest(radius, F.lit(0.001)) / (2 * K.EARTH_RADIUS_M)) / F.cos(F.radians(F.least(edge, F.lit(89.999999))))
    cells = F.floor(F.lit(360.0) / (F.degrees(F.lit(2.0) * F.asin(F.least(ratio, F.lit(1.0)))) * F.lit(1.000001)))
    return F.when((ratio >= 1.0) | (cells < 3), F.lit(1).cast("long")).otherwise(cells)


def _cell(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * cells), cells)


def near_pairs(
    points: DataFrame,
    keys: list[str],
    radius: float | str,
    payload: list[str],
    outputs: list[Column],
    condition: Column | None = None,
    id_col: str = "aircraft_id",
) -> DataFrame:
    """Pairs of points of one group that can lie within `radius` metres, each pair once.

    Every point is stored in its own latitude/longitude cell and probes that cell and four neighbours, so a
    group never meets itself as a whole. `radius` is a number or the name of a per-group column. `condition`
    and `outputs` refer to the two sides as p.* and q.*; the caller adds the exact distance test.
    """
    rad = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    extra = [radius] if isinstance(radius, str) else []
    based = points.select(*keys, id_col, "lat_deg", "lon_deg", *extra, *payload)
    # Trigonometry that belongs to one point is done once per point, not once per pair.
    based = based.withColumns({
        "lat_r": F.radians("lat_deg"), "lon_r": F.radians("lon_deg"), "cos_lat": F.cos(F.radians("lat_deg")), "w_": _band_width(rad),
    })
    # Declaring the cells non-null keeps the join from adding null filters, which would be pushed below
    # these steps with all their trigonometry copied into them.
    known = lambda c: F.coalesce(c, F.lit(-1).cast("long"))
    based = based.withColumn("band_", known(F.floor((F.col("lat_deg") + 90.0) / F.col("w_"))))
    based = based.withColumn("n_", known(_cells_in_band(F.col("band_"), F.col("w_"), rad)))
    based = based.withColumn("cell_", known(_cell(F.col("lon_deg"), F.col("n_"))))
    # One 64-bit key decides nearly every comparison of the join; the columns behind it keep it exact.
    home = based.withColumn("key_", F.xxhash64(*keys, "band_", "cell_")).drop("w_", "n_", "lat_deg", "lon_deg", *extra).alias("q")
    up = F.col("band_") + 1
    probe = based.withColumn("m_", known(_cells_in_band(up, F.col("w_"), rad)))
    probe = probe.withColumn("e_", known(_cell(F.col("lon_deg"), F.col("m_"))))
    def cell(band: Column, index: Column) -> Column:
        return F.struct(band.alias("b"), index.alias("c"))

    # A band with a single cell has no side neighbours; the join drops the empty slots.
    wide, wide_up = F.col("n_") > 1, F.col("m_") > 1
    targets = F.array(
        cell(F.col("band_"), F.col("cell_")),
        F.when(wide, cell(F.col("band_"), F.pmod(F.col("cell_") + 1, F.col("n_")))),
        F.when(wide_up, cell(up, F.pmod(F.col("e_") - 1, F.col("m_")))),
        cell(up, F.col("e_")),
        F.when(wide_up, cell(up, F.pmod(F.col("e_") + 1, F.col("m_")))),
    )
    probe = probe.withColumn("t_", F.explode(targets)).filter("t_ IS NOT NULL").drop("w_", "n_", "m_", "e_", "lat_deg", "lon_deg", *extra)
    probe = probe.withColumn("key_", F.xxhash64(*keys, "t_.b", "t_.c")).alias("p")
    match = (F.col("p.key_") == F.col("q.key_")) & (F.col("p.t_.b") == F.col("q.band_")) & (F.col("p.t_.c") == F.col("q.cell_"))
    for key in keys:
        match = match & (F.col(f"p.{key}") == F.col(f"q.{key}"))
    same_cell = (F.col("p.band_") == F.col("q.band_")) & (F.col("p.cell_") == F.col("q.cell_"))
    match = match & (~same_cell | (F.col(f"p.{id_col}") < F.col(f"q.{id_col}")))
    if condition is not None:
        match = match & condition
    return probe.join(home, match).select(
        *[F.col(f"p.{key}").alias(key) for key in keys],
        F.least(f"p.{id_col}", f"q.{id_col}").alias("a_id"),
        F.greatest(f"p.{id_col}", f"q.{id_col}").alias("b_id"),
        *outputs,
    )


def pair_term(state: str = "") -> Column:
    """Squared half-chord between the two sides; `state` names a struct of both that holds another position."""
    half_lat = (F.col(f"q.{state}lat_r") - F.col(f"p.{state}lat_r")) / 2
    half_lon = (F.col(f"q.{state}lon_r") - F.col(f"p.{state}lon_r")) / 2
    s_lat, s_lon = F.sin(half_lat), F.sin(half_lon)
    return s_lat * s_lat + F.col(f"p.{state}cos_lat") * F.col(f"q.{state}cos_lat") * s_lon * s_lon


def term_distance(term: Column) -> Column:
    return F.lit(2.0 * K.EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(term)))


def within(radius_m: float, state: str = "") -> Column:
    """Great-circle distance strictly below the radius, without the square root and arc sine.

    The latitude difference alone rejects most far pairs before any sine is taken.
    """
    near_lat = F.abs(F.col(f"q.{state}lat_r") - F.col(f"p.{state}lat_r")) < F.lit(radius_m / K.EARTH_RADIUS_M * 1.000001)
    return near_lat & (pair_term(state) < F.lit(math.sin(radius_m / (2 * K.EARTH_RADIUS_M)) ** 2))


def _copied(points: DataFrame, keys: list[str], nested: tuple[str, int] | None, *more: str) -> DataFrame:
    """Points of nested groups, one row for each group. `nested` names the key that holds a point's first group, and the last one.

    The rows are shuffled once and copied where they arrive; the later windows and groupings need no other shuffle.
    """
    if nested is None:
        return points
    name, last = nested
    moved = points.repartition(*[k for k in keys if k != name], *more)
    return moved.withColumn(name, F.explode(F.sequence(name, F.lit(last).cast("long"))))


def closest_gap(points: DataFrame, keys: list[str], value: str, out: str, bin_width: float, nested: tuple[str, int] | None = None) -> DataFrame:
    """Smallest difference of two values of one group: neighbours in sorted order, bin by bin.

    Equal values collapse before they are ordered. Bins keep a crowded group from being sorted by one task.
    """
    binned = _copied(points.select(*keys, value).withColumn("bin_", F.floor(F.col(value) / F.lit(bin_width))), keys, nested, "bin_")
    distinct = binned.groupBy(*keys, "bin_", value).agg(F.count(F.lit(1)).alias("n_"))
    inside = Window.partitionBy(*keys, "bin_").orderBy(value)
    gaps = distinct.withColumn(
        "gap_",
        F.when(F.col("n_") > 1, F.lit(0.0)).otherwise(F.col(value) - F.lag(value).over(inside)),
    )
    bins = gaps.groupBy(*keys, "bin_").agg(
        F.min("gap_").alias("gap_"), F.min(value).alias("lo_"), F.max(value).alias("hi_")
    )
    across = Window.partitionBy(*keys).orderBy("bin_")
    return (
        bins.withColumn("gap_", F.least("gap_", F.col("lo_") - F.lag("hi_").over(across)))
        .groupBy(*keys).agg(F.min("gap_").alias(out))
    )


REACH = 8  # neighbours in latitude order that a point is compared with


def closest_pair(points: DataFrame, keys: list[str], out: str, band_deg: float = 0.05, nested: tuple[str, int] | None = None) -> DataFrame:
    """Exact smallest great-circle distance in each group, without forming the group's pairs.

    Neighbours in latitude order give a true pair and so an upper bound. Each point is then compared with the next `REACH`
    of its latitude band that the bound allows; points that may have a close one beyond these, or across the edge of the
    band, meet in cells of the bound's size. Groups with fewer than two points give no row.
    """
    banded = points.select(*keys, "aircraft_id", "lat_deg", "lon_deg").withColumn(
        "lb_", F.floor(F.col("lat_deg") / F.lit(band_deg))
    )
    banded = _copied(banded, keys, nested, "lb_")
    inside = Window.partitionBy(*keys, "lb_").orderBy("lat_deg", "lon_deg", "aircraft_id")
    stepped = banded.withColumn("pa_", F.lag("lat_deg").over(inside)).withColumn("po_", F.lag("lon_deg").over(inside))
    stepped = stepped.withColumn(
        "d_", geo.haversine_m(F.col("pa_"), F.col("po_"), F.col("lat_deg"), F.col("lon_deg"))
    )
    edge = F.struct("lat_deg", "lon_deg")
    bands = stepped.groupBy(*keys, "lb_").agg(
        F.min("d_").alias("d_"), F.min(edge).alias("lo_"), F.max(edge).alias("hi_")
    )
    across = Window.partitionBy(*keys).orderBy("lb_")
    bands = bands.withColumn("h_", F.lag("hi_").over(across)).withColumn(
        "d_",
        F.least("d_", geo.haversine_m(F.col("h_.lat_deg"), F.col("h_.lon_deg"), F.col("lo_.lat_deg"), F.col("lo_.lon_deg"))),
    )
    bound = stage_table(bands.groupBy(*keys).agg(F.min("d_").alias("bound_")).filter("bound_ IS NOT NULL"), "bounds")
    ranged = banded.join(bound.filter("bound_ > 0"), keys).withColumn("w_", _band_width(F.col("bound_")))
    here = F.struct("lat_deg", "lon_deg")
    steps = [F.lag(here, i).over(inside) for i in range(1, REACH + 1)]
    swept = ranged.withColumns({"back_": F.array(*steps), "ahead_": F.lead("lat_deg", REACH).over(inside)})
    close = F.filter("back_", lambda p: p.isNotNull() & (F.col("lat_deg") - p.lat_deg <= F.col("w_")))
    compared = swept.withColumn("d_", F.array_min(F.transform(close, lambda p: geo.haversine_m(p.lat_deg, p.lon_deg, F.col("lat_deg"), F.col("lon_deg")))))
    further = F.coalesce(F.col("lat_deg") - F.get("back_", F.lit(REACH - 1)).lat_deg <= F.col("w_"), F.lit(False)) | F.coalesce(F.col("ahead_") - F.col("lat_deg") <= F.col("w_"), F.lit(False))
    low = F.col("lb_") * F.lit(band_deg)
    at_edge = (F.col("lat_deg") - low <= F.col("w_")) | (low + F.lit(band_deg) - F.col("lat_deg") <= F.col("w_"))
    near = near_pairs(swept.filter(further | at_edge), keys, "bound_", [], [pair_term().alias("t_")])
    closest = near.groupBy(*keys).agg(F.min("t_").alias("t_")).select(*keys, term_distance(F.col("t_")).alias("d_"))
    return (
        bound.select(*keys, F.col("bound_").alias("d_"))
        .unionByName(compared.groupBy(*keys).agg(F.min("d_").alias("d_")))
        .unionByName(closest)
        .groupBy(*keys).agg(F.min("d_").alias(out))
    )
