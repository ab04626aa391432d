"""Ranked picks, apportionment, systematic samples and train/validation/test splits."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracklens.functions.hashing import prefix_mod, span_selected, stable_rank
from tracklens.operators.ordered import blocked_lag, blocked_row_number, blocked_running_sum, first_per_group
from tracklens.session import stage_table

TRACK_BLOCK_US = 3_600_000_000  # an hour: the part of a track that one task orders


def top_by_hash(rows: DataFrame, groups: list[str], identifier: str, cap: int, salt: str) -> DataFrame:
    """The `cap` rows of each group with the smallest salted hash."""
    if cap <= 0:
        raise ValueError("cap must be positive")
    ranked = rows.withColumn("hash_", stable_rank(salt, F.col(identifier)))
    return first_per_group(ranked, groups, ["hash_", identifier], cap, "rank_").drop("hash_", "rank_")


def top_sources(sources: DataFrame, group: str, count: str, identifier: str, n: int, salt: str) -> DataFrame:
    """Largest sources per group; equal sizes are ordered by salted hash, then identifier."""
    ranked = sources.filter(F.col(count) > 0).withColumn("hash_", stable_rank(salt, F.col(identifier)))
    rank = Window.partitionBy(group).orderBy(F.desc(count), "hash_", identifier)
    return ranked.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n).drop("hash_")


def best_per_stratum(sources: DataFrame, strata: list[str], count: str, date: str, identifier: str) -> DataFrame:
    """First the best source per date, then the best date per stratum, by (count, date, identifier)."""
    per_date = sources.groupBy(*strata, date).agg(F.max(F.struct(count, identifier)).alias("b"))
    best = per_date.groupBy(*strata).agg(F.max(F.struct(F.col(f"b.{count}").alias(count), date, F.col(f"b.{identifier}").alias(identifier))).alias("b"))
    return best.select(*strata, "b.*")


def _apportion_round(state: DataFrame, group: str, key: str) -> DataFrame:
    """One largest-remainder round over the keys that still have room."""
    whole = Window.partitionBy(group)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    room = F.col("capacity") - F.col("allocated")
    open_ = (F.col("population") > 0) & (room > 0)
    sized = state.withColumn("open_", open_).withColumn("total_", F.sum(F.when(open_, F.col("population"))).over(whole))
    product = wide("remaining") * wide("population")
    shared = sized.withColumn(
        "floor_", F.when(F.col("open_"), F.least(room, ((product - product % wide("total_")) / wide("total_")).cast("long"))).otherwise(0)
    ).withColumn("rest_", F.when(F.col("open_"), product % wide("total_")))
    given = shared.withColumn("allocated", F.col("allocated") + F.col("floor_")).withColumn(
        "left_", F.col("remaining") - F.sum("floor_").over(whole)
    )
    eligible = F.col("open_") & (F.col("allocated") < F.col("capacity"))
    order = Window.partitionBy(group).orderBy(F.desc("eligible_"), F.desc("rest_"), key)
    ranked = given.withColumn("eligible_", eligible).withColumn("rank_", F.row_number().over(order))
    extra = (F.col("eligible_") & (F.col("rank_") <= F.col("left_"))).cast("long")
    done = ranked.withColumn("extra_", extra)
    return done.withColumn("allocated", F.col("allocated") + F.col("extra_")).withColumn(
        "remaining", F.col("left_") - F.sum("extra_").over(whole)
    ).select(*state.columns)


def apportion(strata: DataFrame, group: str, key: str) -> DataFrame:
    """Hamilton apportionment of each group's `total` over `population`, never above `capacity`.

    Works on the stratum table, one row per key. Without binding capacities one round is enough; further
    rounds run only while something is left to hand out.
    """
    state = strata.withColumn("allocated", F.lit(0).cast("long")).withColumn("remaining", F.col("total"))
    infeasible = state.groupBy(group).agg(F.max("total").alias("t"), F.sum("capacity").alias("c")).filter("t > c")
    if not infeasible.isEmpty():
        raise ValueError("total exceeds capacity")
    while True:
        state = stage_table(_apportion_round(state, group, key), "apportion")
        if state.filter("remaining > 0").isEmpty():
            return state.drop("remaining")


def stratum_quotas(strata: DataFrame, group: str, key: str) -> DataFrame:
    """At least one per nonempty stratum, the rest by largest remainder with the strata as capacity."""
    positive = strata.filter("population > 0")
    count = F.count(F.lit(1)).over(Window.partitionBy(group))
    rest = positive.withColumn("capacity", F.col("population") - 1).withColumn("asked_", F.col("total")).withColumn("total", F.col("total") - count)
    return apportion(rest, group, key).withColumn("quota", F.col("allocated") + 1).withColumn("total", F.col("asked_")).drop("asked_", "allocated", "capacity")


def covering_prefix(sources: DataFrame, group: str, identifier: str, count: str, quota: str, salt: str) -> DataFrame:
    """Sources in hash order until their rows cover the quota. Hash prefixes serve as order-preserving blocks."""
    ranked = sources.withColumn("hash", stable_rank(salt, F.col(identifier)))
    summed = blocked_running_sum(ranked, [group], F.substring("hash", 1, 2), ["hash", identifier], count, "covered")
    return summed.filter(F.col("covered") - F.col(count) < F.col(quota))


def systematic_midpoint(ordinal: Column, population: Column, quota: Column) -> Column:
    """Whether a 1-based ordinal is one of the quota midpoints floor((2j+1)N / 2q) + 1. A plain row test."""
    target = ordinal - 1
    # Smallest j whose midpoint reaches the ordinal.
    excess = target * 2 * quota - population
    step = 2 * population
    j = F.when(excess <= 0, F.lit(0).cast("long")).otherwise((excess + step - 1 - F.pmod(excess + step - 1, step)) / step).cast("long")
    reach = (2 * j + 1) * population
    double = 2 * quota
    return (j < quota) & (((reach - F.pmod(reach, double)) / double).cast("long") == target)


def group_splits(groups: DataFrame, within: list[str], identifier: str, salt: str) -> DataFrame:
    """60/20/20 split of whole groups by hash rank, optionally separately for each value of `within`."""
    distinct = groups.select(*within, identifier).distinct().withColumn("hash_", stable_rank(salt, F.concat_ws("\0", *within, identifier)))
    scope = within or ["all_"]
    distinct = distinct.withColumn("all_", F.lit(0))
    # Hash prefixes are blocks in hash order, so even a single scope is ranked in parallel.
    numbered = blocked_row_number(distinct, scope, F.substring("hash_", 1, 2), ["hash_", identifier], "i_")
    sizes = distinct.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_"))
    ranked = numbered.join(sizes, scope).withColumn("i_", F.col("i_") - 1).drop("all_")
    train = F.greatest(F.lit(1), F.expr("n_ * 60 div 100"))
    validation = F.least(F.greatest(train + F.when(F.col("n_") >= 3, 1).otherwise(0), F.expr("n_ * 80 div 100")), F.col("n_"))
    split = F.when(F.col("i_") < train, "train").when(F.col("i_") < validation, "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("hash_", "n_", "i_")


def entity_split(identifier: Column, salt: str) -> Column:
    bucket = prefix_mod(stable_rank(salt, identifier), 100)
    return F.when(bucket < 60, "train").when(bucket < 80, "validation").otherwise("test")


def temporal_split(stamp: Column, train_cutoff, validation_cutoff, embargo) -> Column:
    """Chronological split; rows inside an embargo zone get null."""
    return (
        F.when(stamp < train_cutoff - embargo, "train")
        .when((stamp > train_cutoff + embargo) & (stamp < validation_cutoff - embargo), "validation")
        .when(stamp > validation_cutoff + embargo, "test")
    )


def sequential_splits(sources: DataFrame, group: str, order: list[str], block_rows: int = 8_192) -> DataFrame:
    """First three fifths, next fifth, rest, in source order; groups need three sources.

    The first column of `order` is a number that grows with the order; blocks of it are numbered apart and stitched.
    """
    sizes = sources.groupBy(group).agg(F.count(F.lit(1)).alias("n_"))
    placed = blocked_row_number(sources, [group], F.floor(F.col(order[0]) / block_rows), order, "i_")
    ranked = placed.withColumn("i_", F.col("i_") - 1).join(sizes, group)
    train = F.greatest(F.lit(1), F.expr("3 * n_ div 5"))
    validation = F.least(F.greatest(train + 1, F.expr("4 * n_ div 5")), F.col("n_") - 1)
    split = F.when(F.col("i_") < train, "train").when(F.col("i_") < validation, "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("n_", "i_")


def crossing_identifiers(rows: DataFrame, identifier: str, split: str = "split") -> DataFrame:
    """Identifiers found in more than one split; empty when the split is disjoint."""
    return rows.groupBy(identifier).agg(F.min(split).alias("a"), F.max(split).alias("b")).filter("a <> b").select(identifier)


def masked_spans(
    rows: DataFrame, track: list[str], order: list[str], seed: int, salt: str, scope: list[str], block_us: int = TRACK_BLOCK_US
) -> DataFrame:
    """Spans of four rows per track, a lone last row joining the span before; about 30 % are masked.

    Where no span of a scope is chosen, the one with the smallest hash is. The order starts with a time in microseconds; a
    track's blocks of time are numbered apart, so a busy track is many tasks.
    """
    sizes = rows.groupBy(*track).agg(F.count(F.lit(1)).alias("n_"))
    numbered = blocked_row_number(rows, track, F.floor(F.col(order[0]) / block_us), order, "i_")
    placed = numbered.withColumn("i_", F.col("i_") - 1).join(sizes, track).select(*rows.columns, "n_", "i_")
    span = F.expr("i_ div 4")
    lone = (F.col("n_") % 4 == 1) & (F.col("n_") > 4) & (F.col("i_") == F.col("n_") - 1)
    spanned = placed.withColumn("span", F.when(lone, span - 1).otherwise(span))
    digest = stable_rank(salt, F.concat_ws("\0", F.lit(str(seed)), *[F.col(c).cast("string") for c in track], F.col("span").cast("string")))
    hashed = spanned.withColumn("hash_", F.when(F.col("n_") >= 2, digest))
    least = hashed.groupBy(*scope).agg(F.min("hash_").alias("least_"))
    picked = span_selected(F.col("least_"))
    chosen = F.when(picked, span_selected(F.col("hash_"))).otherwise(F.col("hash_") == F.col("least_"))
    return hashed.join(least, scope).withColumn("masked", F.coalesce(chosen, F.lit(False))).drop("n_", "i_", "hash_", "least_")


def track_deltas(rows: DataFrame, track: list[str], stamp_us: str, fields: list[str], block_us: int = TRACK_BLOCK_US) -> DataFrame:
    """Seconds and state changes since the track's previous row; a non-increasing time is an error."""
    block = F.floor(F.col(stamp_us) / block_us)
    before = blocked_lag(rows, track, block, [stamp_us], [stamp_us, *fields], "before_")
    elapsed = (F.col(stamp_us) - F.col(f"before_.{stamp_us}")) / F.lit(1e6)
    checked = F.when(elapsed <= 0, F.raise_error(F.lit("track times are not increasing")).cast("double")).otherwise(elapsed)
    return before.withColumns({"track_dt_s": checked, **{f"track_d{f}": F.col(f) - F.col(f"before_.{f}") for f in fields}}).drop("before_")


def next_row(rows: DataFrame, track: list[str], order: list[str], value: str, out: str, block_us: int = TRACK_BLOCK_US) -> DataFrame:
    """`value` of the track's next row, null on the last one; the order is unique and starts with a time in microseconds.

    It is the previous row in falling order, so times are negated and the blocks of a busy track are handled apart.
    """
    back = rows.withColumn("back_", F.struct(*[(-F.col(order[0])).alias("o0"), *[(-F.col(c)).alias(f"o{i}") for i, c in enumerate(order[1:], 1)]]))
    block = F.floor(F.col("back_.o0") / block_us)
    return blocked_lag(back, track, block, ["back_"], [value], "next_").withColumn(out, F.col(f"next_.{value}")).drop("back_", "next_")


def window_scenes(reports: DataFrame, window_us: int, min_aircraft: int, max_aircraft: int) -> DataFrame:
    """Last report per aircraft and tumbling window; windows with enough aircraft keep the first by hash."""
    keys = ["airport_id", "source_file_id", "bucket"]
    bucket = reports.withColumn("bucket", F.floor(F.col("timestamp_us") / F.lit(window_us)))
    payload = [c for c in reports.columns if c not in ("airport_id", "source_file_id", "aircraft_id")]
    order = ["timestamp_us"] + [c for c in payload if c != "timestamp_us"]
    latest = bucket.groupBy(*keys, "aircraft_id").agg(F.max(F.struct(*order)).alias("r"))
    counts = latest.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_aircraft")).filter(F.col("n_aircraft") >= min_aircraft)
    hashed = latest.withColumn("hash_", stable_rank(F.concat_ws("\0", *[F.col(k).cast("string") for k in keys]), F.col("aircraft_id")))
    rank = Window.partitionBy(*keys).orderBy("hash_", "aircraft_id")
    kept = hashed.withColumn("rank_", F.row_number().over(rank)).filter(F.col("rank_") <= max_aircraft)
    return kept.join(counts, keys).select(*keys, "aircraft_id", "n_aircraft", "r.*")


def scene_transitions(scenes: DataFrame) -> DataFrame:
    """Aircraft seen in one window and the next of the same source."""
    keys = ["airport_id", "source_file_id", "bucket", "aircraft_id"]
    following = scenes.select(*[(F.col(k) - 1).alias(k) if k == "bucket" else k for k in keys], F.col("timestamp_us").alias("next_us"))
    return scenes.join(following, keys)
