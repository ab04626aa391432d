"""Repeat and run statistics of audited rows at four levels, and the age-repeat cube."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracklens.operators.ordered import blocked_lag

KEY = ["airport_id", "aircraft_id"]
STATE = ["lat", "lon", "altitude", "speed", "heading"]
RECORD_TYPES = ["id_timestamp", "exact_report", "full_state", "contiguous_state_run", "boundary_crossing"]
AGE_DIMENSIONS = ["airport_id", "repeat_count_bin", "duration_bin", "age_min_bin", "age_max_bin", "age_trend", "state_update_relationship"]


def repeat_count_bin(n: Column) -> Column:
    return F.when(n == 1, "1").when(n == 2, "2").when(n <= 4, "3-4").when(n <= 9, "5-9").otherwise("10+")


def _positive_bin(v: Column) -> Column:
    return (
        F.when(v == 0, "0").when(v <= 1, "(0,1]").when(v <= 5, "(1,5]").when(v <= 30, "(5,30]").when(v <= 60, "(30,60]").otherwise(">60")
    )


def duration_bin(seconds: Column) -> Column:
    return _positive_bin(seconds)


def age_bin(age: Column) -> Column:
    return F.when(age.isNull(), "missing").when(age < 0, "negative").otherwise(_positive_bin(age))


def _finite(age: Column) -> Column:
    return F.when(age.isNotNull() & ~F.isnan(age) & (F.abs(age) < float("inf")), age)


def _several(name: str) -> Column:
    """Whether a column takes more than one value in the group; null counts as a value."""
    return F.coalesce(F.min(name) != F.max(name), F.lit(False)) | ((F.count(name) > 0) & (F.count(name) < F.count(F.lit(1))))


def id_timestamp_groups(rows: DataFrame) -> DataFrame:
    conflict = reduce(lambda a, b: a | b, [_several(c) for c in STATE])
    return rows.groupBy(*KEY, "timestamp_us").agg(
        F.count(F.lit(1)).alias("n"), conflict.alias("conflict"), _several("source_file_id").alias("crossing"),
        F.countDistinct("source_file_id").alias("source_file_count"),
    )


def exact_report_groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY, "timestamp_us", "lat", "lon", "altitude").agg(
        F.count(F.lit(1)).alias("n"), _several("source_file_id").alias("crossing")
    )


def full_state_groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY, *STATE).agg(
        F.count(F.lit(1)).alias("n"), _several("source_file_id").alias("crossing"),
        F.min("timestamp_us").alias("first_us"), F.max("timestamp_us").alias("last_us"),
    )


def _run_numbers(marked: DataFrame, ordering: list[str]) -> DataFrame:
    """Add to each row its 1-based run and place in the aircraft's rows, `run_no` and `place`, the time of the next row, `next_us`, whether there is none, `ends`, and two marks.

    `new_time` is 1 where the row before it in its run has another time, or there is none; `new_file` is 1 where that row is of another file.
    Rows are shuffled once, by blocks `blk`. Inside a block only its first row does not know what precedes it; one summary row a
    block tells that, and how many runs and rows come before.
    """
    inside = Window.partitionBy(*KEY, "blk").orderBy(*ordering)
    values = F.struct(*STATE, "timestamp_us", "source_file_id")

    def follows(before: str, row: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"{before}.{c}").eqNullSafe(F.col(f"{row}{c}")) for c in STATE])

    def marks(start: Column, before: str, row: str) -> list[Column]:
        other_time = F.col(f"{before}.timestamp_us") != F.col(f"{row}timestamp_us")
        return [start, start | other_time, ~start & ~F.col(f"{before}.source_file_id").eqNullSafe(F.col(f"{row}source_file_id"))]

    lagged = marked.withColumn("lag_", F.lag(values).over(inside)).withColumn("row_", F.row_number().over(inside).cast("long"))
    lagged = lagged.withColumns({"next_": F.lead("timestamp_us").over(inside), "final_": F.lead(F.lit(True)).over(inside).isNull()})
    first = F.col("lag_").isNull()
    own = [F.when(~first, m) for m in marks(~follows("lag_", ""), "lag_", "")]
    flagged = lagged.withColumns(dict(zip(("starts_", "time_", "file_"), own)))
    local = flagged.withColumn("run_", F.sum(F.coalesce(F.col("starts_").cast("long"), F.lit(0))).over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("lag_")
    blocks = local.groupBy(*KEY, "blk").agg(
        F.min_by(values, "row_").alias("head_"), F.max_by(values, "row_").alias("tail_"), F.max("run_").alias("runs_"), F.count(F.lit(1)).alias("rows_"),
    )
    along = Window.partitionBy(*KEY).orderBy("blk")
    carried = blocks.withColumn("carry_", F.lag("tail_").over(along))
    start = F.col("carry_").isNull() | ~follows("carry_", "head_.")
    told = carried.withColumns(dict(zip(("start_", "new_time_", "new_file_"), marks(start, "carry_", "head_."))))
    until = along.rowsBetween(Window.unboundedPreceding, 0)
    facts = told.select(
        *KEY, "blk", (F.sum(F.col("runs_") + F.col("start_").cast("long")).over(until) - F.col("runs_")).alias("runs_before_"),
        (F.sum("rows_").over(until) - F.col("rows_")).alias("rows_before_"), "new_time_", "new_file_",
        F.lead("head_.timestamp_us").over(along).alias("next_us_"), F.lead(F.lit(True)).over(along).isNull().alias("ends_"),
    )
    return local.join(facts, [*KEY, "blk"], "left").select(
        *marked.columns, (F.col("run_") + F.coalesce("runs_before_", F.lit(1))).alias("run_no"), (F.col("row_") + F.coalesce("rows_before_", F.lit(0))).alias("place"),
        F.coalesce("time_", "new_time_").cast("long").alias("new_time"), F.coalesce("file_", "new_file_").cast("long").alias("new_file"),
        F.when(F.col("final_"), F.col("next_us_")).otherwise(F.col("next_")).alias("next_us"), (F.col("final_") & F.coalesce("ends_", F.lit(True))).alias("ends"),
    )


def state_runs(rows: DataFrame, order: list[str], block: Column) -> DataFrame:
    """Maximal stretches of one aircraft with an unchanged state, in (timestamp, order).

    An aircraft's rows are cut into blocks along its timeline, so a very busy one does not fall to one task.
    """
    ordering = ["timestamp_us", *order]
    numbered = _run_numbers(rows.withColumn("blk", F.coalesce(block, F.lit(-(1 << 62)))), ordering)
    age = _finite(F.col("age"))
    position = F.col("place")
    runs = numbered.groupBy(*KEY, (F.col("run_no") - 1).alias("run_ordinal")).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp_us").alias("first_us"), F.max("timestamp_us").alias("last_us"),
        F.sum("new_time").alias("distinct_timestamps"), (F.max("new_file") > 0).alias("crossing"),
        F.min(age).alias("age_min"), F.max(age).alias("age_max"), F.count(age).alias("ages"),
        F.min_by(age, F.when(age.isNotNull(), position)).alias("age_first"),
        F.max_by(age, F.when(age.isNotNull(), position)).alias("age_last"),
        F.max("next_us").alias("next_us"), F.max("ends").alias("ends"),  # times never fall, so the greatest is that after the last row
        *[F.first(c).alias(c) for c in STATE],
    )
    relation = (
        F.when(F.col("ends"), "end_of_aircraft")
        .when(F.col("next_us") == F.col("last_us"), "same_timestamp_update")
        .otherwise("later_timestamp_update")
    )
    trend = (
        F.when(F.col("ages") < 2, "insufficient").when(F.col("age_last") > F.col("age_first"), "increasing")
        .when(F.col("age_last") < F.col("age_first"), "decreasing").otherwise("unchanged")
    )
    return (
        runs.withColumn("state_update_relationship", relation).withColumn("age_trend", trend)
        .withColumn("duration_s", (F.col("last_us") - F.col("first_us")) / F.lit(1e6))
        .withColumn("age_delta_s", F.when(F.col("ages") >= 2, F.col("age_last") - F.col("age_first")))
        .drop("next_us", "ends")
    )


_MEASURES = [
    "total_groups", "total_rows", "duplicate_groups", "duplicate_rows", "repeat_groups", "repeat_rows", "excess_rows",
    "identical_state_groups", "conflicting_state_groups", "file_boundary_crossing_groups",
]


def _level(groups: DataFrame, kind: str, span: bool, **measures: Column) -> DataFrame:
    n = F.col("n")
    values = {
        "total_groups": F.count(F.lit(1)), "total_rows": F.sum(n), "file_boundary_crossing_groups": F.count_if("crossing"), **measures,
    }
    seconds = (F.col("last_us") - F.col("first_us")) / F.lit(1e6)
    spans = [F.count(seconds), F.min(seconds), F.max(seconds), F.sum(seconds)] if span else [
        F.lit(0).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.0)
    ]
    named = [c.alias(a) for c, a in zip(spans, ("span_count", "span_min_s", "span_max_s", "span_sum_s"))]
    return groups.groupBy("airport_id").agg(
        F.lit(kind).alias("record_type"), *[values.get(m, F.lit(0)).cast("long").alias(m) for m in _MEASURES], *named,
        F.sum(F.when(F.col("crossing"), n).otherwise(0)).cast("long").alias("crossing_rows_"),
    )


def duplicate_summary(rows: DataFrame, order: list[str], block: Column) -> DataFrame:
    """Five summary records per airport. Every level reduces its groups before rolling up."""
    by_time, exact, states = id_timestamp_groups(rows), exact_report_groups(rows), full_state_groups(rows)
    runs = state_runs(rows, order, block)
    n, more = F.col("n"), F.col("n") > 1
    dup = {
        "duplicate_groups": F.count_if(more), "duplicate_rows": F.sum(F.when(more, n).otherwise(0)),
        "excess_rows": F.sum(n - 1),
    }
    rep = {"repeat_groups": F.count_if(more), "repeat_rows": F.sum(F.when(more, n).otherwise(0))}
    levels = [
        _level(by_time, "id_timestamp", False, **dup, identical_state_groups=F.count_if(more & ~F.col("conflict")),
               conflicting_state_groups=F.count_if(more & F.col("conflict"))),
        _level(exact, "exact_report", False, **dup),
        _level(states, "full_state", True, **rep, excess_rows=F.sum(n - 1)),
        _level(runs, "contiguous_state_run", True, **rep),
    ]
    crossed = {"file_boundary_crossing_groups": "total_groups", "crossing_rows_": "total_rows"}
    every = reduce(lambda a, b: a.unionByName(b), levels)
    # A level's crossing groups come with its own totals, so no group is made a second time for the boundary record.
    kinds = F.array(F.lit("own"), F.lit("boundary_crossing"))
    shown = every.withColumn("kind_", F.explode(kinds))
    own = F.col("kind_") == "own"
    spans = {"span_min_s": F.min, "span_max_s": F.max}
    return shown.groupBy("airport_id", F.when(own, F.col("record_type")).otherwise(F.col("kind_")).alias("record_type")).agg(
        *[F.sum(F.when(own, F.col(m)).otherwise(F.col({v: k for k, v in crossed.items()}.get(m)) if m in crossed.values() else F.lit(0))).cast("long").alias(m) for m in _MEASURES],
        F.sum(F.when(own, F.col("span_count")).otherwise(0)).cast("long").alias("span_count"),
        *[f(F.when(own, F.col(c))).alias(c) for c, f in spans.items()],
        F.sum(F.when(own, F.col("span_sum_s")).otherwise(0.0)).alias("span_sum_s"),
    )


def age_repeat_cube(runs: DataFrame) -> DataFrame:
    """Run counts and duration statistics over seven dimensions."""
    rest = F.col("duration_s") - F.col("age_delta_s")
    binned = runs.withColumns({
        "repeat_count_bin": repeat_count_bin(F.col("n")), "duration_bin": duration_bin(F.col("duration_s")),
        "age_min_bin": age_bin(F.col("age_min")), "age_max_bin": age_bin(F.col("age_max")), "rest_s": rest,
    })
    terms = [
        F.count(F.lit(1)).alias("run_count"), F.sum("n").alias("run_rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeat_rows"),
    ]
    for prefix, column in (("duration", "duration_s"), ("age_delta", "age_delta_s"), ("rest", "rest_s")):
        terms += [f(column).alias(f"{prefix}_{s}") for f, s in ((F.count, "count"), (F.min, "min_s"), (F.max, "max_s"))]
        terms.append(F.coalesce(F.sum(column), F.lit(0.0)).alias(f"{prefix}_sum_s"))
    return binned.groupBy(*AGE_DIMENSIONS).agg(*terms)


def monotone_age_groups(rows: DataFrame, order: list[str], block: Column) -> DataFrame:
    """Groups of one aircraft and time with at least two ages, and whether ages never fall in source order."""
    aged = rows.withColumn("age", _finite(F.col("age"))).filter("age IS NOT NULL")
    keys = KEY + ["timestamp_us"]
    lagged = blocked_lag(aged.select(*keys, *order, "age"), keys, block, order, ["age"])
    return lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ages"),
        (F.count_if(F.col("prev.age") > F.col("age")) == 0).alias("never_falls"),
    ).filter("ages >= 2")


def summary_conservation(summary: DataFrame) -> DataFrame:
    """Per airport: every level but the boundary one must account for all rows."""
    totals = summary.filter("record_type <> 'boundary_crossing'").groupBy("airport_id").agg(
        F.min("total_rows").alias("least_rows"), F.max("total_rows").alias("most_rows"), F.count(F.lit(1)).alias("levels")
    )
    return totals.withColumn("conserved", (F.col("least_rows") == F.col("most_rows")) & (F.col("levels") == 4))
