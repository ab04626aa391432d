"""Evaluation of counts and risks."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracklens import constants as K
from tracklens.functions import stats as st
from tracklens.operators.ordered import blocked_running_sum, value_counts


def ofat_settings(horizontal_nm, vertical_ft, primary_nm, primary_ft) -> list[tuple[str, float, float]]:
    """One-factor-at-a-time design in metres: both axes through the primary setting, not their product."""
    values = [float(v) for v in (*horizontal_nm, *vertical_ft)]
    if primary_nm not in horizontal_nm or primary_ft not in vertical_ft or any(not math.isfinite(v) or v <= 0 for v in values):
        raise ValueError("settings must be positive and contain the primary pair")
    if len(set(horizontal_nm)) != len(horizontal_nm) or len(set(vertical_ft)) != len(vertical_ft):
        raise ValueError("settings must be unique")
    chosen = {(h, primary_ft) for h in horizontal_nm} | {(primary_nm, v) for v in vertical_ft}
    return [(f"h{h:g}nm_v{v:g}ft", h * K.NAUTICAL_MILE_M, v * K.FEET_TO_M) for h, v in sorted(chosen)]


def one_row_join(many: DataFrame, single: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table, which is broadcast whatever the estimates say."""
    key = F.lit(1).alias("one_")
    return many.select("*", key).join(F.broadcast(single.select("*", key)), "one_").drop("one_")


def exposure_rate(train: DataFrame, keys: list[str], count: str, exposure: str, out: str = "rate") -> DataFrame:
    """Events per unit exposure; the mean count where there is no exposure."""
    total = F.sum(exposure)
    return train.groupBy(*keys).agg(F.when(total > 0, F.try_divide(F.sum(count), total)).otherwise(F.avg(count)).alias(out))


def prevalence(train: DataFrame, keys: list[str], label: str) -> DataFrame:
    return train.groupBy(*keys).agg(F.avg(label).alias("prevalence"))


def higher_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], block: Column | None = None) -> DataFrame:
    """sorted[ceil((n-1) q)] from running counts of distinct values, never from a list of rows."""
    running = value_counts(rows, keys, value, F.floor(F.col(value) / 256) if block is None else block)
    return running.groupBy(*keys).agg(*[
        F.min(F.when(F.col("c_") > F.ceil((F.col("all_") - 1) * F.lit(q)), F.col(value))).alias(n) for n, q in probabilities.items()
    ])


def row_loss(metric: str, prediction: Column, truth: Column) -> Column:
    if metric == "mae":
        return F.abs(prediction - truth)
    if metric == "brier":
        return (prediction - truth) * (prediction - truth)
    if metric == "log_loss":
        return st.log_loss(truth, prediction)
    if metric == "loss":
        return prediction
    raise ValueError(f"unsupported comparison metric: {metric}")


def group_losses(rows: DataFrame, keys: list[str], group: str, truth: str, candidate: str, reference: str, metric: str) -> DataFrame:
    return rows.groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("n_scenes"),
        F.avg(row_loss(metric, F.col(candidate), F.col(truth))).alias("candidate_loss"),
        F.avg(row_loss(metric, F.col(reference), F.col(truth))).alias("reference_loss"),
    ).withColumn("delta", F.col("candidate_loss") - F.col("reference_loss"))


def equal_group_comparison(losses: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """Means of group means with wins, losses, ties and the exact sign test. Groups weigh the same, not rows."""
    delta = F.col("delta")
    summary = losses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("group_count"), F.avg("candidate_loss").alias("candidate_equal_group_mean"),
        F.avg("reference_loss").alias("reference_equal_group_mean"), F.avg("delta").alias("candidate_minus_reference"),
        F.count_if(delta < -tolerance).alias("candidate_wins"), F.count_if(delta > tolerance).alias("reference_wins"),
        F.count_if(F.abs(delta) <= tolerance).alias("ties"),
    )
    return summary.withColumn("sign_p", st.sign_test(F.col("candidate_wins"), F.col("reference_wins")))


def count_metrics(rows: DataFrame, keys: list[str], truth: str, prediction: str) -> DataFrame:
    mean = st.floored_mean(F.col(prediction))
    error = mean - F.col(truth)
    return rows.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("count_mae"), F.sqrt(F.avg(error * error)).alias("count_rmse"),
        F.avg(st.poisson_deviance(F.col(truth), F.col(prediction))).alias("mean_poisson_deviance"),
    )


def probability_metrics(rows: DataFrame, keys: list[str], label: str, p: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.avg((F.col(p) - F.col(label)) * (F.col(p) - F.col(label))).alias("brier"),
        F.avg(st.log_loss(F.col(label), F.col(p))).alias("log_loss"),
    )


def _bin(p: str, bins: int) -> Column:
    return F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))


def calibration_error(rows: DataFrame, keys: list[str], label: str, p: str, bins: int = 10) -> DataFrame:
    """Equal-width expected calibration error; probability one belongs to the last bin."""
    per_bin = rows.groupBy(*keys, _bin(p, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("rate")
    )
    return per_bin.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def reliability(rows: DataFrame, keys: list[str], label: str, p: str, group: str, bins: int = 10) -> DataFrame:
    """All bins, the empty ones included."""
    per_bin = rows.groupBy(*keys, _bin(p, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("n_groups"), F.avg(p).alias("mean_probability"), F.avg(label).alias("observed_rate")
    )
    grid = rows.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return grid.join(per_bin, keys + ["bin"], "left").fillna(0, ["n", "n_groups"])


def nb2_dispersion(rows: DataFrame, keys: list[str], truth: str, mean: str) -> DataFrame:
    """Method-of-moments dispersion."""
    m, y = st.floored_mean(F.col(mean)), F.col(truth)
    ratio = F.try_divide(F.sum((y - m) * (y - m) - m), F.sum(m * m))
    return rows.groupBy(*keys).agg(F.greatest(F.lit(K.MIN_DISPERSION), F.coalesce(ratio, F.lit(K.MIN_DISPERSION))).alias("dispersion"))


def distribution_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scene_count"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"),
        F.try_divide(F.var_pop(value), F.avg(value)).alias("variance_to_mean_ratio"), F.avg((F.col(value) == 0).cast("double")).alias("zero_fraction"),
    )


def score(rows: DataFrame, keys: list[str], group: str, prediction: str, truth: str, probability: bool = False) -> DataFrame:
    """Equal-group mean absolute (or squared) error with row and positive counts."""
    error = row_loss("brier" if probability else "mae", F.col(prediction), F.col(truth))
    per = rows.groupBy(*keys, group).agg(F.avg(error).alias("e"), F.count(F.lit(1)).alias("n"), F.sum("risk").alias("r"))
    return per.groupBy(*keys).agg(
        F.avg("e").alias("equal_group_mean"), F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_scenes"), F.sum("r").alias("n_positive")
    )


def local_baselines(rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Rates, means, medians and prevalence from groups whose labels had matured before a group began.

    Maturity depends only on a group's end, so what a group may use is a prefix of the groups ordered by
    end. Running sums over that order, and a running histogram for the median, replace a join of all
    earlier rows. Only group summaries are ordered, never rows.
    """
    spans = rows.groupBy(*keys, group).agg(
        F.min("cutoff_us").alias("start_us"), (F.max("cutoff_us") + F.max("horizon") * F.lit(K.MICROS)).alias("end_us"),
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum("pair_opportunity").alias("so"), F.sum("risk").alias("sr"),
    )
    zero = F.lit(0).cast("long")
    adds = spans.select(*keys, F.col("end_us").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias(group), "n", "sy", "so", "sr", F.col("end_us").alias("label_us"), F.lit(1).cast("long").alias("g"))
    asks = spans.select(*keys, F.col("start_us").alias("at"), F.lit(0).alias("kind"), group, zero.alias("n"), zero.alias("sy"), zero.alias("so"), zero.alias("sr"), F.lit(None).cast("long").alias("label_us"), zero.alias("g"))
    order = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    line = adds.unionByName(asks)
    known = line.select(
        *keys, group, "kind", *[F.sum(c).over(order).alias(f"past_{c}") for c in ("n", "sy", "so", "sr", "g")], F.max("label_us").over(order).alias("latest_label_us")
    ).filter((F.col("kind") == 0) & (F.col("past_n") > 0)).drop("kind")
    counts = rows.groupBy(*keys, group, "y").agg(F.count(F.lit(1)).alias("c"))
    added = counts.join(spans.select(*keys, group, "end_us"), keys + [group]).select(*keys, "y", F.col("end_us").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias(group), "c")
    levels = counts.select(*keys, "y").distinct()
    asked = spans.select(*keys, group, "start_us").join(levels, keys).select(*keys, "y", F.col("start_us").alias("at"), F.lit(0).alias("kind"), group, zero.alias("c"))
    by_level = Window.partitionBy(*keys, "y").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    at_start = added.unionByName(asked).withColumn("past", F.sum("c").over(by_level)).filter("kind = 0")
    ladder = Window.partitionBy(*keys, group)
    cumulative = at_start.withColumn("cum", F.sum("past").over(ladder.orderBy("y").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("past").over(ladder))
    medians = cumulative.groupBy(*keys, group).agg((
        (F.min(F.when(F.col("cum") > F.floor((F.col("all") - 1) / 2), F.col("y"))) + F.min(F.when(F.col("cum") > F.floor(F.col("all") / 2), F.col("y")))) / 2.0
    ).alias("local_median_count"))
    return known.join(medians, keys + [group]).select(
        *keys, group, F.col("past_g").alias("calibration_groups"), "latest_label_us",
        F.try_divide("past_sy", "past_so").alias("local_pair_rate"), F.try_divide("past_sy", "past_n").alias("local_mean_count"),
        "local_median_count", F.try_divide("past_sr", "past_n").alias("local_prevalence"),
    )


def holm(tests: DataFrame, family: list[str], p: str, name: str) -> DataFrame:
    """Step-down adjusted p values within a family of tests."""
    order = Window.partitionBy(*family).orderBy(p, name)
    stepped = tests.withColumn("i_", F.row_number().over(order) - 1).withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy(*family)))
    raw = F.least(F.lit(1.0), (F.col("n_") - F.col("i_")) * F.col(p))
    return stepped.withColumn("r_", raw).withColumn(
        "adjusted_p", F.max("r_").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("i_", "n_", "r_")


def average_ranks(rows: DataFrame, keys: list[str], value: str, block: Column, out: str) -> DataFrame:
    """Rank of each distinct value, ties sharing the mean rank. Ranks distinct values block by block."""
    distinct = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_"))
    summed = blocked_running_sum(distinct, keys, block, [value], "n_", "c_")
    return summed.select(*keys, value, (F.col("c_") - (F.col("n_") - 1) / 2.0).alias(out))


def spearman(rows: DataFrame, keys: list[str], left: str, right: str, left_block: Column, right_block: Column) -> DataFrame:
    """Rank correlation per key; null where a side is constant or there are fewer than two rows."""
    a = average_ranks(rows, keys, left, left_block, "ra_")
    b = average_ranks(rows, keys, right, right_block, "rb_")
    # Rows that share both values are identical for the correlation, so they travel as one weighted row.
    weighted = rows.groupBy(*keys, left, right).agg(F.count(F.lit(1)).cast("double").alias("w_"))
    ranked = weighted.join(a, keys + [left]).join(b, keys + [right])
    return ranked.groupBy(*keys).agg(
        F.sum("w_").alias("n"), F.sum(F.col("w_") * F.col("ra_")).alias("sx"), F.sum(F.col("w_") * F.col("rb_")).alias("sy"),
        F.sum(F.col("w_") * F.col("ra_") * F.col("ra_")).alias("xx"), F.sum(F.col("w_") * F.col("rb_") * F.col("rb_")).alias("yy"),
        F.sum(F.col("w_") * F.col("ra_") * F.col("rb_")).alias("xy"),
    ).select(*keys, F.when(F.col("n") >= 2, st.safe_correlation(
        F.col("xy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("xx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("yy") - F.col("sy") * F.col("sy") / F.col("n"),
    )).alias("rho"))


def stratified_residual_correlation(rows: DataFrame, keys: list[str], strata: list[str], left: Column, right: Column) -> DataFrame:
    """Correlation after removing stratum means: within-stratum sums add up, so no row needs its mean."""
    v = rows.select(*keys, *[s for s in strata if s not in keys], left.alias("l_"), right.alias("r_"))
    n = F.count(F.lit(1))
    # A constant side contributes exactly nothing, not the rounding noise of merged moments.
    flat = lambda c: F.min(c) == F.max(c)
    per = v.groupBy(*dict.fromkeys(keys + strata)).agg(
        F.when(flat("l_") | flat("r_"), 0.0).otherwise(n * F.covar_pop("l_", "r_")).alias("xy"),
        F.when(flat("l_"), 0.0).otherwise(n * F.var_pop("l_")).alias("xx"),
        F.when(flat("r_"), 0.0).otherwise(n * F.var_pop("r_")).alias("yy"),
    )
    return per.groupBy(*keys).agg(st.safe_correlation(F.sum("xy"), F.sum("xx"), F.sum("yy")).alias("residual_correlation"))


def monte_carlo_interval(deltas: DataFrame, keys: list[str], group: str, value: str, resamples: int, seed: str, confidence: float = 0.95) -> DataFrame:
    """Bootstrap over groups. Draws come from a hash of (seed, resample, position), so any engine can repeat them."""
    numbered = deltas.withColumn("i_", F.row_number().over(Window.partitionBy(*keys).orderBy(group)) - 1)
    sizes = deltas.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.avg(value).alias("mean"))
    # A draw depends on the number of groups only: keys of one size share their draws, which stay with their resample. Trials are
    # few bytes but much hashing, so their partitions are given by number, which adaptive execution does not merge.
    trials = sizes.select("n_").distinct().withColumn("r_", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).repartition(
        deltas.sparkSession.sparkContext.defaultParallelism, "n_", "r_"
    )
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col("r_").cast("string"), F.col("j_").cast("string")), 256)
    drawn = trials.withColumn("j_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_") - 1))).select(
        "n_", "r_", F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.col("n_")).cast("int").alias("i_")
    )
    times = drawn.groupBy("n_", "r_", "i_").agg(F.count(F.lit(1)).alias("times_"))
    values = numbered.join(sizes, keys).select(*keys, "n_", "mean", "i_", F.col(value).alias("v_"))
    means = times.join(values, ["n_", "i_"]).groupBy(*keys, "n_", "r_").agg(
        (F.sum(F.col("v_") * F.col("times_")) / F.first("n_")).alias("m_"), F.first("mean").alias("mean")
    )
    tail = (1.0 - confidence) / 2.0
    return means.groupBy(*keys).agg(
        F.first("n_").alias("group_count"), F.first("mean").alias("mean"), F.percentile("m_", tail).alias("lower"), F.percentile("m_", 1.0 - tail).alias("upper"),
        F.count(F.lit(1)).alias("resample_count"),
    )


def exhaustive_interval(deltas: DataFrame, group: str, value: str, confidence: float = 0.95) -> DataFrame:
    """All n^n ordinary bootstrap samples of at most ten groups, as multisets of draws with their multiplicities.

    A sample's mean depends on how often each group is drawn only, so C(2n - 1, n) rows (92,378 for ten groups) with weights
    n! / (c_1! .. c_n!) stand for all samples. Ten values, and no more, are read to the driver.
    """
    spark = deltas.sparkSession
    values = [r.v for r in deltas.select(group, F.col(value).alias("v")).orderBy(group).limit(11).collect()]
    n = len(values)
    if not 1 <= n <= 10:
        raise ValueError("exhaustive bootstrap needs one to ten groups")
    samples = spark.range(1).select(F.lit(n).alias("left_"), F.lit(0.0).alias("sum_"), F.lit(math.factorial(n)).cast("long").alias("weight_"))
    for position, v in enumerate(values):
        counts = F.array(F.col("left_")) if position == n - 1 else F.sequence(F.lit(0), F.col("left_"))
        samples = samples.withColumn("c_", F.explode(counts)).select(
            (F.col("left_") - F.col("c_")).alias("left_"), (F.col("sum_") + F.col("c_") * F.lit(v)).alias("sum_"),
            F.expr("weight_ div factorial(c_)").alias("weight_"),
        )
    tail = (1.0 - confidence) / 2.0
    means = samples.select((F.col("sum_") / n).alias("m"), "weight_")
    return means.agg(
        F.lit(sum(values) / n).alias("mean"), F.percentile("m", tail, F.col("weight_")).alias("lower"), F.percentile("m", 1.0 - tail, F.col("weight_")).alias("upper"),
        F.sum("weight_").alias("resample_count"),
    )


def apply_rule(conditions: list[tuple[str, float | Column, int]]) -> Column:
    """Threshold rule: conditions of one group are alternatives, groups must all hold."""
    if not conditions:
        raise ValueError("rule has no conditions")
    groups: dict[int, Column] = {}
    for indicator, threshold, group in conditions:
        holds = F.col(indicator) >= threshold
        groups[group] = holds if group not in groups else groups[group] | holds
    result = F.lit(True)
    for holds in groups.values():
        result = result & holds
    return result


def select_rule(rows: DataFrame, rules: dict[str, Column], day: str, candidate: Column, reference: Column, min_day: int = 20,
                low: float = 0.10, high: float = 0.60) -> DataFrame:
    """Coverage and equal-day loss difference of every rule, and whether it is eligible."""
    flags = rows.select(day, candidate.alias("c_"), reference.alias("r_"), *[rule.alias(name) for name, rule in rules.items()])
    long = flags.unpivot([day, "c_", "r_"], list(rules), "rule_id", "on")
    hit = F.col("on")
    per_day = long.groupBy("rule_id", day).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.avg(F.when(hit, F.col("c_") - F.col("r_"))).alias("delta")
    )
    summary = per_day.groupBy("rule_id").agg(
        F.sum("hits").alias("scene_count"), (F.sum("hits") / F.sum("n")).alias("coverage"), F.min("hits").alias("least_day"), F.avg("delta").alias("equal_day_delta")
    )
    eligible = F.col("coverage").between(low, high) & (F.col("least_day") >= min_day)
    return summary.withColumn("eligible", eligible).withColumn(
        "selected", F.coalesce(F.col("rule_id") == F.min_by("rule_id", F.struct("equal_day_delta", "rule_id")).over(Window.partitionBy("eligible")), F.lit(False)) & eligible
    )


def method_summary(records: DataFrame, method: str, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation per method; a single record has deviation zero."""
    return records.groupBy(method).agg(
        F.count(F.lit(1)).alias("runs"),
        *[t for m in metrics for t in (F.avg(m).alias(f"{m}_mean"), F.when(F.count(m) > 1, F.stddev_samp(m)).otherwise(0.0).alias(f"{m}_sd"))],
    )


def seed_summary(records: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, least and greatest over seeds per metric; nulls are skipped."""
    long = records.unpivot(keys, metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def normalize(rows: DataFrame, features: list[str], train: Column) -> DataFrame:
    """Standardise by training mean and population deviation; a vanishing deviation counts as one."""
    stats = rows.filter(train).agg(*[t for f in features for t in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))])
    joined = one_row_join(rows, stats)
    scale = lambda f: F.when(F.col(f"s_{f}") < 1e-6, F.lit(1.0)).otherwise(F.col(f"s_{f}"))
    return joined.withColumns({f: (F.col(f) - F.col(f"m_{f}")) / scale(f) for f in features}).select(*rows.columns)


def project_capacity(measured: DataFrame, shared_bytes: DataFrame, scratch_bytes: int, peak_rss: int, ram_bytes: int,
                     free_bytes: int, reserve_bytes: int) -> DataFrame:
    """Bytes needed for the whole population from a sample, in whole numbers throughout.

    `measured` has airport, sample_rows, population_rows, direct_bytes. Shared bytes are apportioned to
    airports by sample rows with largest remainders.
    """
    whole = Window.partitionBy("family")
    joined = one_row_join(measured, shared_bytes).withColumn("family", F.lit("all"))
    total = F.sum("sample_rows").over(whole)
    product = F.col("shared").cast("decimal(38,0)") * F.col("sample_rows")
    split = joined.withColumn("rest_", product % total).withColumn("floor_", ((product - F.col("rest_")) / total).cast("long"))
    rank = Window.partitionBy("family").orderBy(F.desc("rest_"), "airport")
    left = F.col("shared") - F.sum("floor_").over(whole)
    given = split.withColumn("left_", left).withColumn("rank_", F.row_number().over(rank)).withColumn(
        "sample_bytes", F.col("direct_bytes") + F.col("floor_") + (F.col("rank_") <= F.col("left_")).cast("long")
    )
    # Whole parts and remainders are summed apart, so the final rounding up sees an exact integer sum.
    exact = F.col("sample_bytes").cast("decimal(38,0)") * F.col("population_rows")
    parts = given.withColumn("part_", (exact % F.col("sample_rows")).cast("long")).withColumn(
        "whole_", ((exact - F.col("part_")) / F.col("sample_rows")).cast("long")
    )
    summed = parts.groupBy("family").agg(
        F.sum("sample_bytes").alias("sample_bytes"),
        (F.sum("whole_") + F.ceil(F.round(F.sum(F.col("part_") / F.col("sample_rows")), 9)).cast("long")).alias("finalized_bytes"),
    )
    busy = F.greatest(F.lit(scratch_bytes), F.col("sample_bytes")).cast("decimal(38,0)")
    over = F.col("finalized_bytes").cast("decimal(38,0)") * (busy + F.col("sample_bytes"))
    rounded = over + F.col("sample_bytes") - 1
    return (
        summed.withColumn("peak_bytes", ((rounded - rounded % F.col("sample_bytes")) / F.col("sample_bytes")).cast("long"))
        .withColumn("required_bytes", F.expr(f"(peak_bytes * 3 + 1) div 2 + {reserve_bytes}"))
        .withColumn("disk_ok", F.lit(free_bytes) >= F.col("required_bytes"))
        .withColumn("memory_ok", F.lit(peak_rss <= 7 * ram_bytes // 10)).drop("family")
    )
