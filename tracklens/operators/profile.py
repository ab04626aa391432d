"""Field profiles: mergeable counts, extremes, distinct estimates and quantiles per stratum and in total."""

from pyspark.sql import Column, DataFrame, functions as F

from tracklens.operators.evaluate import one_row_join
from tracklens.operators.ordered import first_per_group


def field_profiles(rows: DataFrame, fields: list[str], strata: list[str], total_by: str, errors: str | None = None) -> DataFrame:
    """One record per (stratum, field) and per (total_by, field); totals carry null strata.

    All fields are measured in one wide pass; grouping sets copy each row twice, not once per field.
    """
    terms: list[Column] = []
    for f in fields:
        failed = F.element_at(errors, f).isNotNull() if errors else F.lit(False)
        value = F.when(~F.coalesce(failed, F.lit(False)), F.col(f))
        terms.append(F.struct(
            F.lit(f).alias("field"), F.count(F.lit(1)).alias("total"),
            F.count_if(F.col(f).isNull() & ~F.coalesce(failed, F.lit(False))).alias("missing"),
            F.count_if(failed).alias("invalid"),
            F.min(value.cast("double")).alias("minimum"), F.max(value.cast("double")).alias("maximum"),
            F.approx_count_distinct(value).alias("distinct_estimate"),
            F.percentile_approx(value.cast("double"), [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99], 10_000).alias("quantiles"),
        ).alias(f"m_{f}"))
    sets = [[F.col(c) for c in [total_by, *strata]], [F.col(total_by)]]
    wide = rows.groupingSets(sets, total_by, *strata).agg(*terms, F.grouping_id().alias("gid"))
    return wide.select(
        total_by, *strata, (F.col("gid") != 0).alias("is_total"), F.explode(F.array(*[F.col(f"m_{f}") for f in fields])).alias("m")
    ).select(total_by, *strata, "is_total", "m.*")


def profile_violations(profiles: DataFrame, total_by: str) -> DataFrame:
    """Checks on profiles: category counts, quantile order, and strata adding up to the total."""
    sums = profiles.groupBy(total_by, "field").agg(
        F.sum(F.when(~F.col("is_total"), F.col("total"))).alias("strata_total"),
        F.max(F.when(F.col("is_total"), F.col("total"))).alias("whole_total"),
    )
    counts = profiles.agg(
        F.count_if(F.col("missing") + F.col("invalid") > F.col("total")).alias("category_overflow"),
        F.count_if(F.col("quantiles").isNotNull() & (F.array_sort("quantiles") != F.col("quantiles"))).alias("unordered_quantiles"),
        F.count_if(F.col("minimum") > F.col("maximum")).alias("inverted_extremes"),
    )
    return one_row_join(counts, sums.agg(F.count_if(~F.col("strata_total").eqNullSafe(F.col("whole_total"))).alias("strata_mismatch")))


def bottom_hash_sample(rows: DataFrame, keys: list[str], identity: Column, value: str, capacity: int) -> DataFrame:
    """Deterministic sample: the `capacity` rows with the smallest identity hash."""
    hashed = rows.select(*keys, value, F.sha2(identity, 256).alias("priority")).filter(F.col(value).isNotNull())
    return first_per_group(hashed, keys, ["priority", value], capacity).drop("rank")


def sample_quantiles(sample: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Linearly interpolated quantiles of a bounded sample."""
    return sample.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"),
        *[F.percentile(value, p).alias(f"p{round(p * 100):02d}") for p in probabilities],
    )


def distinct_sketches(rows: DataFrame, keys: list[str], field: str, precision: int = 12) -> DataFrame:
    """Distinct-count sketches as rows: the greatest rank in each register, from the SHA-256 of the value's text.

    The last `precision` bits of the digest name the register; the rank is one more than the leading zeros of the rest. Registers
    without a value have no row, null values count for nothing, and any engine gets the same registers from the same text.
    """
    if not 4 <= precision <= 18:
        raise ValueError("precision must be between 4 and 18")
    hashed = rows.filter(F.col(field).isNotNull()).select(*keys, F.sha2(F.col(field).cast("string"), 256).alias("digest_"))
    register = F.conv(F.substring("digest_", 60, 5), 16, 10).cast("long").bitwiseAND(F.lit((1 << precision) - 1))
    body = F.ltrim("digest_", F.lit("0"))
    in_digit = F.translate(F.substring(body, 1, 1), "123456789abcdef", "322111100000000").cast("int")
    zeros = (F.lit(64) - F.length(body)) * 4 + F.coalesce(in_digit, F.lit(0))
    rank = F.least(zeros, F.lit(256 - precision)) + 1
    return hashed.select(*keys, register.alias("register"), rank.alias("rank")).groupBy(*keys, "register").agg(F.max("rank").alias("rank"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Union of sketches: the greatest rank of each register."""
    return sketches.groupBy(*keys, "register").agg(F.max("rank").alias("rank"))


def sketch_estimates(sketches: DataFrame, keys: list[str], precision: int = 12) -> DataFrame:
    """Distinct count of each sketch: the raw estimate, or linear counting where it is small and registers are empty.

    The relative standard error is 1.04 / sqrt(2^precision).
    """
    m = 1 << precision
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1.0 + 1.079 / m))  # fixed values of the published estimator
    empty = F.lit(m) - F.count(F.lit(1))
    mass = F.sum(F.pow(F.lit(2.0), -F.col("rank"))) + empty
    per = sketches.groupBy(*keys).agg(empty.alias("empty_"), (F.lit(alpha * m * m) / mass).alias("raw_"))
    small = (F.col("raw_") <= 2.5 * m) & (F.col("empty_") > 0)
    return per.select(*keys, F.when(small, m * F.log(m / F.col("empty_"))).otherwise(F.col("raw_")).alias("distinct_estimate"))
