"""Ordered operators that stay balanced when one key holds a large share of the rows.

A key's rows are cut into blocks that follow the order; each block is handled on its own and the blocks
are stitched with one summary row per block. Keys must not be null.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F


def _blocked(df: DataFrame, keys: list[str], block: Column | str, order: list[str]):
    """`block` names an existing column, so several operators can share one partitioning, or gives a new one."""
    marked = df if isinstance(block, str) else df.withColumn("blk_", block)
    name = block if isinstance(block, str) else "blk_"
    return marked, name, Window.partitionBy(*keys, name).orderBy(*order)


def blocked_lag(df: DataFrame, keys: list[str], block: Column | str, order: list[str], values: list[str], out: str = "prev") -> DataFrame:
    """Add struct `out` with the values of the preceding row of the key; null on the first row."""
    marked, blk, window = _blocked(df, keys, block, order)
    local = marked.withColumn("lag_", F.lag(F.struct(*values)).over(window))
    tails = (
        marked.groupBy(*keys, blk)
        .agg(F.max(F.struct(F.struct(*order).alias("o"), F.struct(*values).alias("v"))).alias("tail_"))
        .withColumn("carry_", F.lag("tail_.v").over(Window.partitionBy(*keys).orderBy(blk)))
        .filter("carry_ IS NOT NULL")
        .select(*keys, blk, "carry_")
    )
    joined = local.join(tails, keys + [blk], "left")
    return joined.select(*df.columns, F.coalesce("lag_", "carry_").alias(out))


def blocked_row_number(df: DataFrame, keys: list[str], block: Column | str, order: list[str], out: str) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return blocked_running_sum(df.withColumn("one_", F.lit(1).cast("long")), keys, block, order, "one_", out).drop("one_")


def blocked_running_sum(df: DataFrame, keys: list[str], block: Column | str, order: list[str], value: str, out: str) -> DataFrame:
    """Add the running sum of `value` within each key; the order must be unique."""
    marked, blk, window = _blocked(df, keys, block, order)
    local = marked.withColumn("run_", F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, blk).agg(F.sum(value).alias("part_"))
        .withColumn("offset_", F.sum("part_").over(before))
        .filter("offset_ IS NOT NULL")
        .select(*keys, blk, "offset_")
    )
    joined = local.join(offsets, keys + [blk], "left")
    return joined.select(*df.columns, (F.col("run_") + F.coalesce("offset_", F.lit(0))).alias(out))


def first_per_group(df: DataFrame, keys: list[str], order: list[str], limit: int, out: str = "rank", lanes: int = 64) -> DataFrame:
    """The first `limit` rows of each key in a unique order, with their rank.

    Each key is first cut down within hashed lanes, so a key with most of the rows reaches the final ranking
    with at most lanes * limit of them.
    """
    lane = df.withColumn("lane_", F.pmod(F.xxhash64(*order), F.lit(lanes)))
    local = Window.partitionBy(*keys, "lane_").orderBy(*order)
    cut = lane.withColumn("pre_", F.row_number().over(local)).filter(F.col("pre_") <= limit).drop("pre_", "lane_")
    return cut.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= limit)


def value_counts(df: DataFrame, keys: list[str], value: str, block: Column) -> DataFrame:
    """Distinct values of each key with their running count `c_` and the key's total `all_`.

    Rows collapse to distinct values before anything is ordered, and those are ordered block by block.
    """
    histogram = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_"))
    running = blocked_running_sum(histogram, keys, block, [value], "n_", "c_")
    totals = histogram.groupBy(*keys).agg(F.sum("n_").alias("all_"))
    if keys:
        return running.join(totals, keys)
    return running.select("*", F.lit(1).alias("one_")).join(totals.select("*", F.lit(1).alias("one_")), "one_").drop("one_")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], block: Column) -> DataFrame:
    """Linearly interpolated quantiles from running counts of distinct values."""
    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("c_") > rank, F.col(value))).cast("double")

    terms = []
    for name, p in probabilities.items():
        position = (F.col("all_") - 1) * F.lit(float(p))
        weight = F.max(position - F.floor(position))
        low, high = at(F.floor(position)), at(F.ceil(position))
        terms.append((low + (high - low) * weight).alias(name))
    return value_counts(df, keys, value, block).groupBy(*keys).agg(*terms)
