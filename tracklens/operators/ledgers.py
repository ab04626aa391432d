"""Duplicate resolution on a natural key: unique reports, membership, conflicts and conservation checks."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class DuplicateRule:
    """Which columns identify, describe and order the copies of one report."""

    keys: tuple[str, ...]
    age: str
    completeness: tuple[str, ...]
    core: tuple[str, ...]
    metadata: tuple[str, ...]
    order: tuple[str, ...]
    payload: tuple[str, ...]
    # Width of a block of the last (numeric) order column, used only inside groups above the threshold.
    block_rows: int = 65_536
    hot_threshold: int = 100_000


def age_class(age: Column) -> Column:
    finite = age.isNotNull() & ~F.isnan(age) & (F.abs(age) < float("inf"))
    return F.when(~finite, F.lit(2)).when(age >= 0, F.lit(0)).otherwise(F.lit(1))


def age_value(age: Column) -> Column:
    return F.when(age_class(age) == 2, F.lit(float("inf"))).otherwise(F.abs(age))


def completeness(fields: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for name in fields:
        total = total + F.col(name).isNotNull().cast("int")
    return total


def ranked(rows: DataFrame, rule: DuplicateRule) -> DataFrame:
    return (
        rows.withColumn("age_rank_class", age_class(F.col(rule.age)))
        .withColumn("age_rank_value", age_value(F.col(rule.age)))
        .withColumn("completeness_score", completeness(rule.completeness))
        .withColumn("incomplete_", -F.col("completeness_score"))
    )


def _differs(name: str) -> Column:
    """Members disagree; a null is a value of its own."""
    return (F.min(f"{name}_lo") != F.max(f"{name}_hi")) | (
        (F.sum(f"{name}_nulls") > 0) & (F.sum(f"{name}_nulls") < F.sum("copies"))
    )


def _bits(fields: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for index, name in enumerate(fields):
        total = total + F.when(_differs(name), F.lit(1 << index)).otherwise(F.lit(0))
    return total.cast("long")


def unique_reports(rows: DataFrame, rule: DuplicateRule) -> DataFrame:
    """One winner per natural key: least age class, least age, most complete, first in source order.

    Copies equal in rank collapse before the first shuffle, so a key with very many copies reaches the
    second one as a few rows. Both later groupings share that second shuffle.
    """
    keys = list(rule.keys)
    compared = tuple(dict.fromkeys(rule.core + rule.metadata))
    first = ranked(rows, rule).groupBy(*keys, "age_rank_class", "age_rank_value", "incomplete_").agg(
        F.min(F.struct(*rule.order, *rule.payload)).alias("best"),
        F.count(F.lit(1)).alias("copies"),
        *[F.min(c).alias(f"{c}_lo") for c in compared],
        *[F.max(c).alias(f"{c}_hi") for c in compared],
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_nulls") for c in compared],
    )
    same_age = first.repartition(*keys).groupBy(*keys, "age_rank_class", "age_rank_value").agg(
        F.min(F.struct("incomplete_", "best", F.col("copies").alias("same_completeness"))).alias("best"),
        F.sum("copies").alias("copies"),
        *[F.min(f"{c}_lo").alias(f"{c}_lo") for c in compared],
        *[F.max(f"{c}_hi").alias(f"{c}_hi") for c in compared],
        *[F.sum(f"{c}_nulls").alias(f"{c}_nulls") for c in compared],
    )
    whole = same_age.groupBy(*keys).agg(
        F.min(F.struct("age_rank_class", "age_rank_value", "best", F.col("copies").alias("same_age"))).alias("w"),
        F.sum("copies").alias("group_size"),
        _bits(rule.core).alias("core_difference_bits"),
        _bits(rule.metadata).alias("metadata_difference_bits"),
    )
    core, meta = F.col("core_difference_bits") != 0, F.col("metadata_difference_bits") != 0
    classification = (
        F.when(F.col("group_size") == 1, "singleton")
        .when(core & meta, "core_and_metadata_conflict")
        .when(core, "core_state_conflict")
        .when(meta, "metadata_conflict")
        .otherwise("identical")
    )
    reason = (
        F.when(F.col("group_size") == 1, "only_member")
        .when((F.col("w.same_age") == 1) & (F.col("w.age_rank_class") == 0), "min_nonnegative_age")
        .when(F.col("w.same_age") == 1, "closest_zero_negative_age")
        .when(F.col("w.best.same_completeness") == 1, "max_completeness_after_age_tie")
        .otherwise("stable_source_order_after_full_tie")
    )
    return whole.select(
        *keys, "group_size", (F.col("group_size") > 1).alias("is_duplicate"),
        classification.alias("duplicate_classification"), reason.alias("selection_reason"),
        "core_difference_bits", "metadata_difference_bits",
        F.col("w.age_rank_class").alias("age_rank_class"), F.col("w.age_rank_value").alias("age_rank_value"),
        (-F.col("w.best.incomplete_")).alias("completeness_score"),
        *[F.col(f"w.best.best.{c}").alias(c) for c in dict.fromkeys(rule.order + rule.payload)],
    )


def group_sizes(rows: DataFrame, rule: DuplicateRule) -> DataFrame:
    """Each natural key with its number of copies, for callers that need no winner; the same groups as `unique_reports`."""
    return rows.groupBy(*rule.keys).agg(F.count(F.lit(1)).alias("group_size"))


def membership(rows: DataFrame, unique: DataFrame, rule: DuplicateRule) -> DataFrame:
    """Every input row with its rank in its group. Very large groups are ranked block by block."""
    keys = list(rule.keys)
    facts = unique.select(*keys, "group_size", "selection_reason", "core_difference_bits", "metadata_difference_bits")
    joined = ranked(rows, rule).join(facts, keys)
    block = F.when(
        F.col("group_size") > rule.hot_threshold,
        F.struct("age_rank_class", "age_rank_value", "incomplete_", *rule.order[:-1], F.floor(F.col(rule.order[-1]) / rule.block_rows).alias("b")),
    )
    order = ["age_rank_class", "age_rank_value", "incomplete_", *rule.order]
    marked = joined.withColumn("blk_", block)
    local = marked.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys, "blk_").orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("blk_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.filter("blk_ IS NOT NULL").groupBy(*keys, "blk_").agg(F.count(F.lit(1)).alias("n_"))
        .withColumn("offset_", F.sum("n_").over(before)).filter("offset_ IS NOT NULL").drop("n_")
    )
    rank = F.col("rank_") + F.coalesce("offset_", F.lit(0))
    return (
        local.join(offsets, keys + ["blk_"], "left")
        .withColumn("dedup_rank", rank.cast("long"))
        .withColumn("selected", F.col("dedup_rank") == 1)
        .withColumn("selection_reason", F.when(F.col("dedup_rank") == 1, F.col("selection_reason")).otherwise("not_selected"))
        .drop("blk_", "rank_", "offset_", "incomplete_")
    )


def conflicts(unique: DataFrame) -> DataFrame:
    return unique.filter("core_difference_bits <> 0 OR metadata_difference_bits <> 0")


def conservation(parsed: DataFrame, bad: DataFrame, retained: DataFrame, members: DataFrame, unique: DataFrame,
                 conflict: DataFrame, rule: DuplicateRule, row_id: str) -> DataFrame:
    """Named invariants with their number of violations; all must be zero."""
    keys = list(rule.keys)

    def violations(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("invariant"), "violations")

    ids = lambda df: df.select(row_id)
    seen = ids(parsed).unionByName(ids(bad))
    checks = [
        violations("retained_except_parsed_or_bad", ids(retained).subtract(seen)),
        violations("parsed_or_bad_except_retained", seen.subtract(ids(retained))),
        violations("parsed_and_bad_overlap", ids(parsed).join(ids(bad), row_id, "left_semi")),
        violations("parsed_except_membership", ids(parsed).subtract(ids(members))),
        violations("membership_except_parsed", ids(members).subtract(ids(parsed))),
        violations("membership_without_unique", members.join(unique, keys, "left_anti")),
        violations("conflict_without_unique", conflict.join(unique, keys, "left_anti")),
        violations("unique_without_membership", unique.join(members, keys, "left_anti")),
        violations("repeated_unique_key", unique.groupBy(*keys).count().filter("count > 1")),
        violations("repeated_membership_row", members.groupBy(row_id).count().filter("count > 1")),
        violations("not_one_selected", members.groupBy(*keys).agg(F.sum(F.col("selected").cast("int")).alias("s")).filter("s <> 1")),
        violations("rank_out_of_range", members.groupBy(*keys, "group_size").agg(
            F.count(F.lit(1)).alias("n"), F.max("dedup_rank").alias("m"), F.min("dedup_rank").alias("l"),
        ).filter("n <> group_size OR m <> group_size OR l <> 1")),
        violations("conflict_missing", unique.filter("core_difference_bits <> 0 OR metadata_difference_bits <> 0").join(conflict, keys, "left_anti")),
    ]
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result


def resolve_two_way(rows: DataFrame, keys: list[str], age: str, complete: tuple[str, ...], state: tuple[str, ...],
                    order: tuple[str, ...], payload: tuple[str, ...]) -> DataFrame:
    """The earlier, simpler rule: identical or conflicting state, with its own completeness set."""
    score = F.lit(0)
    for name in complete:
        score = score + (F.col(name).isNotNull() & (F.col(name).cast("string") != "")).cast("int")
    tagged = rows.withColumn("ac_", age_class(F.col(age))).withColumn("av_", age_value(F.col(age))).withColumn("nc_", -score)
    nulls = {c: F.sum(F.col(c).isNull().cast("long")) for c in state}
    conflict = F.lit(False)
    for c in state:
        conflict = conflict | F.coalesce(F.min(c) != F.max(c), F.lit(False)) | ((nulls[c] > 0) & (nulls[c] < F.count(F.lit(1))))
    best = tagged.groupBy(*keys).agg(
        F.min(F.struct("ac_", "av_", "nc_", *order, *payload)).alias("w"),
        F.count(F.lit(1)).alias("group_size"), conflict.alias("conflict"),
    )
    return best.select(
        *keys, "group_size", "conflict",
        F.when(F.col("conflict"), "conflicting_state").otherwise("identical_state").alias("classification"),
        *[F.col(f"w.{c}").alias(c) for c in dict.fromkeys(order + payload)],
    )


def duplicate_profile(rows: DataFrame, keys: list[str], age: str, state: tuple[str, ...], order: list[str],
                      block: Column) -> DataFrame:
    """Counts of groups, duplicates, state agreement and ages that never decrease in arrival order."""
    from tracklens.operators.ordered import blocked_lag

    conflict = F.lit(False)
    for c in state:
        conflict = conflict | F.coalesce(F.min(c) != F.max(c), F.lit(False)) | (
            (F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))
        )
    finite = F.col(age).isNotNull() & ~F.isnan(age) & (F.abs(F.col(age)) < float("inf"))
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), conflict.alias("conflict"), F.count(F.when(finite, 1)).alias("ages")
    )
    aged = blocked_lag(rows.filter(finite).select(*keys, *order, age), keys, block, order, [age])
    falls = aged.filter(F.col(f"prev.{age}") > F.col(age)).select(*keys).distinct().withColumn("falls", F.lit(True))
    per = groups.join(falls, keys, "left")
    dup = F.col("n") > 1
    return per.agg(
        F.count(F.lit(1)).alias("groups_total"),
        F.count(F.when(dup, 1)).alias("duplicate_groups"),
        F.count(F.when(dup & ~F.col("conflict"), 1)).alias("identical_state_groups"),
        F.count(F.when(dup & F.col("conflict"), 1)).alias("conflicting_state_groups"),
        F.count(F.when(dup & (F.col("ages") >= 2) & F.col("falls").isNull(), 1)).alias("nondecreasing_age_groups"),
    )
