"""Duplicate-ledger queries over the line-item table."""

from pyspark.sql import functions as F

from tracklens.operators import ledgers as L
from tracklens.plans.sql import LINES
from tracklens.session import stage_table
from tracklens.sources.tables import lineitem_rows

QUERIES: dict = {}
ORACLE: dict = {}

RULE = L.DuplicateRule(
    keys=("k1", "k2"), age="age_s", completeness=("lat_deg", "altitude_m", "age_s"),
    core=("lat_deg", "lon_deg", "altitude_m", "speed_mps"), metadata=("age_s", "tail"),
    order=("s1", "s2", "s3", "s4"), payload=("lat_deg", "altitude_m", "age_s"),
)

RANKED = LINES + """, ranked AS (
 SELECT *, CASE WHEN age_s IS NULL THEN 2 WHEN age_s >= 0 THEN 0 ELSE 1 END AS ac,
  CASE WHEN age_s IS NULL THEN CAST('inf' AS DOUBLE) ELSE abs(age_s) END AS av,
  CAST(lat_deg IS NOT NULL AS INT) + CAST(altitude_m IS NOT NULL AS INT) + CAST(age_s IS NOT NULL AS INT) AS comp FROM lines),
numbered AS (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY ac, av, comp DESC, s1, s2, s3, s4) AS rn,
  count(*) OVER (PARTITION BY k1, k2) AS n FROM ranked),
firsts AS (SELECT * FROM numbered WHERE rn = 1),
grp AS (SELECT r.k1, r.k2, any_value(f.n) AS n,
  count(*) FILTER (WHERE r.ac = f.ac AND r.av = f.av) AS same_age,
  count(*) FILTER (WHERE r.ac = f.ac AND r.av = f.av AND r.comp = f.comp) AS same_comp,
  CAST(1 * max(CAST(r.lat_deg IS DISTINCT FROM f.lat_deg AS INT)) + 2 * max(CAST(r.lon_deg IS DISTINCT FROM f.lon_deg AS INT))
  + 4 * max(CAST(r.altitude_m IS DISTINCT FROM f.altitude_m AS INT)) + 8 * max(CAST(r.speed_mps IS DISTINCT FROM f.speed_mps AS INT)) AS BIGINT) AS core,
  CAST(1 * max(CAST(r.age_s IS DISTINCT FROM f.age_s AS INT)) + 2 * max(CAST(r.tail IS DISTINCT FROM f.tail AS INT)) AS BIGINT) AS meta
 FROM ranked r JOIN firsts f ON r.k1 = f.k1 AND r.k2 = f.k2 GROUP BY r.k1, r.k2),
uniq AS (SELECT g.k1, g.k2, g.n AS group_size, g.core AS core_difference_bits, g.meta AS metadata_difference_bits,
  CASE WHEN g.n = 1 THEN 'singleton' WHEN core > 0 AND meta > 0 THEN 'core_and_metadata_conflict' WHEN core > 0 THEN 'core_state_conflict'
   WHEN meta > 0 THEN 'metadata_conflict' ELSE 'identical' END AS duplicate_classification,
  CASE WHEN g.n = 1 THEN 'only_member' WHEN same_age = 1 AND f.ac = 0 THEN 'min_nonnegative_age' WHEN same_age = 1 THEN 'closest_zero_negative_age'
   WHEN same_comp = 1 THEN 'max_completeness_after_age_tie' ELSE 'stable_source_order_after_full_tie' END AS selection_reason,
  f.ac, f.av, f.comp, f.s1, f.s2, f.s3, f.s4, f.lat_deg, f.altitude_m, f.age_s
 FROM grp g JOIN firsts f ON g.k1 = f.k1 AND g.k2 = f.k2)"""


def _unique(spark, folder):
    return L.unique_reports(lineitem_rows(spark, folder), RULE)


def agg_01_unique_reports(spark, folder):
    return _unique(spark, folder).select(
        "k1", "k2", "group_size", "s1", "s2", "s3", "s4", "lat_deg", "altitude_m", "age_s", "duplicate_classification",
        "selection_reason",
    )


QUERIES["agg_01_unique_reports"] = agg_01_unique_reports
ORACLE["agg_01_unique_reports"] = f"""WITH {RANKED} SELECT k1, k2, group_size, s1, s2, s3, s4, lat_deg, altitude_m, age_s,
 duplicate_classification, selection_reason FROM uniq"""


def agg_02_age_rank(spark, folder):
    ranked = L.ranked(lineitem_rows(spark, folder), RULE)
    return ranked.groupBy(F.col("age_rank_class").cast("long").alias("age_rank_class")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("age_rank_class") < 2, F.col("age_rank_value"))).alias("least"),
        F.max(F.when(F.col("age_rank_class") < 2, F.col("age_rank_value"))).alias("most"),
    )


QUERIES["agg_02_age_rank"] = agg_02_age_rank
ORACLE["agg_02_age_rank"] = f"""WITH {RANKED} SELECT CAST(ac AS BIGINT) AS age_rank_class, count(*) AS n,
 min(av) FILTER (WHERE ac < 2) AS least, max(av) FILTER (WHERE ac < 2) AS most FROM ranked GROUP BY ac"""


def agg_03_completeness(spark, folder):
    ranked = L.ranked(lineitem_rows(spark, folder), RULE)
    return ranked.groupBy(F.col("completeness_score").cast("long").alias("completeness_score")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["agg_03_completeness"] = agg_03_completeness
ORACLE["agg_03_completeness"] = f"""WITH {RANKED} SELECT CAST(comp AS BIGINT) AS completeness_score, count(*) AS n FROM ranked GROUP BY comp"""


def agg_04_difference_bits(spark, folder):
    return _unique(spark, folder).groupBy("core_difference_bits", "metadata_difference_bits").agg(
        F.count(F.lit(1)).alias("n"), F.sum("group_size").alias("n_rows")
    )


QUERIES["agg_04_difference_bits"] = agg_04_difference_bits
ORACLE["agg_04_difference_bits"] = f"""WITH {RANKED} SELECT core_difference_bits, metadata_difference_bits, count(*) AS n,
 CAST(sum(group_size) AS BIGINT) AS n_rows FROM uniq GROUP BY ALL"""


def agg_05_classification(spark, folder):
    return _unique(spark, folder).groupBy("duplicate_classification").agg(F.count(F.lit(1)).alias("n"))


QUERIES["agg_05_classification"] = agg_05_classification
ORACLE["agg_05_classification"] = f"""WITH {RANKED} SELECT duplicate_classification, count(*) AS n FROM uniq GROUP BY ALL"""


def agg_06_winner_reason(spark, folder):
    return _unique(spark, folder).groupBy("selection_reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES["agg_06_winner_reason"] = agg_06_winner_reason
ORACLE["agg_06_winner_reason"] = f"""WITH {RANKED} SELECT selection_reason, count(*) AS n FROM uniq GROUP BY ALL"""


def win_01_membership(spark, folder):
    rows = lineitem_rows(spark, folder)
    return L.membership(rows, L.unique_reports(rows, RULE), RULE).select(
        "k1", "k2", "s1", "s2", "s3", "s4", "group_size", "dedup_rank", "selected", "selection_reason",
        F.col("age_rank_class").cast("long").alias("age_rank_class"),
        F.col("completeness_score").cast("long").alias("completeness_score"), "core_difference_bits",
    )


QUERIES["win_01_membership"] = win_01_membership
ORACLE["win_01_membership"] = f"""WITH {RANKED} SELECT m.k1, m.k2, m.s1, m.s2, m.s3, m.s4, m.n AS group_size, m.rn AS dedup_rank, m.rn = 1 AS selected,
 CASE WHEN m.rn = 1 THEN u.selection_reason ELSE 'not_selected' END AS selection_reason, CAST(m.ac AS BIGINT) AS age_rank_class,
 CAST(m.comp AS BIGINT) AS completeness_score, u.core_difference_bits FROM numbered m JOIN uniq u ON m.k1 = u.k1 AND m.k2 = u.k2"""


def agg_01_conflicts(spark, folder):
    return L.conflicts(_unique(spark, folder)).select(
        "k1", "k2", "group_size", "core_difference_bits", "metadata_difference_bits", "duplicate_classification"
    )


QUERIES["agg_01_conflicts"] = agg_01_conflicts
ORACLE["agg_01_conflicts"] = f"""WITH {RANKED} SELECT k1, k2, group_size, core_difference_bits, metadata_difference_bits, duplicate_classification
 FROM uniq WHERE core_difference_bits > 0 OR metadata_difference_bits > 0"""


def agg_21_conservation(spark, folder):
    rows = lineitem_rows(spark, folder).withColumn("raw_row_id", F.concat_ws("-", "k1", "k2", "s1", "s2", "s3", "s4"))
    unreadable = F.coalesce(F.col("age_s") > 20, F.lit(False))
    parsed, bad = rows.filter(~unreadable), rows.filter(unreadable)
    unique = stage_table(L.unique_reports(parsed, RULE), "unique")
    members = stage_table(L.membership(parsed, unique, RULE), "members")
    return L.conservation(parsed, bad, rows, members, unique, L.conflicts(unique), RULE, "raw_row_id")


QUERIES["agg_21_conservation"] = agg_21_conservation
ORACLE["agg_21_conservation"] = """SELECT unnest(['retained_except_parsed_or_bad','parsed_or_bad_except_retained','parsed_and_bad_overlap',
 'parsed_except_membership','membership_except_parsed','membership_without_unique','conflict_without_unique','unique_without_membership',
 'repeated_unique_key','repeated_membership_row','not_one_selected','rank_out_of_range','conflict_missing']) AS invariant, CAST(0 AS BIGINT) AS violations"""


def agg_21_excess_rows(spark, folder):
    unique = L.group_sizes(lineitem_rows(spark, folder), RULE)
    return unique.agg(
        F.count(F.lit(1)).alias("unique_reports"), F.sum("group_size").alias("parsed_rows"),
        F.sum(F.col("group_size") - 1).alias("excess_rows"), F.count(F.when(F.col("group_size") > 1, 1)).alias("duplicate_groups"),
    )


QUERIES["agg_21_excess_rows"] = agg_21_excess_rows
ORACLE["agg_21_excess_rows"] = """SELECT count(*) AS unique_reports, CAST(sum(n) AS BIGINT) AS parsed_rows, CAST(sum(n - 1) AS BIGINT) AS excess_rows,
 count(*) FILTER (WHERE n > 1) AS duplicate_groups FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)"""


def agg_07_two_way(spark, folder):
    resolved = L.resolve_two_way(
        lineitem_rows(spark, folder), ["k1", "k2"], "age_s",
        ("age_s", "lat_deg", "lon_deg", "altitude_m", "speed_mps", "tail"),
        ("lat_deg", "lon_deg", "altitude_m", "speed_mps"), ("s2", "s1", "s3", "s4"), ("lat_deg", "age_s"),
    )
    return resolved.select("k1", "k2", "group_size", "classification", "conflict", "s1", "s2", "lat_deg", "age_s")


QUERIES["agg_07_two_way"] = agg_07_two_way
ORACLE["agg_07_two_way"] = f"""WITH {LINES}, o AS (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY
  CASE WHEN age_s IS NULL THEN 2 WHEN age_s >= 0 THEN 0 ELSE 1 END, coalesce(abs(age_s), 0),
  CAST(age_s IS NOT NULL AS INT) + CAST(altitude_m IS NOT NULL AS INT) + CAST(tail IS NOT NULL AND tail <> '' AS INT) DESC, s2, s1, s3, s4) AS rn,
  count(*) OVER (PARTITION BY k1, k2) AS n FROM lines),
 st AS (SELECT k1, k2, count(*) AS states FROM (SELECT DISTINCT k1, k2, lat_deg, lon_deg, altitude_m, speed_mps FROM lines) GROUP BY ALL)
SELECT o.k1, o.k2, n AS group_size, CASE WHEN states > 1 THEN 'conflicting_state' ELSE 'identical_state' END AS classification, states > 1 AS conflict,
 s1, s2, lat_deg, age_s FROM o JOIN st ON o.k1 = st.k1 AND o.k2 = st.k2 WHERE rn = 1"""


def agg_16_duplicate_profile(spark, folder):
    rows = lineitem_rows(spark, folder)
    return L.duplicate_profile(
        rows, ["k1", "k2"], "age_s", ("lat_deg", "lon_deg", "altitude_m", "speed_mps"),
        ["s1", "s2", "s3", "s4"], F.floor(F.col("s1") / 65536),
    )


QUERIES["agg_16_duplicate_profile"] = agg_16_duplicate_profile
ORACLE["agg_16_duplicate_profile"] = f"""WITH {LINES}, g AS (SELECT k1, k2, count(*) AS n FROM lines GROUP BY ALL),
 st AS (SELECT k1, k2, count(*) AS states FROM (SELECT DISTINCT k1, k2, lat_deg, lon_deg, altitude_m, speed_mps FROM lines) GROUP BY ALL),
 ag AS (SELECT k1, k2, count(*) AS ages, min(step) AS worst FROM (SELECT k1, k2, age_s - lag(age_s) OVER (PARTITION BY k1, k2 ORDER BY s1, s2, s3, s4) AS step
  FROM lines WHERE age_s IS NOT NULL) GROUP BY ALL)
SELECT count(*) AS groups_total, count(*) FILTER (WHERE n > 1) AS duplicate_groups, count(*) FILTER (WHERE n > 1 AND states = 1) AS identical_state_groups,
 count(*) FILTER (WHERE n > 1 AND states > 1) AS conflicting_state_groups, count(*) FILTER (WHERE n > 1 AND ages >= 2 AND worst >= 0) AS nondecreasing_age_groups
FROM g JOIN st USING (k1, k2) LEFT JOIN ag USING (k1, k2)"""


def join_06_group_members(spark, folder):
    rows = lineitem_rows(spark, folder)
    groups = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return rows.join(groups, ["k1", "k2"]).select("k1", "k2", "s1", "s2", "s3", "s4", "group_size")


QUERIES["join_06_group_members"] = join_06_group_members
ORACLE["join_06_group_members"] = f"""WITH {LINES}, g AS (SELECT k1, k2, count(*) AS group_size FROM lines GROUP BY ALL HAVING count(*) > 1)
SELECT k1, k2, s1, s2, s3, s4, group_size FROM lines JOIN g USING (k1, k2)"""


def join_07_orphans(spark, folder):
    """Unique keys without an order and orders without a unique key."""
    from tracklens.sources.tables import load

    unique = _unique(spark, folder).select("k1", "k2")
    orders = load(spark, folder, "orders").select(F.col("o_orderkey").alias("k1"))
    left = unique.join(orders, "k1", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unique_without_order").alias("side"), "n")
    right = orders.join(unique, "k1", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("order_without_unique").alias("side"), "n")
    return left.unionByName(right)


QUERIES["join_07_orphans"] = join_07_orphans
ORACLE["join_07_orphans"] = """SELECT 'unique_without_order' AS side, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l
 WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order_without_unique', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""


def join_08_disjoint(spark, folder):
    rows = lineitem_rows(spark, folder)
    parsed, bad = rows.filter("age_s IS NOT NULL"), rows.filter("age_s IS NULL")
    keys = ["k1", "k2", "s1", "s2", "s3", "s4"]
    return parsed.join(bad, keys, "left_semi").agg(F.count(F.lit(1)).alias("shared_rows"))


QUERIES["join_08_disjoint"] = join_08_disjoint
ORACLE["join_08_disjoint"] = f"""WITH {LINES} SELECT count(*) AS shared_rows FROM lines p WHERE age_s IS NOT NULL AND EXISTS (
 SELECT 1 FROM lines b WHERE b.age_s IS NULL AND b.k1 = p.k1 AND b.k2 = p.k2 AND b.s1 = p.s1 AND b.s2 = p.s2 AND b.s3 = p.s3 AND b.s4 = p.s4)"""


def set_01_retained(spark, folder):
    rows = lineitem_rows(spark, folder).select("k1", "k2", "age_s")
    parsed = rows.filter("age_s >= 0").select("k1", "k2")
    bad = rows.filter("age_s < 0").select("k1", "k2")
    kept = rows.select("k1", "k2")
    return kept.subtract(parsed.union(bad)).withColumn("side", F.lit("retained_only"))


QUERIES["set_01_retained"] = set_01_retained
ORACLE["set_01_retained"] = f"""WITH {LINES} SELECT k1, k2, 'retained_only' AS side FROM (SELECT k1, k2 FROM lines EXCEPT
 (SELECT k1, k2 FROM lines WHERE age_s >= 0 UNION SELECT k1, k2 FROM lines WHERE age_s < 0))"""


def set_02_membership(spark, folder):
    rows = lineitem_rows(spark, folder)
    members = L.membership(rows, L.unique_reports(rows, RULE), RULE)
    key = ["k1", "k2", "s1", "s2", "s3", "s4"]
    a = rows.select(*key).subtract(members.select(*key)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("parsed_only").alias("side"), "n")
    b = members.select(*key).subtract(rows.select(*key)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("membership_only").alias("side"), "n")
    losers = members.filter("NOT selected").agg(F.count(F.lit(1)).alias("n")).select(F.lit("not_selected").alias("side"), "n")
    return a.unionByName(b).unionByName(losers)


QUERIES["set_02_membership"] = set_02_membership
ORACLE["set_02_membership"] = f"""WITH {RANKED} SELECT 'parsed_only' AS side, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'membership_only', 0
 UNION ALL SELECT 'not_selected', count(*) FROM numbered WHERE rn > 1"""
