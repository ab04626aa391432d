"""Duplicate resolution against a plain-Python statement of the rule, with very large groups split."""

import dataclasses
import math
import random

import pytest
from pyspark.sql import functions as F

from tracklens.operators import duplicates as D, ledgers as L
from tracklens.operators.ordered import blocked_lag, blocked_row_number, blocked_running_sum

RULE = L.DuplicateRule(keys=("k",), age="age", completeness=("a", "b", "age"), core=("a", "b"), metadata=("age", "t"), order=("s",), payload=("a", "b", "age"), block_rows=3)
SCHEMA = "k string, age double, a double, b double, t string, s long"


def rank(row):
    age = row[1]
    c, v = (2, math.inf) if age is None or not math.isfinite(age) else ((0, age) if age >= 0 else (1, -age))
    return (c, v, -sum(x is not None for x in (row[2], row[3], row[1])), row[5])


def make(seed, n=150):
    rng = random.Random(seed)
    return [(f"k{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7])}", rng.choice([None, -2.0, -1.0, 0.0, 1.0, 2.0]), rng.choice([1.0, 1.0, 1.0, None]), rng.choice([0.0, -0.0]), rng.choice(["x", "x", "y"]), i) for i in range(n)]


@pytest.mark.parametrize("threshold", [5, 100_000])
def test_ledgers_match_rule(spark, threshold):
    rows = make(11)
    rule = dataclasses.replace(RULE, hot_threshold=threshold)
    df = spark.createDataFrame(rows, SCHEMA)
    unique = L.unique_reports(df, rule)
    members = {(r.k, r.s): r.dedup_rank for r in L.membership(df, unique, rule).collect()}
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    got = {r.k: r for r in unique.collect()}
    assert set(got) == set(groups) and len(members) == len(rows)
    for key, group in groups.items():
        ordered = sorted(group, key=rank)
        assert [members[key, r[5]] for r in ordered] == list(range(1, len(group) + 1))
        first = ordered[0]
        assert got[key].s == first[5] and got[key].group_size == len(group)
        core = sum(1 << i for i, c in enumerate((2, 3)) if len({r[c] for r in group}) > 1)
        meta = sum(1 << i for i, c in enumerate((1, 4)) if len({r[c] for r in group}) > 1)
        assert (got[key].core_difference_bits, got[key].metadata_difference_bits) == (core, meta)
        same_age = [r for r in group if rank(r)[:2] == rank(first)[:2]]
        same = [r for r in same_age if rank(r)[2] == rank(first)[2]]
        reason = ("only_member" if len(group) == 1 else ("min_nonnegative_age" if rank(first)[0] == 0 else "closest_zero_negative_age") if len(same_age) == 1
                  else "max_completeness_after_age_tie" if len(same) == 1 else "stable_source_order_after_full_tie")
        assert got[key].selection_reason == reason


def test_nonfinite_ages_rank_last(spark):
    rows = [("k", float("nan"), 1.0, 1.0, "x", 1), ("k", float("inf"), 1.0, 1.0, "x", 2), ("k", -5.0, None, 1.0, "x", 3), ("k", 9.0, None, None, "x", 4)]
    assert L.unique_reports(spark.createDataFrame(rows, SCHEMA), RULE).first().s == 4


def test_conservation_reports_damage(spark):
    rows = spark.createDataFrame(make(5), SCHEMA).withColumn("id", F.col("s").cast("string"))
    parsed, bad = rows.filter("s % 10 <> 0"), rows.filter("s % 10 = 0")
    unique = L.unique_reports(parsed, RULE)
    members = L.membership(parsed, unique, RULE)
    fine = {r.invariant: r.violations for r in L.conservation(parsed, bad, rows, members, unique, L.conflicts(unique), RULE, "id").collect()}
    assert len(fine) == 13 and not any(fine.values())
    hurt = {r.invariant: r.violations for r in L.conservation(parsed, bad.filter("s <> 0"), rows, members.filter("s <> 1"), unique, L.conflicts(unique), RULE, "id").collect()}
    assert hurt["retained_except_parsed_or_bad"] == 1 and hurt["parsed_except_membership"] == 1 and hurt["rank_out_of_range"] >= 1


def test_blocked_operators(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else f"c{rng.randint(0, 3)}", i, rng.randint(-5, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    block = F.floor(F.col("i") / 7)
    lag = {(r.k, r.i): r.prev and r.prev.v for r in blocked_lag(df, ["k"], block, ["i"], ["v"]).collect()}
    total = {(r.k, r.i): r.t for r in blocked_running_sum(df, ["k"], block, ["i"], "v", "t").collect()}
    number = {(r.k, r.i): r.n for r in blocked_row_number(df, ["k"], block, ["i"], "n").collect()}
    last, sums, seen = {}, {}, {}
    for k, i, v in rows:
        sums[k], seen[k] = sums.get(k, 0) + v, seen.get(k, 0) + 1
        assert (lag[k, i], total[k, i], number[k, i]) == (last.get(k), sums[k], seen[k])
        last[k] = v


def test_state_runs_cross_blocks(spark):
    rows = [("P", "A", t, "S0", 0, r, 1.0 if t < 4 else 2.0, 0.0, None, 5.0, 0.0, float(t)) for r, t in enumerate([0, 1, 1, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, "airport_id string, aircraft_id string, timestamp_us long, source_file_id string, source_sequence long, row long, lat double, lon double, altitude double, speed double, heading double, age double")
    for width in (1, 2, 100):
        runs = sorted(D.state_runs(df, ["source_sequence", "row"], F.floor(F.col("timestamp_us") / width)).collect(), key=lambda r: r.run_ordinal)
        assert [(r.run_ordinal, r.n, r.distinct_timestamps, r.age_trend, r.state_update_relationship) for r in runs] == [
            (0, 5, 4, "increasing", "later_timestamp_update"), (1, 2, 2, "increasing", "end_of_aircraft")]


def test_age_bins(spark):
    values = [None, -1.0, 0.0, 1.0, 1.5, 5.0, 30.0, 60.0, 61.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(D.age_bin(df.v)).collect()] == ["missing", "negative", "0", "(0,1]", "(1,5]", "(1,5]", "(5,30]", "(30,60]", ">60"]
