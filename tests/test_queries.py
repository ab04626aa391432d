"""Registered queries against their reference SQL on the smallest tables, and registry rules."""

import sys

import duckdb
import pytest

from check import TABLES, canonical
from tracklens.plans import registry
from tracklens.sources.tables import load

CHOSEN = [
    "agg_31_reconstruction", "win_07_onset_targets", "agg_28_task_indicators", "agg_45_cpa_coverage", "win_01_membership", "agg_08_duplicate_summary", "prj_09_qc_bits",
    "agg_15_field_profiles", "win_12_local_baseline", "win_15_masked_spans", "src_09_logical_records", "str_01_carry_forward", "str_09_state_runs", "join_11_archive_match",
]


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, db, small, name):
    got = canonical(registry.queries()[name](spark, small).toPandas())
    want = canonical(db.sql(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_registry():
    queries, oracle = registry.queries(), registry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) >= 150
    assert set(queries) - set(oracle) == {
        "agg_14_field_estimates", "ml_01_ridge", "ml_02_poisson", "ml_03_logistic", "ml_04_boosted_trees", "ml_05_nb2", "ml_06_calibration",
        "ml_15_site_ridge", "study_confirmation", "study_dispersion", "snk_04_content_digest", "src_01_file_inventory", "src_02_file_hashes", "src_05_zip_audit",
    }


def test_distinct_sketches_are_close(spark, small):
    from tracklens.plans.audit_queries import audit_rows

    exact = {r.airport_id: r.n for r in audit_rows(spark, small).groupBy("airport_id").agg({"r3": "count", "airport_id": "max"}).selectExpr("airport_id", "1 AS n").collect()}
    true = {r[0]: r[1] for r in audit_rows(spark, small).select("airport_id", "r3").distinct().groupBy("airport_id").count().collect()}
    got = {r.airport_id: r.distinct_estimate for r in registry.queries()["agg_12_distinct_sketches"](spark, small).collect()}
    assert set(got) == set(exact)
    for airport, n in true.items():
        assert abs(got[airport] - n) <= max(2, 3 * 1.04 / 64 * n)


def test_sketches_merge_in_any_parts_and_skip_nulls(spark):
    import hashlib

    from tracklens.operators import profile as P

    values = [str(i % 700) for i in range(1_500)]
    rows = spark.createDataFrame([("a", i % 3, v) for i, v in enumerate(values)] + [("a", 0, None), ("b", 0, None)], "k string, part int, v string")
    whole = P.distinct_sketches(rows, ["k"], "v", 6)
    parts = P.merge_sketches(P.distinct_sketches(rows, ["k", "part"], "v", 6), ["k"])
    registers: dict = {}
    for v in values:
        h = int(hashlib.sha256(v.encode()).hexdigest(), 16)
        registers[h % 64] = max(registers.get(h % 64, 0), 250 - (h >> 6).bit_length() + 1)
    got = {r.register: r["rank"] for r in whole.collect()}
    assert got == registers == {r.register: r["rank"] for r in parts.collect()}
    estimate = P.sketch_estimates(whole, ["k"], 6).collect()
    assert [r.k for r in estimate] == ["a"] and abs(estimate[0].distinct_estimate - 700) <= 3 * 1.04 / 8 * 700


def test_content_root_depends_on_order_only(spark):
    import hashlib

    from pyspark.sql import functions as F
    from tracklens.functions import hashing as H

    texts = [f"row {i % 5}" for i in range(40)]
    def root(order, parts):
        rows = spark.createDataFrame([("k", at, t) for at, t in enumerate(order)], "k string, at long, t string").repartition(parts)
        return H.content_root(rows, ["k"], "at", F.col("t")).first()

    base = root(texts, 1)
    words = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    want = [sum(int(w[8 * i:8 * i + 8], 16) * pow(H.ROOT_BASE, at, p) for at, w in enumerate(words)) % p for i, p in enumerate(H.ROOT_PRIMES)]
    assert base.content_root == "-".join(f"{v:08x}" for v in want) and base.row_count == 40
    assert root(texts, 7) == base
    assert root([texts[1], texts[0], *texts[2:]], 3) != base and root(texts[:-1], 1) != base
    high = spark.createDataFrame([(2 ** 41 + 12_345,)], "e long").select(H.base_power(F.col("e"), H.ROOT_PRIMES[0]).alias("p")).first().p
    assert high == pow(H.ROOT_BASE, 2 ** 41 + 12_345, H.ROOT_PRIMES[0])


def test_content_digest_ignores_order(spark, small):
    from tracklens.functions.hashing import content_digest

    rows = load(spark, small, "customer")
    assert content_digest(rows).first() == content_digest(rows.orderBy("c_acctbal").repartition(5)).first()
    assert content_digest(rows).first() != content_digest(rows.filter("c_custkey > 1")).first()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
