"""Scenes read back from their files hold every aircraft, and the reference SQL says so too."""

import duckdb
from pyspark.sql import functions as F

from tracklens.plans import registry


def test_crowded_scene_is_read_whole(spark, tmp_path):
    users, reports = 130, 24
    events = spark.range(users * reports).select(
        F.col("id").alias("event_id"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.expr(f"(id div {users}) * 1200000000 + id % {users} * 1000000")).alias("ts"),
        (F.col("id") % users).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["src_15_scene_read"]).fetchall()
    got = registry.queries()["src_15_scene_read"](spark, str(tmp_path)).select("source_day", "current_reports", "aircraft", "oldest_us").collect()
    assert [tuple(r) for r in got] == want
    assert want[0][2] == users
