"""Rows of one airport or one source file are shared over many tasks and files."""

import glob

from tracklens.plans import file_queries, registry


def test_losses_are_not_dealt_by_airport(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the table were large
    plan = registry.queries()["agg_39_nb2_loss"](spark, small)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_csv_files_hold_a_bounded_number_of_rows(spark, small, monkeypatch):
    monkeypatch.setattr(file_queries, "CSV_ROWS", 100)
    path = file_queries._csv_folder(spark, small).removeprefix("file:")
    sizes = [sum(1 for _ in open(f)) - 1 for f in glob.glob(path + "/*.csv")]
    assert sum(sizes) == spark.read.parquet(small + "/events.parquet").count() and max(sizes) <= 100
