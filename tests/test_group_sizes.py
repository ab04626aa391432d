"""Counting copies needs no winner of a key."""

from pyspark.sql import functions as F

from tracklens.operators import ledgers as L
from tracklens.plans import ledger_queries as Q
from tracklens.sources.tables import lineitem_rows


def test_group_sizes_are_those_of_unique_reports(spark):
    folder = "/root/testdata/sf0.001"
    rows = lineitem_rows(spark, folder).withColumn("k2", F.col("k2") % 2)
    sizes = L.group_sizes(rows, Q.RULE)
    assert sorted(map(tuple, sizes.collect())) == sorted(map(tuple, L.unique_reports(rows, Q.RULE).select("k1", "k2", "group_size").collect()))
    plan = Q.agg_21_excess_rows(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [k1") == 1
