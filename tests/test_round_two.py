"""Inputs of several files, long digit runs, one-row joins and honest convergence."""

import numpy as np

from pyspark.sql import functions as F


def test_stream_reads_every_file_of_a_table(spark, small, tmp_path):
    from tracklens.sources.tables import load
    from tracklens.streaming import jobs

    load(spark, small, "events").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    wanted = load(spark, small, "events").count()
    assert jobs.run_available(jobs.stream_table(spark, str(tmp_path), "events"), "files").count() == wanted
    assert jobs.run_available(jobs.stream_table(spark, small, "events"), "file").count() == wanted


def test_long_digit_runs_compare_as_numbers(spark):
    from tracklens.functions.text import natural_name_key

    names = ["f" + "1" * 50 + "0.csv", "f" + "1" * 50 + "1.csv", "f" + "9" * 49 + ".csv", "f007.csv", "f8.csv"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_name_key(F.col("n"))).collect()]
    assert got == ["f007.csv", "f8.csv", "f" + "9" * 49 + ".csv", "f" + "1" * 50 + "0.csv", "f" + "1" * 50 + "1.csv"]


def test_one_row_join_never_plans_a_cartesian_product(spark):
    from tracklens.operators.evaluate import one_row_join

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = one_row_join(spark.range(5), spark.range(3).agg(F.sum("id").alias("total")))
        assert "CartesianProduct" not in joined._jdf.queryExecution().toString()
        assert [r.total for r in joined.collect()] == [3] * 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_too_few_passes_are_not_convergence(spark):
    from tracklens.operators.models import fit_nb2

    draw = np.random.default_rng(2)
    x = draw.normal(size=300)
    rows = spark.createDataFrame([(float(a), int(c)) for a, c in zip(x, draw.negative_binomial(2, 2 / (2 + np.exp(1 + 0.5 * x))))], "x double, y int")
    assert not fit_nb2(rows, ["x"], "y", passes=1)[1]["converged"]
    full = fit_nb2(rows.unionByName(spark.createDataFrame([(None, 3), (1.0, None)], "x double, y int")), ["x"], "y")
    assert full[1]["converged"] and full[1]["iterations"] <= 15 and full[0] == fit_nb2(rows, ["x"], "y")[0]


def test_mask_excludes_its_limit(spark):
    from tracklens.functions.hashing import MASK_LIMIT_HEX, span_selected

    below = f"{int(MASK_LIMIT_HEX, 16) - 1:016x}"
    got = spark.createDataFrame([(MASK_LIMIT_HEX,), (below,)], "d string").select(span_selected(F.col("d")).alias("s")).collect()
    assert [r.s for r in got] == [False, True]


def test_streams_of_shuffled_files_equal_the_batch(spark, small, tmp_path):
    """Six files in an order unlike that of time, one a batch: open windows, order checks and runs are as in batch."""
    from pyspark.sql import Window

    from tracklens.sources.tables import as_reports, load
    from tracklens.streaming import jobs

    load(spark, small, "events").repartition(6, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    timed = lambda df: as_reports(df).withColumn("event_time", F.timestamp_micros("timestamp_us"))
    batch = timed(load(spark, small, "events"))
    stream = lambda: timed(jobs.stream_table(spark, str(tmp_path), "events", 1))
    delay = jobs.replay_delay(batch)
    rows = lambda df: sorted(map(tuple, df.collect()))

    daily = lambda df: jobs.matured_days(df, delay)
    assert rows(jobs.run_to_end(stream(), daily, "daily")) == rows(daily(batch))

    checked = lambda df: df.select("source_file_id", F.floor(F.col("event_id") / 3).alias("ordinal"), F.expr("timestamp_us - if(event_id % 11 = 0, 3600000000, 0)").alias("timestamp_us"))
    before = F.lag("timestamp_us").over(Window.partitionBy("source_file_id").orderBy("ordinal"))
    late = checked(batch).withColumn("before", before).filter("timestamp_us < before").drop("before")
    jobs.use_durable_state(spark)
    assert rows(jobs.run_available(jobs.order_violations(checked(stream()), 64), "order")) == rows(late)

    valued = lambda df: df.select("aircraft_id", "event_id", "timestamp_us", F.expr("event_id * 7 % 10 div 6").alias("value"), "event_time")
    order = Window.partitionBy("aircraft_id").orderBy("timestamp_us", "event_id")
    flagged = valued(batch).withColumn("start", F.when(F.lag("value").over(order).eqNullSafe(F.col("value")), 0).otherwise(1))
    runs = flagged.withColumn("run", F.sum("start").over(order)).groupBy("aircraft_id", "run").agg(
        F.first("value"), F.min("timestamp_us"), F.max("timestamp_us"), F.count(F.lit(1))
    ).drop("run")
    assert rows(jobs.joined_runs(jobs.run_to_end(valued(stream()), lambda df: jobs.run_pieces(df, delay), "runs"))) == rows(runs)
