"""Table readers and the views that give the star-schema tables trajectory meaning."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracklens.session import prepare

SPREAD_ROWS = 250_000


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """Share a scan over tasks of at most about `rows` rows, and over all cores, where its files give fewer partitions.

    A file's row groups decide how far a scan splits, so without this a task would grow with its file.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def epoch_us(column: str):
    return F.expr(f"unix_micros(CAST({column} AS TIMESTAMP))")


def event_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Events as position reports; integer arithmetic first, so any engine gets the same doubles."""
    return as_reports(load(spark, folder, "events"))


def as_reports(events: DataFrame) -> DataFrame:
    """The report view of event rows, batch or stream."""
    return events.select(
        F.lit("AP1").alias("airport_id"),
        F.concat(F.lit("S"), (F.col("event_id") % 3).cast("string")).alias("source_file_id"),
        F.expr("CAST(CAST(ts AS DATE) AS STRING)").alias("source_day"),
        F.concat(F.lit("A"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("aircraft_id"),
        epoch_us("ts").alias("timestamp_us"),
        F.expr(
            "CAST(40.7765833333 AS DOUBLE) + CAST((event_id * 7919 + user_id * 31) % 2001 - 1000 AS DOUBLE)"
            " / CAST(10000 AS DOUBLE)"
        ).alias("lat_deg"),
        F.expr(
            "CAST(-79.9510833333 AS DOUBLE) + CAST((event_id * 104729 + user_id * 17) % 2601 - 1300 AS DOUBLE)"
            " / CAST(10000 AS DOUBLE)"
        ).alias("lon_deg"),
        F.expr("CAST(500 + (event_id * 31 + user_id * 101) % 1200 AS DOUBLE)").alias("altitude_m"),
        F.expr("CAST(40 + event_id % 50 AS DOUBLE)").alias("speed_mps"),
        F.expr("radians(CAST((event_id * 37) % 360 AS DOUBLE))").alias("heading_rad"),
        F.expr("CAST(get_json_object(props, '$.k') AS DOUBLE)").alias("age_s"),
        F.col("event_id"),
    )


def lineitem_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as reports with repeated natural keys (k1, k2)."""
    items = load(spark, folder, "lineitem")
    return items.select(
        F.col("l_orderkey").alias("k1"),
        F.col("l_linenumber").cast("long").alias("k2"),
        F.expr(
            "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_orderkey % 50 - 20"
            " + CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 5 ELSE 0 END AS DOUBLE) END"
        ).alias("age_s"),
        F.expr(
            "CAST(l_orderkey % 180 - 90 + CASE WHEN l_partkey % 4 = 0 THEN l_suppkey % 7 ELSE 0 END AS DOUBLE)"
        ).alias("lat_deg"),
        F.expr("CAST(l_orderkey % 360 - 180 AS DOUBLE)").alias("lon_deg"),
        F.expr("CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_linenumber * 100 AS DOUBLE) END").alias("altitude_m"),
        F.expr("CAST(l_orderkey % 90 AS DOUBLE)").alias("speed_mps"),
        F.expr("CASE WHEN l_orderkey % 5 = 0 THEN l_returnflag ELSE 'T' END").alias("tail"),
        F.col("l_partkey").alias("s1"),
        F.col("l_suppkey").alias("s2"),
        F.col("l_quantity").alias("s3"),
        F.col("l_extendedprice").alias("s4"),
    )


def event_raw_text(spark: SparkSession, folder: str) -> DataFrame:
    """Events rendered as raw surveillance text in all accepted date and number spellings."""
    events = spread(load(spark, folder, "events").select("event_id", "ts", "user_id"))
    us = "unix_micros(CAST(ts AS TIMESTAMP))"
    sec = f"pmod({us}, 60000000)"
    second_text = f"concat(lpad(CAST({sec} div 1000000 AS STRING), 2, '0'), '.', lpad(CAST({sec} % 1000000 AS STRING), 6, '0'), CASE WHEN event_id % 5 = 0 THEN 'Z' ELSE '' END)"
    return events.select(
        "event_id",
        F.concat(F.lit("S"), (F.col("event_id") % 3).cast("string")).alias("source_file_id"),
        F.lit("AP1").alias("airport_id"),
        F.expr("CASE WHEN event_id % 101 = 0 THEN ' None ' ELSE concat('A', lpad(CAST(user_id AS STRING), 6, '0')) END").alias("ID"),
        F.expr(
            "CASE WHEN event_id % 113 = 0 THEN '' WHEN event_id % 127 = 0 THEN '2021-02-29'"
            " WHEN event_id % 3 = 0 THEN concat('[u''', year(ts), ''', u''', lpad(CAST(month(ts) AS STRING), 2, '0'), ''', u''', lpad(CAST(day(ts) AS STRING), 2, '0'), ''']')"
            " WHEN event_id % 3 = 1 THEN concat(year(ts), '-', lpad(CAST(month(ts) AS STRING), 2, '0'), '-', lpad(CAST(day(ts) AS STRING), 2, '0'))"
            " ELSE concat(lpad(CAST(month(ts) AS STRING), 2, '0'), '-', lpad(CAST(day(ts) AS STRING), 2, '0'), '-', lpad(CAST(year(ts) % 100 AS STRING), 2, '0')) END"
        ).alias("Date"),
        F.expr(
            f"CASE WHEN event_id % 131 = 0 THEN '12:30' WHEN event_id % 3 = 0 THEN concat('[u''', hour(ts), ''', u''', minute(ts), ''', u''', {second_text}, ''']')"
            f" ELSE concat(lpad(CAST(hour(ts) AS STRING), 2, '0'), ':', lpad(CAST(minute(ts) AS STRING), 2, '0'), ':', {second_text}) END"
        ).alias("Time"),
        F.expr(
            "CASE WHEN event_id % 97 = 0 THEN 'bad' WHEN event_id % 89 = 0 THEN 'inf' WHEN event_id % 83 = 0 THEN ''"
            " ELSE CAST(500 + event_id % 1200 AS STRING) END"
        ).alias("Altitude"),
        F.expr("CASE WHEN event_id % 61 = 0 THEN '-5' ELSE CAST(event_id % 300 AS STRING) END").alias("Speed"),
        F.expr("CAST((event_id * 37) % 400 AS STRING)").alias("Heading"),
        F.expr("CASE WHEN event_id % 71 = 0 THEN '95.5' ELSE concat('40.', lpad(CAST((event_id * 7919) % 10000 AS STRING), 4, '0')) END").alias("Lat"),
        F.expr("CASE WHEN event_id % 73 = 0 THEN '-190.25' ELSE concat('-79.', lpad(CAST((event_id * 104729) % 10000 AS STRING), 4, '0')) END").alias("Lon"),
        F.expr("CASE WHEN event_id % 43 = 0 THEN 'nan' WHEN event_id % 47 = 0 THEN '-inf' ELSE CAST(event_id % 90 - 10 AS STRING) END").alias("Age"),
        F.expr("CASE WHEN event_id % 53 = 0 THEN '1d' ELSE CAST(event_id % 120 - 2 AS STRING) END").alias("Range"),
        F.expr("CAST((event_id * 53) % 360 AS STRING)").alias("Bearing"),
        F.expr("CASE WHEN event_id % 4 = 0 THEN ' null' ELSE concat(' N', CAST(user_id AS STRING), ' ') END").alias("Tail"),
        F.expr("CASE event_id % 7 WHEN 0 THEN 'True' WHEN 1 THEN '0' WHEN 2 THEN 'maybe' WHEN 3 THEN '' ELSE 'false' END").alias("AltisGNSS"),
    )


def prediction_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as scored scenes: group = ship month, one horizon per scene."""
    items = load(spark, folder, "lineitem")
    return items.select(
        F.expr("CASE WHEN l_suppkey % 4 = 0 THEN 'AP2' ELSE 'AP1' END").alias("airport"),
        F.expr("date_format(l_shipdate, 'yyyy-MM')").alias("grp"),
        F.expr("concat(l_orderkey, '-', l_linenumber, '-', l_partkey)").alias("scene_id"),
        epoch_us("l_shipdate").alias("cutoff_us"),
        F.expr("CASE l_orderkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 120 ELSE 300 END").cast("long").alias("horizon"),
        F.expr("CAST(l_quantity AS BIGINT) % 8").alias("y"),
        F.expr("CASE WHEN CAST(l_quantity AS BIGINT) % 8 >= 3 THEN 1 ELSE 0 END").cast("long").alias("risk"),
        F.expr("l_partkey % 11 + 1").alias("pair_opportunity"),
        F.expr("CAST(l_linenumber + 2 AS BIGINT)").alias("n_aircraft"),
        F.expr("CAST((CAST(l_quantity AS BIGINT) % 8) * 100 + l_suppkey % 200 AS DOUBLE) / CAST(1000 AS DOUBLE)").alias("prob_b"),
        F.expr("CAST((CAST(l_quantity AS BIGINT) % 8) * 10 + l_partkey % 17 - 8 AS DOUBLE) / CAST(10 AS DOUBLE)").alias("raw_b"),
        F.expr("CAST(l_partkey % 70 AS DOUBLE) / CAST(10 AS DOUBLE)").alias("count_a"),
        F.expr("CAST(l_suppkey % 25 AS DOUBLE)").alias("max_report_age_s"),
    ).withColumn("count_b", F.greatest(F.lit(0.0), F.col("raw_b"))).drop("raw_b")


def audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as audited rows: many rows per aircraft and time, states that persist, several source files."""
    items = load(spark, folder, "lineitem")
    return items.select(
        F.expr("concat('AP', l_suppkey % 2)").alias("airport_id"),
        F.expr("concat('A', l_suppkey)").alias("aircraft_id"),
        epoch_us("l_shipdate").alias("timestamp_us"),
        F.expr("concat('S', l_partkey % 3)").alias("source_file_id"),
        F.expr("l_partkey % 3").alias("source_sequence"),
        F.expr("CAST(l_shipdate AS STRING)").alias("day"),
        F.col("l_orderkey").alias("r1"), F.col("l_linenumber").cast("long").alias("r2"), F.col("l_partkey").alias("r3"),
        F.col("l_quantity").alias("r4"), F.col("l_extendedprice").alias("r5"),
        F.expr("CAST(l_orderkey % 2 AS DOUBLE)").alias("lat"), F.lit(0.0).alias("lon"),
        F.expr("CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(100 AS DOUBLE) END").alias("altitude"),
        F.lit(5.0).alias("speed"), F.expr("CAST(l_orderkey % 2 AS DOUBLE)").alias("heading"),
        F.expr("CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 80 - 10 AS DOUBLE) END").alias("age"),
    )


AUDIT_ORDER = ["source_sequence", "source_file_id", "r1", "r2", "r3", "r4", "r5"]


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as audited files: one order is one file."""
    orders = spread(load(spark, folder, "orders"))
    key = "o_orderkey"
    base = orders.select(
        F.col(key).alias("k"), F.expr("concat('ap', o_custkey % 2)").alias("airport_id"),
        F.expr(f"CASE WHEN {key} % 10 < 8 THEN '.csv' WHEN {key} % 10 = 8 THEN '.zip' ELSE '.txt' END").alias("extension"),
        F.date_format("o_orderdate", "yyyy").alias("year"), F.date_format("o_orderdate", "MM-dd-yy").alias("date_directory"),
        F.expr(f"concat('Log_', {key} % 137)").alias("stem"),
        F.expr(f"CASE WHEN {key} % 41 = 0 THEN 0 ELSE {key} * 7919 % 100000 END").alias("size_bytes"),
        F.expr(f"CASE WHEN {key} % 997 = 0 THEN NULL ELSE sha2(CAST({key} % 5000 AS STRING), 256) END").alias("sha256"),
        F.expr(f"concat('C', {key} % 10)").alias("crc32"),
        F.expr(f"{key} % 503 <> 0").alias("readable"), F.expr(f"{key} % 211 <> 0").alias("strict_parse_ok"),
        F.expr(f"CASE WHEN {key} % 422 = 0 THEN 'UnicodeDecodeError' END").alias("decode_error"),
        F.expr(f"{key} % 41 = 0").alias("is_empty"), F.expr(f"{key} % 43 = 0").alias("header_only"),
        F.expr(f"CASE WHEN {key} % 13 = 0 THEN {key} % 5 ELSE 0 END").alias("blank_row_count"),
        F.expr(f"CASE WHEN {key} % 17 = 0 THEN 1 ELSE 0 END").cast("long").alias("column_mismatch_count"),
        F.expr(f"{key} % 3 <> 0").alias("ends_with_newline"),
        F.expr(f"CASE {key} % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' ELSE 'not_assessable' END").alias("date_status"),
        F.expr(f"{key} % 7 <> 0").alias("zip_valid"), F.expr(f"{key} % 1009 = 0").alias("is_symlink"),
        F.expr("CASE WHEN o_custkey % 3 = 0 THEN array('ID', 'Time', 'Date') ELSE array('ID', 'Time', 'Date', 'AltisGNSS') END").alias("header"),
        F.expr(f"CASE {key} % 9 WHEN 0 THEN 'exclude_non_data_file' WHEN 1 THEN 'exclude_source_corrupt_file' WHEN 2 THEN 'drop_terminal_record' ELSE 'include' END").alias("disposition"),
    )
    return base.withColumn("filename", F.concat("stem", "extension")).withColumn(
        "relative_path", F.concat_ws("/", "year", "date_directory", F.concat(F.col("k").cast("string"), F.lit("_"), F.col("filename")))
    ).withColumn("audit_type", F.expr("CASE extension WHEN '.csv' THEN 'csv' WHEN '.zip' THEN 'zip' ELSE 'binary' END"))
