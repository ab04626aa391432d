"""Parser tables with known answers."""

import datetime as dt

import pytest

from tracklens import constants as K
from tracklens.functions import text
from tracklens.operators import canonical as C


def us(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


DATES = [
    ("[u'2020', u'11', u'21']", "[u'13', u'13', u'43.999999979']", us(2020, 11, 21, 13, 13, 44), None),
    ("2021-11-30", "01:02:03.5Z", us(2021, 11, 30, 1, 2, 3) + 500_000, None),
    ("11-30-21", "1:2:3", us(2021, 11, 30, 1, 2, 3), None),
    ("11-30-70", "1:2:3", us(1970, 11, 30, 1, 2, 3), None),
    ("[2021, 11, 30]", "[1, 2, 3]", us(2021, 11, 30, 1, 2, 3), None),
    ("2021-12-31", "23:59:59.9999996", us(2022, 1, 1, 0, 0, 0), None),
    ("2021-12-31", "23:59:59.0000005", us(2021, 12, 31, 23, 59, 59), None),
    ("2021-12-31", "23:59:59.0000015", us(2021, 12, 31, 23, 59, 59) + 2, None),
    ("2021-02-29", "1:2:3", None, "invalid_datetime"),
    ("", "1:2:3", None, "missing_date"),
    (None, "1:2:3", None, "missing_date"),
    ("2021-01-01", " None ", None, "missing_time"),
    ("[u'2021', u'11']", "1:2:3", None, "invalid_date_shape"),
    ("[2021, 01, 05]", "1:2:3", None, "invalid_date_shape"),
    ("[__import__('os')]", "1:2:3", None, "invalid_date_shape"),
    ("2021/01/01", "1:2:3", None, "invalid_date_format"),
    ("2021-01-01", "12:30", None, "invalid_time_format"),
    ("2021-01-01", "[u'1', u'2']", None, "invalid_time_shape"),
    ("2021-01-01", "1:2:60", None, "invalid_datetime"),
    ("2021-01-01", "25:2:3", None, "invalid_datetime"),
    ("[u'2021', u'2', u'30']", "12:30", None, "invalid_time_format"),
    ("2021-02-30", "12:30", None, "invalid_datetime"),
]


def test_dates(spark):
    rows = [(i, d, t) for i, (d, t, _, _) in enumerate(DATES)]
    df = text.with_datetime(spark.createDataFrame(rows, "i int, Date string, Time string"), "Date", "Time")
    got = {r.i: (r.timestamp_us, r.timestamp_error) for r in df.collect()}
    assert got == {i: (stamp, error) for i, (_, _, stamp, error) in enumerate(DATES)}


NUMBERS = [
    ("12", 12.0, None), (" -1.5e2 ", -150.0, None), (".5", 0.5, None), ("5.", 5.0, None), ("1_0", 10.0, None), ("", None, None), ("NaN", None, None),
    ("none", None, None), (None, None, None), ("bad", None, "invalid_float"), ("1d", None, "invalid_float"), ("1__0", None, "invalid_float"),
    ("inf", None, "nonfinite_float"), ("-Infinity", None, "nonfinite_float"), ("1e999", None, "nonfinite_float"), ("+nan", None, "nonfinite_float"),
]


def test_numbers(spark):
    df = text.with_numbers(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(NUMBERS)], "i int, x string"), ("x",))
    assert {r.i: (r.x_v, r.x_e) for r in df.collect()} == {i: (v, e) for i, (_, v, e) in enumerate(NUMBERS)}


@pytest.mark.parametrize("token,value", [("True", True), ("1", True), ("false", False), ("0", False), ("", None), ("maybe", None)])
def test_booleans(spark, token, value):
    df = spark.createDataFrame([(token,)], "x string")
    assert df.select(text.parse_bool(df.x)).first()[0] is value


def test_date_tokens(spark):
    paths = [("raw/01-02-21/2020-05-06.csv", "01-02-21"), ("raw/2020-05-06.csv", "05-06-20"), ("raw/13-40-21/2020-05-06", None), ("none", None), ("a123-45-678", None)]
    df = spark.createDataFrame([(p,) for p, _ in paths], "p string")
    assert [r[0] for r in df.select(text.path_date_token(df.p)).collect()] == [t for _, t in paths]


def test_natural_order(spark):
    names = ["Log_10.csv", "log_9.csv", "Log_2b.csv", "Log_2a.csv", "1.csv"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(text.natural_name_key(df.n)).collect()] == ["1.csv", "Log_2a.csv", "Log_2b.csv", "log_9.csv", "Log_10.csv"]


def _raw(**changes):
    row = dict(event_id=0, source_file_id="S", airport_id="AP1", ID="a1", Date="2021-01-01", Time="0:0:0", Altitude="1000", Speed="100", Heading="90", Lat="40.8", Lon="-79.95",
               Age="1", Range="2.6", Bearing="2", Tail=" N1 ", AltisGNSS="true")
    return {**row, **changes}


RAW_SCHEMA = "event_id long, source_file_id string, airport_id string, " + ", ".join(f"{h} string" for h in K.RAW_HEADER_V2)


def test_quality_bits_and_routing(spark):
    rows = [
        _raw(), _raw(event_id=1, Time="0:0:5", Lat="95", Age="-3", Speed="-1", Range="-2"), _raw(event_id=2, Date="bad"), _raw(event_id=3, ID="null"),
        _raw(event_id=4, Time="0:0:3", Altitude="inf", Heading="400", Age="inf", Tail="nan", AltisGNSS="x", Range="50", Bearing="90"), _raw(event_id=5, Time="0:0:4", Age="", Lon="-200", Bearing=""),
    ]
    typed = C.typed_rows(spark.createDataFrame([tuple(r[c.split()[0]] for c in RAW_SCHEMA.split(", ")) for r in rows], RAW_SCHEMA))
    good = {r.event_id: r for r in C.parsed_rows(typed, block_rows=2).collect()}
    bad = {r.event_id: r.reason_code for r in C.bad_rows(typed).collect()}
    Q = K.QC_BITS
    assert set(good) == {0, 1, 4, 5}
    assert bad == {2: "invalid_or_missing_utc_timestamp", 3: "invalid_or_missing_aircraft_id"}
    assert good[0].qc_bits == 0 and good[0].parse_quality_bits == 0 and good[0].tail_or_callsign == "N1"
    assert good[0].altitude_m == pytest.approx(304.8) and good[0].range_m == pytest.approx(2600)
    assert good[1].qc_bits == sum(Q[k] for k in ("latitude_out_of_domain", "negative_age", "negative_speed", "negative_range", "range_geometry_skipped", "bearing_geometry_skipped"))
    # Row 4 is earlier than row 1, the preceding accepted row in another block.
    assert good[4].qc_bits == sum(Q[k] for k in ("heading_out_of_domain", "nonfinite_age", "missing_observation_fields", "timestamp_decrease", "range_geometry_inconsistent", "bearing_geometry_inconsistent"))
    assert good[4].parse_quality_bits == K.PARSE_BITS["nonfinite_numeric_token"] + K.PARSE_BITS["invalid_boolean_token"]
    assert good[5].qc_bits == sum(Q[k] for k in ("longitude_out_of_domain", "missing_age", "missing_observation_fields", "range_geometry_skipped", "bearing_geometry_skipped"))


def test_tasks_hold_a_bounded_number_of_rows(spark):
    """One file of many rows is shared over more tasks than there are cores."""
    from tracklens.sources.tables import spread

    cores = spark.sparkContext.defaultParallelism
    one = spark.range(cores * 100).coalesce(1)
    shared = spread(one, 50)
    assert shared.rdd.getNumPartitions() == 2 * cores and shared.count() == cores * 100
    assert max(len(part) for part in shared.rdd.glom().collect()) <= 60
    assert spread(one, cores * 1000).rdd.getNumPartitions() == cores


def test_generated_parser_stays_short(spark):
    """No method of the number parser passes 8,000 bytes of code, from where the JIT compiler leaves it alone."""
    import re

    from pyspark.sql import functions as F

    raw = spark.range(1).select(*[F.col("id").cast("string").alias(f) for f in K.NUMERIC_FIELDS])
    text.with_numbers(raw, K.NUMERIC_FIELDS).createOrReplaceTempView("numbers_")
    plan = spark.sql("EXPLAIN CODEGEN SELECT * FROM numbers_").first()[0]
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) < 8000
