"""Raw-text parsing and quality queries over the event table rendered as text."""

from pyspark.sql import functions as F

from tracklens import constants as K
from tracklens.functions import geo, text
from tracklens.operators import canonical as C
from tracklens.plans import sql as S
from tracklens.session import stage_table
from tracklens.sources.tables import event_raw_text, event_reports, load

QUERIES: dict = {}
ORACLE: dict = {}

RAW = """raw AS (
 SELECT event_id, ts, concat('S', event_id % 3) AS source_file_id, 'AP1' AS airport_id,
  CASE WHEN event_id % 101 = 0 THEN ' None ' ELSE concat('A', lpad(CAST(user_id AS VARCHAR), 6, '0')) END AS "ID",
  CASE WHEN event_id % 113 = 0 THEN '' WHEN event_id % 127 = 0 THEN '2021-02-29'
   WHEN event_id % 3 = 0 THEN strftime(ts, '[u''%Y'', u''%m'', u''%d'']') WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%m-%d-%y') END AS "Date",
  CASE WHEN event_id % 131 = 0 THEN '12:30'
   WHEN event_id % 3 = 0 THEN concat('[u''', hour(ts), ''', u''', minute(ts), ''', u''', strftime(ts, '%S.%f'), CASE WHEN event_id % 5 = 0 THEN 'Z' ELSE '' END, ''']')
   ELSE concat(strftime(ts, '%H:%M:%S.%f'), CASE WHEN event_id % 5 = 0 THEN 'Z' ELSE '' END) END AS "Time",
  CASE WHEN event_id % 97 = 0 THEN 'bad' WHEN event_id % 89 = 0 THEN 'inf' WHEN event_id % 83 = 0 THEN '' ELSE CAST(500 + event_id % 1200 AS VARCHAR) END AS "Altitude",
  CASE WHEN event_id % 61 = 0 THEN '-5' ELSE CAST(event_id % 300 AS VARCHAR) END AS "Speed",
  CAST((event_id * 37) % 400 AS VARCHAR) AS "Heading",
  CASE WHEN event_id % 71 = 0 THEN '95.5' ELSE concat('40.', lpad(CAST((event_id * 7919) % 10000 AS VARCHAR), 4, '0')) END AS "Lat",
  CASE WHEN event_id % 73 = 0 THEN '-190.25' ELSE concat('-79.', lpad(CAST((event_id * 104729) % 10000 AS VARCHAR), 4, '0')) END AS "Lon",
  CASE WHEN event_id % 43 = 0 THEN 'nan' WHEN event_id % 47 = 0 THEN '-inf' ELSE CAST(event_id % 90 - 10 AS VARCHAR) END AS "Age",
  CASE WHEN event_id % 53 = 0 THEN '1d' ELSE CAST(event_id % 120 - 2 AS VARCHAR) END AS "Range",
  CAST((event_id * 53) % 360 AS VARCHAR) AS "Bearing",
  CASE WHEN event_id % 4 = 0 THEN ' null' ELSE concat(' N', user_id, ' ') END AS "Tail",
  CASE event_id % 7 WHEN 0 THEN 'True' WHEN 1 THEN '0' WHEN 2 THEN 'maybe' WHEN 3 THEN '' ELSE 'false' END AS "AltisGNSS"
 FROM events)"""


def _missing(c):
    return f"(lower(trim({c})) IN ('', 'none', 'null', 'nan'))"


def _float(c):
    return f"(CASE WHEN NOT {_missing(c)} AND regexp_full_match(trim({c}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim({c}) AS DOUBLE) END)"


def _float_error(c):
    return (f"(CASE WHEN {_missing(c)} THEN NULL WHEN regexp_full_match(lower(trim({c})), '[+-]?(inf|infinity|nan)') THEN 'nonfinite_float'"
            f" WHEN {_float(c)} IS NULL THEN 'invalid_float' END)")


# Dates are read back from their three spellings, not from the source timestamp.
_LIST = "regexp_extract_all({c}, '''([^'']*)''', 1)"
TYPED = RAW + f""", parts AS (
 SELECT *, CASE WHEN "Date" LIKE '[%' THEN {_LIST.format(c='"Date"')} WHEN regexp_full_match("Date", '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN string_split("Date", '-')
   WHEN regexp_full_match("Date", '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') THEN ['20' || string_split("Date", '-')[3], string_split("Date", '-')[1], string_split("Date", '-')[2]] END AS dp,
  CASE WHEN "Time" LIKE '[%' THEN {_LIST.format(c='"Time"')} ELSE string_split("Time", ':') END AS tp FROM raw),
typed AS (
 SELECT *, CASE WHEN NOT {_missing('"ID"')} THEN trim("ID") END AS aircraft_id, CASE WHEN NOT {_missing('"Tail"')} THEN trim("Tail") END AS tail_or_callsign,
  CASE lower(trim("AltisGNSS")) WHEN 'true' THEN true WHEN '1' THEN true WHEN 'false' THEN false WHEN '0' THEN false END AS gnss,
  CASE WHEN NOT {_missing('"AltisGNSS"')} AND lower(trim("AltisGNSS")) NOT IN ('true', '1', 'false', '0') THEN 1 ELSE 0 END AS gnss_bad,
  {', '.join(f'{_float(chr(34) + f + chr(34))} AS {f}_v, {_float_error(chr(34) + f + chr(34))} AS {f}_e' for f in K.NUMERIC_FIELDS)},
  epoch_us(TRY_CAST(dp[1] || '-' || dp[2] || '-' || dp[3] || ' ' || lpad(tp[1], 2, '0') || ':' || lpad(tp[2], 2, '0') || ':' || replace(tp[3], 'Z', '') AS TIMESTAMP)) AS stamp
 FROM parts),
routed AS (
 SELECT *, CASE WHEN {_missing('"Date"')} THEN 'missing_date' WHEN {_missing('"Time"')} THEN 'missing_time' WHEN "Date" = '2021-02-29' THEN 'invalid_datetime'
   WHEN len(tp) <> 3 THEN 'invalid_time_format' WHEN stamp IS NULL THEN 'invalid_datetime' END AS timestamp_error FROM typed),
good AS (SELECT * FROM routed WHERE aircraft_id IS NOT NULL AND timestamp_error IS NULL)"""


def prj_01_typed_rows(spark, folder):
    t = C.typed_rows(event_raw_text(spark, folder))
    return t.select(
        "event_id", "aircraft_id", "tail_or_callsign", F.col("altitude_source_gnss").cast("string").alias("altitude_source_gnss"), "timestamp_us", "timestamp_error",
        *[f"{f}_v" for f in K.NUMERIC_FIELDS], F.size("field_errors").cast("long").alias("failed_fields"),
    )


QUERIES["prj_01_typed_rows"] = prj_01_typed_rows
ORACLE["prj_01_typed_rows"] = f"""WITH {TYPED} SELECT event_id, aircraft_id, tail_or_callsign, CAST(gnss AS VARCHAR) AS altitude_source_gnss,
 CASE WHEN timestamp_error IS NULL THEN stamp END AS timestamp_us, timestamp_error, {', '.join(f'{f}_v' for f in K.NUMERIC_FIELDS)},
 CAST(gnss_bad + {' + '.join(f'CAST({f}_e IS NOT NULL AS INT)' for f in K.NUMERIC_FIELDS)} AS BIGINT) AS failed_fields FROM routed"""


def prj_02_float_errors(spark, folder):
    t = C.typed_rows(event_raw_text(spark, folder)).select(F.explode("field_errors").alias("field", "error"))
    return t.groupBy("field", "error").agg(F.count(F.lit(1)).alias("n"))


QUERIES["prj_02_float_errors"] = prj_02_float_errors
ORACLE["prj_02_float_errors"] = f"""WITH {TYPED} SELECT field, error, count(*) AS n FROM (
 {' UNION ALL '.join(f"SELECT '{f}' AS field, {f}_e AS error FROM routed" for f in K.NUMERIC_FIELDS)}
 UNION ALL SELECT 'AltisGNSS', CASE WHEN gnss_bad = 1 THEN 'invalid_boolean' END FROM routed) WHERE error IS NOT NULL GROUP BY ALL"""


def prj_03_booleans(spark, folder):
    t = C.typed_rows(event_raw_text(spark, folder))
    return t.groupBy("AltisGNSS", F.col("altitude_source_gnss").cast("string").alias("altitude_source_gnss")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["prj_03_booleans"] = prj_03_booleans
ORACLE["prj_03_booleans"] = f"""WITH {TYPED} SELECT "AltisGNSS", CAST(gnss AS VARCHAR) AS altitude_source_gnss, count(*) AS n FROM routed GROUP BY ALL"""


def prj_04_datetime_errors(spark, folder):
    t = C.typed_rows(event_raw_text(spark, folder))
    return t.groupBy(F.coalesce("timestamp_error", F.lit("ok")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp_us").alias("first_us"), F.max("timestamp_us").alias("last_us")
    )


QUERIES["prj_04_datetime_errors"] = prj_04_datetime_errors
ORACLE["prj_04_datetime_errors"] = f"""WITH {TYPED} SELECT coalesce(timestamp_error, 'ok') AS status, count(*) AS n,
 min(stamp) FILTER (WHERE timestamp_error IS NULL) AS first_us, max(stamp) FILTER (WHERE timestamp_error IS NULL) AS last_us FROM routed GROUP BY 1"""


def prj_05_half_even_micros(spark, folder):
    """Seconds with seven decimals, most of them exact ties at one microsecond."""
    items = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.concat(
            (F.col("l_partkey") % 60).cast("string"), F.lit("."), F.lpad((F.col("l_suppkey") * 9973 % 1000000).cast("string"), 6, "0"), F.lit("5")
        ).alias("token"),
    )
    stamped = text.with_datetime(
        items.withColumns({"Date": F.lit("2021-12-31"), "Time": F.concat(F.lit("23:59:"), F.col("token"))}), "Date", "Time"
    )
    return stamped.withColumnRenamed("timestamp_us", "us").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("us"))


QUERIES["prj_05_half_even_micros"] = prj_05_half_even_micros
ORACLE["prj_05_half_even_micros"] = """WITH t AS (SELECT l_partkey % 60 AS s, l_suppkey * 9973 % 1000000 AS f FROM lineitem)
SELECT concat(s, '.', lpad(CAST(f AS VARCHAR), 6, '0'), '5') AS token, count(*) AS n,
 max(epoch_us(TIMESTAMP '2021-12-31 23:59:00') + s * 1000000 + f + CASE WHEN f % 2 = 1 THEN 1 ELSE 0 END) AS us FROM t GROUP BY 1"""


def prj_06_us_eastern(spark, folder):
    shifted = load(spark, folder, "events").select(
        "event_id", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) + (event_id % 400) * 86400000000").alias("stamp_us")
    )
    offset, ambiguous, missing = text.us_eastern_flags(F.col("stamp_us"))
    return shifted.select(
        "event_id", text.utc_to_us_eastern(F.col("stamp_us")).alias("local_us"), offset.cast("long").alias("wall_offset_h"),
        ambiguous.alias("ambiguous"), missing.alias("nonexistent"),
    )


QUERIES["prj_06_us_eastern"] = prj_06_us_eastern
ORACLE["prj_06_us_eastern"] = """WITH e AS (SELECT event_id, ts + to_days(CAST(event_id % 400 AS INT)) AS u FROM events),
 y AS (SELECT *, make_date(year(u), 3, 8) AS a, make_date(year(u), 11, 1) AS b FROM e),
 r AS (SELECT *, a + to_days(CAST((7 - dayofweek(a)) % 7 AS INT)) AS spring, b + to_days(CAST((7 - dayofweek(b)) % 7 AS INT)) AS autumn FROM y)
SELECT event_id, epoch_us(u) - 3600000000 * CASE WHEN u >= spring + INTERVAL 7 HOUR AND u < autumn + INTERVAL 6 HOUR THEN 4 ELSE 5 END AS local_us,
 CAST(CASE WHEN u >= spring + INTERVAL 3 HOUR AND u < autumn + INTERVAL 2 HOUR THEN -4 ELSE -5 END AS BIGINT) AS wall_offset_h,
 u >= autumn + INTERVAL 1 HOUR AND u < autumn + INTERVAL 2 HOUR AS ambiguous, u >= spring + INTERVAL 2 HOUR AND u < spring + INTERVAL 3 HOUR AS nonexistent FROM r"""

_RANGE = """geo AS (SELECT *, pow(sin((radians(Lat_v) - radians(40.7765833333)) / 2), 2) + cos(radians(40.7765833333)) * cos(radians(Lat_v)) * pow(sin(radians(Lon_v - -79.9510833333) / 2), 2) AS hv,
  atan2(sin(radians(Lon_v - -79.9510833333)) * cos(radians(Lat_v)), cos(radians(40.7765833333)) * sin(radians(Lat_v)) - sin(radians(40.7765833333)) * cos(radians(Lat_v)) * cos(radians(Lon_v - -79.9510833333))) AS br FROM good),
geo2 AS (SELECT *, 6371008.8 * 2.0 * atan2(sqrt(hv), sqrt(greatest(0.0, 1.0 - hv))) AS er, degrees(br) + CASE WHEN br < 0 THEN 360 ELSE 0 END AS eb,
  coalesce(Lat_v BETWEEN -90 AND 90 AND Lon_v BETWEEN -180 AND 180, false) AS placed FROM geo),
circ AS (SELECT *, abs(Bearing_v - eb) AS ad, stamp < lag(stamp) OVER (PARTITION BY source_file_id ORDER BY event_id) AS dec FROM geo2),
quality AS (SELECT *,
  CASE WHEN placed AND er <> 0 AND least(ad, 360 - ad) > 5 THEN 1 ELSE 0 END + CASE WHEN NOT placed OR Bearing_v IS NULL OR er = 0 THEN 2 ELSE 0 END
  + CASE WHEN Heading_v NOT BETWEEN 0 AND 360 THEN 4 ELSE 0 END + CASE WHEN Lat_v NOT BETWEEN -90 AND 90 THEN 8 ELSE 0 END
  + CASE WHEN Lon_v NOT BETWEEN -180 AND 180 THEN 16 ELSE 0 END + CASE WHEN Age_v IS NULL AND Age_e IS DISTINCT FROM 'nonfinite_float' THEN 32 ELSE 0 END
  + CASE WHEN Altitude_v IS NULL OR Speed_v IS NULL OR Heading_v IS NULL OR Lat_v IS NULL OR Lon_v IS NULL OR Range_v IS NULL OR Bearing_v IS NULL THEN 64 ELSE 0 END
  + CASE WHEN Age_v < 0 THEN 128 ELSE 0 END + CASE WHEN Range_v < 0 THEN 256 ELSE 0 END + CASE WHEN Speed_v < 0 THEN 512 ELSE 0 END
  + CASE WHEN Age_e = 'nonfinite_float' THEN 1024 ELSE 0 END
  + CASE WHEN placed AND abs(Range_v * 1000.0 - er) > greatest(500.0, 0.05 * er) THEN 2048 ELSE 0 END
  + CASE WHEN NOT placed OR Range_v IS NULL THEN 4096 ELSE 0 END + CASE WHEN dec THEN 8192 ELSE 0 END AS qc FROM circ)"""
_ERRS = "[" + ", ".join(f"{f}_e" for f in K.NUMERIC_FIELDS) + "]"
_PARSE = f"CASE WHEN list_contains({_ERRS}, 'invalid_float') THEN 2 ELSE 0 END + CASE WHEN list_contains({_ERRS}, 'nonfinite_float') THEN 16 ELSE 0 END + gnss_bad"


def _parsed(spark, folder):
    return C.parsed_rows(stage_table(C.typed_rows(event_raw_text(spark, folder)), "typed"))


def prj_07_canonical_rows(spark, folder):
    return _parsed(spark, folder).select(
        "event_id", "airport_id", "aircraft_id", "tail_or_callsign", "timestamp_us", "lat_deg", "lon_deg",
        F.round("altitude_m", 6).alias("altitude_m"), F.round("speed_mps", 6).alias("speed_mps"), F.round("heading_rad", 6).alias("heading_rad"),
        "age_s", "range_m", F.round("bearing_rad", 6).alias("bearing_rad"), F.col("altitude_source_gnss").cast("string").alias("altitude_source_gnss"),
    )


QUERIES["prj_07_canonical_rows"] = prj_07_canonical_rows
ORACLE["prj_07_canonical_rows"] = f"""WITH {TYPED} SELECT event_id, airport_id, aircraft_id, tail_or_callsign, stamp AS timestamp_us, Lat_v AS lat_deg, Lon_v AS lon_deg,
 round(Altitude_v * 0.3048, 6) AS altitude_m, round(Speed_v * CAST(0.5144444444444445 AS DOUBLE), 6) AS speed_mps, round(radians(Heading_v), 6) AS heading_rad,
 Age_v AS age_s, Range_v * CAST(1000 AS DOUBLE) AS range_m, round(radians(Bearing_v), 6) AS bearing_rad, CAST(gnss AS VARCHAR) AS altitude_source_gnss FROM good"""


def prj_08_parse_bits(spark, folder):
    return _parsed(spark, folder).groupBy("parse_quality_bits").agg(F.count(F.lit(1)).alias("n"))


QUERIES["prj_08_parse_bits"] = prj_08_parse_bits
ORACLE["prj_08_parse_bits"] = f"""WITH {TYPED} SELECT CAST({_PARSE} AS BIGINT) AS parse_quality_bits, count(*) AS n FROM good GROUP BY 1"""


def prj_09_qc_bits(spark, folder):
    return _parsed(spark, folder).select("event_id", "qc_bits")


QUERIES["prj_09_qc_bits"] = prj_09_qc_bits
ORACLE["prj_09_qc_bits"] = f"""WITH {TYPED}, {_RANGE} SELECT event_id, CAST(qc AS BIGINT) AS qc_bits FROM quality"""


def _bit_counts(bits):
    def query(spark, folder):
        rows = _parsed(spark, folder)
        return rows.groupBy("source_file_id").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum((F.col("qc_bits").bitwiseAND(K.QC_BITS[b]) != 0).cast("long")).alias(b) for b in bits]
        )
    return query


for _name, _bits in {
    "prj_10_range_qc": ("range_geometry_inconsistent", "range_geometry_skipped"),
    "prj_11_bearing_qc": ("bearing_geometry_inconsistent", "bearing_geometry_skipped"),
    "prj_12_timestamp_decrease": ("timestamp_decrease",),
}.items():
    QUERIES[_name] = _bit_counts(_bits)
    ORACLE[_name] = f"""WITH {TYPED}, {_RANGE} SELECT source_file_id, count(*) AS n, {', '.join(
        f"count(*) FILTER (WHERE (CAST(qc AS BIGINT) & {K.QC_BITS[b]}) <> 0) AS {b}" for b in _bits)} FROM quality GROUP BY source_file_id"""


def prj_13_bad_rows(spark, folder):
    return C.bad_rows(stage_table(C.typed_rows(event_raw_text(spark, folder)), "typed")).select(
        "event_id", "reason_code", "parser_status", "parse_quality_bits", "raw_payload"
    )


QUERIES["prj_13_bad_rows"] = prj_13_bad_rows
_HEAD = ", ".join(f"'{h}'" for h in K.RAW_HEADER_V2)
_ROW = ", ".join(f'"{h}"' for h in K.RAW_HEADER_V2)
ORACLE["prj_13_bad_rows"] = f"""WITH {TYPED} SELECT event_id, CASE WHEN aircraft_id IS NULL THEN 'invalid_or_missing_aircraft_id' ELSE 'invalid_or_missing_utc_timestamp' END AS reason_code,
 CASE WHEN aircraft_id IS NULL THEN 'missing_aircraft_id' ELSE timestamp_error END AS parser_status, CAST(CASE WHEN aircraft_id IS NULL THEN 4 ELSE 8 END AS BIGINT) AS parse_quality_bits,
 CAST(to_json({{'header': [{_HEAD}], 'row': [{_ROW}]}}) AS VARCHAR) AS raw_payload FROM routed WHERE aircraft_id IS NULL OR timestamp_error IS NOT NULL"""


def prj_14_partitions(spark, folder):
    return _parsed(spark, folder).groupBy(
        "airport_id", F.col("partition_year").cast("long").alias("year"), F.col("partition_month").cast("long").alias("month")
    ).agg(F.count(F.lit(1)).alias("n"))


QUERIES["prj_14_partitions"] = prj_14_partitions
ORACLE["prj_14_partitions"] = f"""WITH {TYPED} SELECT airport_id, year(make_timestamp(stamp)) AS year, month(make_timestamp(stamp)) AS month, count(*) AS n FROM good GROUP BY ALL"""


def prj_15_feature_view(spark, folder):
    centered = C.feature_view(event_reports(spark, folder), "airport_centered")
    return centered.select("event_id", F.round("lat_deg", 6).alias("lat_deg"), F.round("lon_deg", 6).alias("lon_deg"), "altitude_m")


QUERIES["prj_15_feature_view"] = prj_15_feature_view
ORACLE["prj_15_feature_view"] = f"""WITH {S.REPORTS} SELECT event_id, round(lat_deg - CAST(40.7765833333 AS DOUBLE), 6) AS lat_deg,
 round(lon_deg - CAST(-79.9510833333 AS DOUBLE), 6) AS lon_deg, altitude_m FROM reports"""


def flt_01_terminal_volume(spark, folder):
    reports = event_reports(spark, folder)
    center = K.AIRPORT_CENTERS["AP1"]
    volumes = spark.createDataFrame(
        [("AP1", center[0], center[1], 380.0, K.VOLUME_RADIUS_M / 2, K.VOLUME_FLOOR_M, K.VOLUME_CEILING_M / 2)],
        "airport_id string, volume_lat double, volume_lon double, elevation_m double, radius_m double, floor_m double, ceiling_m double",
    )
    return C.terminal_audit(reports, volumes)[1]


QUERIES["flt_01_terminal_volume"] = flt_01_terminal_volume
ORACLE["flt_01_terminal_volume"] = f"""WITH {S.REPORTS}, c AS (SELECT CAST(40.7765833333 AS DOUBLE) AS lat_deg, CAST(-79.9510833333 AS DOUBLE) AS lon_deg),
 j AS (SELECT r.airport_id, {S.hav('r', 'c')} > 9260.0 AS far, r.altitude_m NOT BETWEEN 230.0 AND 1142.0 AS off FROM reports r CROSS JOIN c)
SELECT airport_id, count(*) AS input_reports, count(*) FILTER (WHERE NOT far AND NOT off) AS accepted_reports, count(*) FILTER (WHERE far) AS outside_horizontal,
 count(*) FILTER (WHERE NOT far AND off) AS outside_vertical FROM j GROUP BY ALL"""


def flt_02_finite_states(spark, folder):
    from tracklens.operators.ticks import finite_reports

    rows = _parsed(spark, folder)
    return finite_reports(rows).groupBy("source_file_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("aircraft_id").alias("aircraft"))


QUERIES["flt_02_finite_states"] = flt_02_finite_states
ORACLE["flt_02_finite_states"] = f"""WITH {TYPED} SELECT source_file_id, count(*) AS n, count(DISTINCT aircraft_id) AS aircraft FROM good
 WHERE Lat_v BETWEEN -90 AND 90 AND Lon_v BETWEEN -180 AND 180 AND Altitude_v IS NOT NULL AND Speed_v IS NOT NULL AND Heading_v IS NOT NULL GROUP BY ALL"""


def fn_01_haversine(spark, folder):
    lat0, lon0 = (F.lit(v) for v in K.AIRPORT_CENTERS["AP1"])
    return event_reports(spark, folder).select("event_id", F.round(geo.haversine_m(lat0, lon0, F.col("lat_deg"), F.col("lon_deg")), 3).alias("d_m"))


QUERIES["fn_01_haversine"] = fn_01_haversine
ORACLE["fn_01_haversine"] = f"""WITH {S.REPORTS}, c AS (SELECT CAST(40.7765833333 AS DOUBLE) AS lat_deg, CAST(-79.9510833333 AS DOUBLE) AS lon_deg)
SELECT event_id, round({S.hav('c', 'r')}, 3) AS d_m FROM reports r CROSS JOIN c"""


def fn_02_range_bearing(spark, folder):
    lat0, lon0 = (F.lit(v) for v in K.AIRPORT_CENTERS["AP1"])
    rng, bearing = geo.range_bearing(lat0, lon0, F.col("lat_deg"), F.col("lon_deg"))
    return event_reports(spark, folder).select("event_id", F.round(rng, 3).alias("range_m"), F.round(bearing, 4).alias("bearing_deg"))


QUERIES["fn_02_range_bearing"] = fn_02_range_bearing
ORACLE["fn_02_range_bearing"] = f"""WITH {S.REPORTS}, g AS (SELECT event_id, radians(lat_deg) AS la, radians(lon_deg - -79.9510833333) AS dl, radians(40.7765833333) AS l0 FROM reports),
 h AS (SELECT *, pow(sin((la - l0) / 2), 2) + cos(l0) * cos(la) * pow(sin(dl / 2), 2) AS hv, degrees(atan2(sin(dl) * cos(la), cos(l0) * sin(la) - sin(l0) * cos(la) * cos(dl))) AS b FROM g)
SELECT event_id, round(6371008.8 * 2 * atan2(sqrt(hv), sqrt(1 - hv)), 3) AS range_m, round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 4) AS bearing_deg FROM h"""


def fn_03_local_plane(spark, folder):
    lat0, lon0 = K.AIRPORT_CENTERS["AP1"]
    return event_reports(spark, folder).select(
        "event_id", F.round(geo.plane_x(F.col("lon_deg"), lat0, F.lit(lon0)), 3).alias("x_m"), F.round(geo.plane_y(F.col("lat_deg"), F.lit(lat0)), 3).alias("y_m")
    )


QUERIES["fn_03_local_plane"] = fn_03_local_plane
ORACLE["fn_03_local_plane"] = f"""WITH {S.REPORTS} SELECT event_id, round((lon_deg - CAST(-79.9510833333 AS DOUBLE)) * 111320.0 * cos(radians(40.7765833333)), 3) AS x_m,
 round((lat_deg - CAST(40.7765833333 AS DOUBLE)) * 111320.0, 3) AS y_m FROM reports"""


def fn_04_angle_difference(spark, folder):
    return event_reports(spark, folder).select("event_id", F.round(geo.angle_difference(F.col("heading_rad"), F.radians(F.col("age_s") * 3.0)), 6).alias("angle"))


QUERIES["fn_04_angle_difference"] = fn_04_angle_difference
ORACLE["fn_04_angle_difference"] = f"""WITH {S.REPORTS}, a AS (SELECT event_id, abs(heading_rad - radians(age_s * 3)) AS d FROM reports)
SELECT event_id, round(least(d, 2 * pi() - d), 6) AS angle FROM a"""


def fn_06_constant_velocity(spark, folder):
    d_lat, d_lon = geo.constant_velocity_delta(F.col("lat_deg"), F.col("speed_mps"), F.col("heading_rad"), 30.0)
    return event_reports(spark, folder).select("event_id", F.round(d_lat, 8).alias("d_lat"), F.round(d_lon, 8).alias("d_lon"))


QUERIES["fn_06_constant_velocity"] = fn_06_constant_velocity
ORACLE["fn_06_constant_velocity"] = f"""WITH {S.REPORTS} SELECT event_id, round(speed_mps * cos(heading_rad) * 30 / 111320, 8) AS d_lat,
 round(speed_mps * sin(heading_rad) * 30 / (111320 * greatest(0.1, cos(radians(lat_deg)))), 8) AS d_lon FROM reports"""


def fn_11_time_text(spark, folder):
    us = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) - (event_id % 1300) * 86400000000")
    rows = load(spark, folder, "events").select("event_id", us.alias("us"))
    day = F.timestamp_micros("us").cast("date")
    return rows.select(
        "event_id", text.iso_micros(F.col("us")).alias("iso"), text.season(F.month(day)).alias("season"),
        text.date_stratum(day).alias("stratum"), text.path_date_token(F.concat(F.lit("raw/"), F.date_format(day, "MM-dd-yy"), F.lit("/a.csv"))).alias("token"),
    )


QUERIES["fn_11_time_text"] = fn_11_time_text
ORACLE["fn_11_time_text"] = """WITH e AS (SELECT event_id, ts - to_days(CAST(event_id % 1300 AS INT)) AS u FROM events)
SELECT event_id, strftime(u, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, CASE WHEN month(u) IN (12, 1, 2) THEN 'winter' WHEN month(u) < 6 THEN 'spring' WHEN month(u) < 9 THEN 'summer' ELSE 'autumn' END AS season,
 CASE WHEN year(u) = 2020 AND quarter(u) >= 3 THEN concat('2020Q', quarter(u)) WHEN year(u) = 2021 THEN CASE WHEN month(u) <= 6 THEN '2021H1' ELSE '2021H2' END
  WHEN year(u) = 2022 THEN concat('2022Q', quarter(u)) END AS stratum, strftime(u, '%m-%d-%y') AS token FROM e"""


def fn_12_json_fields(spark, folder):
    props = load(spark, folder, "events").select("event_id", F.from_json("props", "k INT").alias("p"), "event_type")
    return props.select("event_id", F.col("p.k").cast("long").alias("k"), F.to_json(F.struct("event_type", F.col("p.k").alias("k"))).alias("doc"))


QUERIES["fn_12_json_fields"] = fn_12_json_fields
ORACLE["fn_12_json_fields"] = """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 CAST(to_json({'event_type': event_type, 'k': CAST(json_extract_string(props, '$.k') AS INT)}) AS VARCHAR) AS doc FROM events"""
