"""Raw rows to canonical reports: typed projection, unit conversion, routing and quality bits."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracklens import constants as K
from tracklens.functions import geo, text
from tracklens.operators.ordered import blocked_lag


def _errors() -> Column:
    """Map of field name to error code, only for fields that failed."""
    fields = K.NUMERIC_FIELDS + ("AltisGNSS",)
    entries = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f"{f}_e").alias("value")) for f in fields])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def typed_rows(raw: DataFrame) -> DataFrame:
    """Typed columns next to the raw text; values that fail to parse become null, never a guess.

    Stage the result before routing it to several ledgers: a filter on a parsed column would otherwise be
    pushed below the parser and repeat it.
    """
    numbers = text.with_numbers(text.with_datetime(raw, "Date", "Time"), K.NUMERIC_FIELDS)
    return numbers.withColumns({
        "aircraft_id": text.parse_text(F.col("ID")),
        "tail_or_callsign": text.parse_text(F.col("Tail")),
        "altitude_source_gnss": text.parse_bool(F.col("AltisGNSS")),
        "AltisGNSS_e": text.bool_error(F.col("AltisGNSS")),
    }).withColumn("field_errors", _errors()).drop(*[f"{f}_e" for f in K.NUMERIC_FIELDS], "AltisGNSS_e")


def parse_bits() -> Column:
    codes = F.map_values("field_errors")

    def bit(error: str, rule: str) -> Column:
        return F.when(F.array_contains(codes, error), F.lit(K.PARSE_BITS[rule])).otherwise(F.lit(0))

    return (
        bit("invalid_float", "invalid_numeric_token") + bit("nonfinite_float", "nonfinite_numeric_token")
        + bit("invalid_boolean", "invalid_boolean_token")
    ).cast("long")


def route_reason() -> Column:
    return F.when(F.col("aircraft_id").isNull(), "invalid_or_missing_aircraft_id").when(
        F.col("timestamp_us").isNull(), "invalid_or_missing_utc_timestamp"
    )


def bad_rows(typed: DataFrame, header: tuple[str, ...] = K.RAW_HEADER_V2) -> DataFrame:
    """Rejected rows with their payload as canonical JSON and a reason."""
    reason = route_reason()
    bit = F.when(reason == "invalid_or_missing_aircraft_id", K.PARSE_BITS["invalid_or_missing_aircraft_id"]).otherwise(
        K.PARSE_BITS["invalid_or_missing_utc_timestamp"]
    )
    status = F.when(F.col("aircraft_id").isNull(), F.lit("missing_aircraft_id")).otherwise(F.col("timestamp_error"))
    payload = F.to_json(F.struct(F.array(*[F.lit(h) for h in header]).alias("header"), F.array(*header).alias("row")))
    return typed.filter(reason.isNotNull()).withColumns({
        "reason_code": reason, "parser_status": status, "parse_quality_bits": bit.cast("long"), "raw_payload": payload,
        "raw_tokens": F.array(*header),
    })


def _flag(condition: Column, code: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(K.QC_BITS[code])).otherwise(F.lit(0))


def qc_terms(center: tuple[Column, Column], decrease: Column) -> dict[str, Column]:
    """Every advisory rule as a condition on the raw-unit values."""
    lat, lon, rng, brg, age = (F.col(f"{n}_v") for n in ("Lat", "Lon", "Range", "Bearing", "Age"))
    speed, heading = F.col("Speed_v"), F.col("Heading_v")
    placed = lat.between(-90, 90) & lon.between(-180, 180) & center[0].isNotNull() & center[1].isNotNull()
    placed = F.coalesce(placed, F.lit(False))
    expected, bearing = geo.range_bearing(center[0], center[1], lat, lon)
    tolerance = F.greatest(F.lit(K.RANGE_ABSOLUTE_TOLERANCE_M), F.lit(K.RANGE_RELATIVE_TOLERANCE) * expected)
    undefined = brg.isNull() | (expected == 0.0)
    missing = reduce(lambda a, b: a | b, [F.col(f"{n}_v").isNull() for n in K.NUMERIC_FIELDS if n != "Age"])
    age_error = F.element_at("field_errors", "Age")
    nonfinite = F.coalesce(age_error == "nonfinite_float", F.lit(False))
    return {
        "bearing_geometry_inconsistent": placed & ~undefined & (geo.circular_error_deg(brg, bearing) > K.BEARING_TOLERANCE_DEG),
        "bearing_geometry_skipped": ~placed | undefined,
        "heading_out_of_domain": ~heading.between(0, 360),
        "latitude_out_of_domain": ~lat.between(-90, 90),
        "longitude_out_of_domain": ~lon.between(-180, 180),
        "missing_age": age.isNull() & ~nonfinite,
        "missing_observation_fields": missing,
        "negative_age": age < 0,
        "negative_range": rng < 0,
        "negative_speed": speed < 0,
        "nonfinite_age": age.isNull() & nonfinite,
        "range_geometry_inconsistent": placed & rng.isNotNull() & (F.abs(rng * 1000.0 - expected) > tolerance),
        "range_geometry_skipped": ~placed | rng.isNull(),
        "timestamp_decrease": decrease,
    }


def _center(which: int) -> Column:
    result = F.lit(None).cast("double")
    for airport, point in K.AIRPORT_CENTERS.items():
        result = F.when(F.col("airport_id") == airport, F.lit(point[which])).otherwise(result)
    return result


def parsed_rows(typed: DataFrame, source: str = "source_file_id", ordinal: str = "event_id", block_rows: int = 65_536) -> DataFrame:
    """Accepted rows in SI units with parse and advisory bits and partition columns.

    The ordering check looks at the preceding accepted row of the source; a large source is cut into blocks.
    """
    valid = typed.filter(route_reason().isNull())
    ordered = blocked_lag(valid, [source], F.floor(F.col(ordinal) / block_rows), [ordinal], ["timestamp_us"])
    decrease = F.col("timestamp_us") < F.col("prev.timestamp_us")
    bits = reduce(lambda a, b: a + b, [_flag(c, code) for code, c in qc_terms((_center(0), _center(1)), decrease).items()])
    def radians(degrees: Column) -> Column:
        return degrees * F.pi() / F.lit(180.0)

    stamp = F.timestamp_micros("timestamp_us")
    return ordered.select(
        *[c for c in ("airport_id", source, ordinal) if c in ordered.columns],
        "aircraft_id", "tail_or_callsign", "timestamp_us",
        F.col("Lat_v").alias("lat_deg"), F.col("Lon_v").alias("lon_deg"),
        (F.col("Altitude_v") * K.FEET_TO_M).alias("altitude_m"),
        (F.col("Speed_v") * K.KNOTS_TO_MPS).alias("speed_mps"),
        radians(F.col("Heading_v")).alias("heading_rad"),
        F.col("Age_v").alias("age_s"), (F.col("Range_v") * 1000.0).alias("range_m"),
        radians(F.col("Bearing_v")).alias("bearing_rad"), "altitude_source_gnss",
        parse_bits().alias("parse_quality_bits"), bits.cast("long").alias("qc_bits"),
        F.year(stamp).alias("partition_year"), F.month(stamp).alias("partition_month"),
    )


def terminal_audit(reports: DataFrame, volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted reports, audit counts). The horizontal test comes first; all limits are inclusive."""
    placed = reports.join(volumes, "airport_id")
    distance = geo.haversine_m(F.col("lat_deg"), F.col("lon_deg"), F.col("volume_lat"), F.col("volume_lon"))
    low, high = F.col("elevation_m") + F.col("floor_m"), F.col("elevation_m") + F.col("ceiling_m")
    outcome = F.when(distance > F.col("radius_m"), "outside_horizontal").when(
        ~F.col("altitude_m").between(low, high), "outside_vertical"
    ).otherwise("accepted")
    judged = placed.withColumn("outcome", outcome)
    accepted = judged.filter("outcome = 'accepted'").select(*reports.columns)
    audit = judged.groupBy("airport_id").agg(
        F.count(F.lit(1)).alias("input_reports"),
        F.count_if(F.col("outcome") == "accepted").alias("accepted_reports"),
        F.count_if(F.col("outcome") == "outside_horizontal").alias("outside_horizontal"),
        F.count_if(F.col("outcome") == "outside_vertical").alias("outside_vertical"),
    )
    return accepted, audit


def feature_view(reports: DataFrame, mode: str) -> DataFrame:
    """Absolute coordinates, no coordinates, or coordinates relative to the airport."""
    if mode == "absolute":
        return reports
    if mode == "no_position":
        return reports.drop("lat_deg", "lon_deg")
    if mode == "airport_centered":
        return reports.withColumns({
            "lat_deg": F.col("lat_deg") - _center(0), "lon_deg": F.col("lon_deg") - _center(1),
        })
    raise ValueError(f"unknown feature mode: {mode}")
