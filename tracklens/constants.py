"""Fixed values. They must equal the published definitions for results to agree."""

# Units.
FEET_TO_M = 0.3048
KNOTS_TO_MPS = 0.5144444444444445
NAUTICAL_MILE_M = 1852.0
MANEUVER_KNOT_MPS = 0.514444
MICROS = 1_000_000

# Earth models. Labels and QC use the sphere, features the local plane.
EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE = 111_320.0

# Proximity rule and terminal volume.
PROXIMITY_HORIZONTAL_M = 5.0 * NAUTICAL_MILE_M
PROXIMITY_VERTICAL_M = 1000.0 * FEET_TO_M
CLOSING_RANGE_M = 10.0 * NAUTICAL_MILE_M
VOLUME_RADIUS_M = 18_520.0
VOLUME_FLOOR_M = -150.0
VOLUME_CEILING_M = 1_524.0
EMPTY_DISTANCE_M = 100_000.0

# Advisory geometry tolerances.
RANGE_ABSOLUTE_TOLERANCE_M = 500.0
RANGE_RELATIVE_TOLERANCE = 0.05
BEARING_TOLERANCE_DEG = 5.0

# Raw text tokens and schemas.
MISSING_TOKENS = ("", "none", "null", "nan")
NUMERIC_FIELDS = ("Altitude", "Speed", "Heading", "Lat", "Lon", "Age", "Range", "Bearing")
RAW_HEADER_V1 = (
    "ID", "Time", "Date", "Altitude", "Speed", "Heading",
    "Lat", "Lon", "Age", "Range", "Bearing", "Tail",
)
RAW_HEADER_V2 = RAW_HEADER_V1 + ("AltisGNSS",)
RAW_SCHEMA_V1 = "raw_v1_12"
RAW_SCHEMA_V2 = "raw_v2_13_altisgnss"

# Parse-quality bits.
PARSE_BITS = {
    "invalid_boolean_token": 1,
    "invalid_numeric_token": 2,
    "invalid_or_missing_aircraft_id": 4,
    "invalid_or_missing_utc_timestamp": 8,
    "nonfinite_numeric_token": 16,
    "row_parser_failure": 32,
    "unsupported_schema": 64,
}

# Advisory quality bits.
QC_BITS = {
    "bearing_geometry_inconsistent": 1,
    "bearing_geometry_skipped": 2,
    "heading_out_of_domain": 4,
    "latitude_out_of_domain": 8,
    "longitude_out_of_domain": 16,
    "missing_age": 32,
    "missing_observation_fields": 64,
    "negative_age": 128,
    "negative_range": 256,
    "negative_speed": 512,
    "nonfinite_age": 1024,
    "range_geometry_inconsistent": 2048,
    "range_geometry_skipped": 4096,
    "timestamp_decrease": 8192,
}

# Field groups of the duplicate rules.
CORE_FIELDS = ("lat_deg", "lon_deg", "altitude_m", "speed_mps", "heading_rad")
METADATA_FIELDS = ("age_s", "range_m", "bearing_rad", "tail_or_callsign", "altitude_source_gnss")
COMPLETENESS_FIELDS = (
    "lat_deg", "lon_deg", "altitude_m", "speed_mps", "heading_rad",
    "age_s", "range_m", "bearing_rad", "tail_or_callsign",
)

# Airport reference points by identifier.
AIRPORT_CENTERS = {"AP1": (40.7765833333, -79.9510833333)}

# Dispersion and clipping floors of the count and risk metrics.
MIN_MEAN = 1e-8
MIN_DISPERSION = 1e-8
LOG_LOSS_CLIP = 1e-12
LOGIT_CLIP = 1e-8
